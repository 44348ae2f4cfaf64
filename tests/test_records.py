"""Clean-up builders on cases written by hand."""

import pytest
from pyspark.sql import functions as F

from marketloom.functions import cleanup as C
from marketloom.operators import custom


def one(spark, build, *values):
    cols = ", ".join(f"c{i} string" for i in range(len(values)))
    return spark.createDataFrame([values], cols).select(build(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()[0]


@pytest.mark.parametrize(
    "build, text, want",
    [
        (C.without_pictographs, "★ Nowość ★", "Nowość"),
        (C.without_pictographs, "💅 hybryda \n na stopy –", "hybryda na stopy"),
        (C.without_pictographs, "", ""),
        (C.without_pictographs, None, None),
        (C.tidy_name, "  Peeling kawitacyjny.. ", "Peeling kawitacyjny"),
        (C.tidy_name, "strzyżenie+modelowanie", "strzyżenie + modelowanie"),
        (C.tidy_name, "rzęsy- lifting", "rzęsy - lifting"),
        (C.tidy_name, "anti-age 2.0", "anti-age 2.0"),
        (C.tidy_name, None, None),
        (C.sentence_case, "HENNA BRWI I RZĘS", "Henna brwi i rzęs"),
        (C.sentence_case, "SPA", "SPA"),
        (C.sentence_case, "Pakiet SPA", "Pakiet SPA"),
        (C.tidy_sentence, "maska ,peeling;;serum i krem", "Maska,peeling; serum i krem."),
        (C.tidy_sentence, "czas ok .45 minut,,  na stopy", "Czas ok.45 minut, na stopy."),
        (C.tidy_sentence, "raz!dwa", "Raz! dwa"),
        (C.tidy_sentence, "raz:dwa", "Raz: dwa."),
        (C.tidy_sentence, "• jeden dwa trzy cztery", "• jeden dwa trzy cztery"),
        (C.tidy_sentence, "pierwsza linia tekstu\n\n druga", "Pierwsza linia tekstu\n\ndruga."),
        (C.tidy_sentence, "Masaż", "Masaż"),
        (C.tidy_sentence, "dalej .... ", "Dalej…"),
        (C.tidy_sentence, "", ""),
        (C.tidy_sentence, None, None),
    ],
)
def test_clean_up(spark, build, text, want):
    got = one(spark, build, text)
    assert got == want
    if got:
        assert one(spark, build, got) == got


def test_full_name(spark):
    def build(name, label):
        return C.full_name(name, F.array(F.lit(None).cast("string"), label))

    assert one(spark, build, "Mikroderma...twarzy", "Mikrodermabrazja diamentowa twarzy") == "Mikrodermabrazja diamentowa twarzy"
    assert one(spark, build, "Mikrodermabr… ", "Mezoterapia") == "Mikrodermabr…"
    assert one(spark, build, "Mikroderma…twarzy", "Mikrodermatwarzy") == "Mikroderma…twarzy"
    assert one(spark, build, "Mez…", "Mezoterapia igłowa") == "Mez…"
    assert one(spark, build, "Mezo", "Mezoterapia igłowa") == "Mezo"


def test_drift_and_tokens(spark):
    assert one(spark, C.character_drift, "abc", "abc") == 0
    assert one(spark, C.character_drift, "", "abc") == 1
    assert one(spark, C.character_drift, "", "") == 0
    assert one(spark, C.character_drift, "aab", "ab") == pytest.approx(1 / 3)
    assert one(spark, C.share_tokens, "medycyna estetyczna", "zabiegi medycyna") is True
    assert one(spark, C.share_tokens, "a b c", "c d e f") is False
    assert one(spark, C.share_tokens, None, "c") is False


@pytest.mark.parametrize("n, want", [(1, "1 x"), (3, "3 y"), (12, "12 z"), (22, "22 y"), (5, "5 z"), (0, "0 z")])
def test_counted(spark, n, want):
    assert spark.range(n, n + 1).select(C.counted(F.col("id"), "x", "y", "z")).first()[0] == want


@pytest.mark.parametrize(
    "text, want",
    [
        ('{"a":1,}', '{"a":1}'), ('[1,2,,', "[1,2]"), ('{"a":[1,{"b":2}', '{"a":[1,{"b":2}]}'), ('{"a":"x', '{"a":"x"}'), ('{"a":"x\\', '{"a":"x"}'),
        ('{"a":1,"b":', '{"a":1}'), ('{"a":1,"b', '{"a":1}'), ('{"a":[1}', '{"a":[1]}'), ("[1]]", "[1]"), ('{"a" : "q, }]" ,\t}', '{"a":"q, }]"}'), ("no", None), ("", None), (None, None),
    ],
)
def test_json_repair(text, want):
    assert custom.repaired(text) == want


def test_json_patch(spark):
    rows = [
        ('{"a":[1,2]}', '[{"op":"add","path":"/a/-","value":3}]', '{"a": [1, 2, 3]}'), ('{"a":1}', '[{"op":"remove","path":"/a"},{"op":"add","path":"/x~1y","value":2}]', '{"x/y": 2}'),
        (None, "[]", None), ("{}", None, None), ('{"a":1}', '[{"op":"remove","path":"/b"}]', None), ("[]", '[{"op":"replace","path":"/0/c","value":1}]', None), ("1", '[{"op":"replace","path":"","value":{}}]', "{}"),
    ]
    df = spark.createDataFrame(rows, "doc string, ops string, want string")
    for r in df.withColumn("got", custom.json_patch("doc", "ops")).collect():
        assert r.got == r.want


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    got = {r.id: r.component for r in custom.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100}
    with pytest.raises(RuntimeError):
        custom.components(spark.createDataFrame(chain, "a bigint, b bigint"), rounds=1)
