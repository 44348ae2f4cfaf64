"""Quality rules whose cutoffs are chosen with a guarantee.

Each rule compares one measure of a text with a cutoff. Labelled documents form the holdout: for every
stratum and rule the cutoffs are tried from the most lenient to the strictest, and a cutoff is accepted while
an exact binomial test rejects "more than the rule's share of ``alpha`` of the good documents would be lost". Each
rule has an equal share, so that all rules together lose at most ``alpha`` of a stratum. Testing along one sequence
needs no correction; across strata and rules the level is divided by their number (Bonferroni).

A stratum of fewer good documents than the test needs even without any loss could never get a cutoff. All such
strata form one pooled stratum, by this rule alone, which looks at their numbers and not at their losses; if even the
pool is too small, only the base rule judges its documents.
Everything is an expression over DataFrames: measures are computed inside each row, without a shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketloom.llm.common import Scratch, let, table, words

#: Characters that count as symbols.
SYMBOLS = r"[#*$%&|<>]"
#: Words in a repeat window.
WINDOW = 8


def repeated_words(tokens: Column) -> Column:
    """How many words lie in 8-word windows that occur at least twice, first occurrences included.

    Windows are hashed; a text without an equal pair of hashes ends there. Otherwise the windows are sorted by
    hash, those with an equal neighbour are repeats, and the length of the union of their spans is summed up.
    The cost is n log n in the words of one text.
    """

    def covered(hashes: Column) -> Column:
        ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def spans(s: Column) -> Column:
            n = F.size(s)
            starts = F.transform(
                s,
                lambda x, j: F.when(
                    ((j > 0) & (F.try_element_at(s, F.greatest(j, F.lit(1)))["h"] == x["h"]))
                    | ((j < n - 1) & (F.try_element_at(s, F.least(j + 2, n))["h"] == x["h"])),
                    x["i"],
                ),
            )
            return let(F.array_sort(F.filter(starts, lambda i: i.isNotNull())), union_length)

        return let(ranked, spans)

    def union_length(at: Column) -> Column:
        return F.aggregate(
            at,
            F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
            lambda acc, i: F.struct(
                (i + WINDOW).alias("end"), (acc["sum"] + i + WINDOW - F.greatest(acc["end"], i)).alias("sum")
            ),
            lambda acc: acc["sum"],
        )

    def count(w: Column) -> Column:
        hashes = F.transform(
            F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW))
        )
        return let(
            hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h))
        )

    return let(tokens, lambda w: F.when(F.size(w) < WINDOW, F.lit(0)).otherwise(count(w))).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines that hold a word and equal an earlier line of the text."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` with ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` (long) of each text.

    A null text has no words and all counts are 0. Columns of these names are replaced.
    """
    text = F.coalesce(F.col("text"), F.lit(""))

    def all_of(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    return docs.withColumn("_m", let(words(text), all_of)).withColumns(
        {
            "n_words": F.col("_m.n_words"),
            "word_chars": F.col("_m.word_chars"),
            "n_symbols": (F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, ""))).cast("long"),
            "n_dup_lines": duplicate_lines(text),
            "n_repeat_words": F.col("_m.n_repeat_words"),
        }
    ).drop("_m")


MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base_failed() -> Column:
    """The fixed base rule: under 20 words, or over 30 % of the words in repeated windows."""
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


@dataclass(frozen=True)
class RiskLimits:
    """``alpha``: largest share of good documents of a stratum that all rules together may lose; ``delta``: chance that
    any accepted cutoff breaks it; ``stratum``: the column whose values are the strata."""

    alpha: float = 0.02
    delta: float = 0.05
    stratum: str = "lang"


#: Names the stratum of all that are too small on their own; it comes before every text.
POOL = "\x01"
#: The most strata with cutoffs of their own that are sent to each task; each needs over a thousand good documents.
MOST_STRATA = 1_000_000


#: Rules: measure name -> cutoffs in permille or hundredths, lenient first. A text fails if it is above.
#: Fixed before any label is seen, as the guarantee needs.
CUTOFFS = {
    "symbols_per_word": [2000, 1000, 500, 300, 200, 150, 100, 75, 50, 30],
    "dup_line_share": [900, 800, 700, 600, 500, 400, 300, 200],
    "repeat_share": [300, 250, 200, 150, 100],
    "long_words": [3000, 2500, 2000, 1700, 1500, 1300, 1200],
}


def rule_values() -> dict[str, Column]:
    """Each rule's measure as an integer: per thousand words, or hundredths of a character a word."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.floor(1000 * F.col("n_symbols") / n),
        "dup_line_share": F.floor(1000 * F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))),
        "repeat_share": F.floor(1000 * F.col("n_repeat_words") / n),
        "long_words": F.floor(100 * F.col("word_chars") / n),
    }


#: log k! for k below 16; Stirling's series is exact to 1e-12 from there on.
LOG_FACTORIALS = [math.lgamma(k + 1) for k in range(16)]


def log_factorial(k: Column) -> Column:
    x = F.greatest(k, F.lit(16)).cast("double")
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    table = F.element_at(F.array(*map(F.lit, LOG_FACTORIALS)), (F.least(k, F.lit(15)) + 1).cast("int"))
    return F.when(k < 16, table).otherwise(series)


def binomial_tail(k: Column, n: Column, alpha: float) -> Column:
    """P(Bin(n, alpha) <= k).

    Up to the mean the terms are summed from the k-th down, beyond it those over k are summed upwards and taken from
    1; each is a part of the one before. Of n terms, 40 + 12 * sqrt(n * alpha + k) hold the sum to 1e-12 of its value.
    """
    p, q = alpha, 1.0 - alpha
    lower = k <= n * alpha
    first = F.when(lower, k).otherwise(k + 1)
    top = log_factorial(n) - log_factorial(first) - log_factorial(n - first) + first * math.log(p) + (n - first) * math.log(q)
    terms = F.least(F.when(lower, k).otherwise(n - first).cast("double"), 40 + 12 * F.sqrt(n * alpha + k)).cast("int")
    steps = F.when(terms >= 1, F.sequence(F.lit(0), terms - 1)).otherwise(F.array().cast("array<int>"))
    total = F.aggregate(
        steps,
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: let(
            a["term"]
            * F.when(lower, (k - i) * q / ((n - k + i + 1) * p)).otherwise((n - first - i) * p / ((first + i + 1) * q)),
            lambda t: F.struct(t.alias("term"), (a["sum"] + t).alias("sum")),
        ),
        lambda a: a["sum"],
    )
    part = F.least(F.exp(top) * total, F.lit(1.0))
    return F.when(k >= n, F.lit(1.0)).when(lower, part).otherwise(1.0 - part)


def select_cutoffs(measured: DataFrame, labels: DataFrame, limits: RiskLimits) -> DataFrame:
    """``_stratum`` and a column for each rule with its strictest accepted cutoff, null where none is.

    One row for each stratum that is large enough, and one named ``POOL`` for all others. ``labels`` has ``doc_id,
    quality``; a document is good if any of its labels is 1. The counts are one aggregation with partial sums in
    each task; what follows works on one row per stratum, rule and cutoff.
    """
    good = labels.filter(F.col("quality") == 1).select("doc_id").distinct()
    holdout = measured.filter(~F.col("base_failed")).join(good, "doc_id", "left_semi")
    # One pass: losses at every cutoff as columns, unpivoted only after the aggregation.
    named = [(rule, step, cut, f"{rule}:{step}") for rule, cuts in CUTOFFS.items() for step, cut in enumerate(cuts)]
    sums = [F.count_if(F.col(f"_{rule}") > cut).alias(name) for rule, _, cut, name in named]
    per = Scratch(measured.sparkSession, "quality-rules").save(
        holdout.groupBy("_stratum").agg(F.count("*").alias("n"), *sums), "losses"
    )
    alpha = limits.alpha / len(CUTOFFS)
    # Strata before pooling, and one for the pool: as many as can be tested.
    level = limits.delta / (per.count() + 1) / len(CUTOFFS)
    need = math.ceil(math.log(level) / math.log(1 - alpha))
    per = per.groupBy(F.when(F.col("n") >= need, F.col("_stratum")).otherwise(F.lit(POOL)).alias("_stratum")).agg(
        F.sum("n").alias("n"), *[F.sum(F.col(f"`{name}`")).alias(name) for *_, name in named]
    )
    rows = F.array(
        *[
            F.struct(F.lit(rule).alias("rule"), F.lit(step).alias("step"), F.lit(cut).alias("cutoff"), F.col(f"`{name}`").alias("k"))
            for rule, step, cut, name in named
        ]
    )
    tests = per.select("_stratum", "n", F.explode(rows).alias("r")).select("_stratum", "n", "r.*")
    tested = tests.withColumn("p_value", binomial_tail(F.col("k"), F.col("n"), alpha))
    passed = F.min(F.when(F.col("p_value") <= level, 1).otherwise(0)).over(
        Window.partitionBy("_stratum", "rule").orderBy("step")
    )
    return (
        tested.withColumn("ok", passed)
        .groupBy("_stratum")
        .pivot("rule", list(CUTOFFS))
        .agg(F.min(F.when(F.col("ok") == 1, F.col("cutoff"))))
    )


def judge(docs: DataFrame, labels: DataFrame, limits: RiskLimits = RiskLimits(), also: tuple = ()) -> DataFrame:
    """Every document's measures and verdict: ``doc_id``, the measures, ``base_failed``, ``kept``, ``reasons``,
    and the columns ``also`` of ``docs``.

    Null or empty texts have no words and fail the base rule. Documents of a stratum without labelled good
    documents go by the pool's cutoffs. A null stratum is a stratum of its own. Repeated rows are judged one by
    one. Empty tables give no rows; without labels only the base rule decides.
    """
    spark = docs.sparkSession
    stratum = F.col(limits.stratum) if limits.stratum in docs.columns else F.lit(None)
    measured = measures(
        docs.select("doc_id", *also, F.coalesce(stratum.cast("string"), F.lit("\x00")).alias("_stratum"), "text")
    ).withColumn(
        "n_lines", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    )
    measured = (
        Scratch(spark, "quality-rules")
        .save(measured.select("doc_id", *also, "_stratum", "n_lines", *MEASURES), "measures")
        .withColumns({f"_{k}": v for k, v in rule_values().items()} | {"base_failed": base_failed()})
    )
    cutoffs = Scratch(spark, "quality-rules").save(select_cutoffs(measured, labels.select("doc_id", "quality"), limits), "cutoffs")
    if (strata := cutoffs.count()) > MOST_STRATA:
        raise ValueError(f"{strata} strata are too many to send to each task; take a coarser column")
    pool = cutoffs.filter(F.col("_stratum") == POOL).select(F.lit(True).alias("_pooled"), *[F.col(r).alias(f"_pool_{r}") for r in CUTOFFS])
    own = cutoffs.filter(F.col("_stratum") != POOL).withColumn("_pooled", F.lit(False))
    failed = F.array_compact(
        F.array(
            F.when(F.col("base_failed"), F.lit("base")),
            *[F.when(F.col(f"_{rule}") > F.col(rule), F.lit(rule)) for rule in CUTOFFS],
        )
    )
    judged = measured.join(F.broadcast(own), "_stratum", "left").withColumn("_pooled", F.coalesce("_pooled", F.lit(True)))
    judged = judged.join(F.broadcast(pool), "_pooled", "left").withColumns(
        {r: F.when(F.col("_pooled"), F.col(f"_pool_{r}")).otherwise(F.col(r)) for r in CUTOFFS}
    )
    return judged.select(
        "doc_id", *MEASURES, "base_failed", (F.size(failed) == 0).alias("kept"), failed.alias("reasons"), *also
    )


def keep_good(docs: DataFrame, labels: DataFrame, limits: RiskLimits = RiskLimits()) -> DataFrame:
    """The documents that pass, with their own columns. Each row goes by its own text, whatever its doc_id.

    Rows are staged beside their measures and filtered there, so no text is shuffled. Null and empty texts go; an
    empty table gives no rows.
    """
    stratum = [F.col(limits.stratum).alias(limits.stratum)] if limits.stratum in docs.columns else []
    rows = docs.select("doc_id", "text", *stratum, F.struct(*docs.columns).alias("_row"))
    return judge(rows, labels, limits, ("_row",)).filter("kept").select("_row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *MEASURES, "base_failed", "kept"
    )
