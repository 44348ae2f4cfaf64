"""Typed parameters of services, read from their names: kinds with intervals, compared kind by kind.

A name gives ``map<kind, struct<low, high, unit>>``; a kind that the name lacks has no entry. A value without a range is an
interval of one point, so equality is a case of intersection.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketloom.functions.exprs import fold

#: Stems of counted units, by whose first six letters two units agree.
COUNTED = ("paznok", "okolic", "stref", "parti", "punkt", "zabieg", "szt", "obszar", "ampul")
#: How each kind is written. The first group is the low end; the second, where there is one, the high end.
FORMS = {
    "ml": r"([0-9]+(?:[.,][0-9]+)?)\s*ml\b",
    "count": rf"\b([0-9]+)\s*((?:{'|'.join(COUNTED)})\w*)",
    "ratio": r"\b([0-9]{1,2})\s*:\s*[0-9]{1,2}\b",
    "dim": r"\b([0-9]{1,2})(?:\s*/\s*([0-9]{1,2}))?\s*d\b",
    "weeks": r"\b([0-9]{1,2})\s*(?:tyg|tydz)\w*",
    "length": r"dlugosc\w*\s*([0-9]{1,2})(?:\s*-\s*([0-9]{1,2}))?",
}
KIND = "struct<low:double,high:double,unit:string>"


def plain_name(name: Column) -> Column:
    """Words of a name for amounts: no leading ordinal, other marks than point and comma as spaces, ASCII letters."""
    bare = F.regexp_replace(name, r"^\s*[0-9IVXivx]+\.\s*", "")
    spaced = F.regexp_replace(F.regexp_replace(bare, r"[^\p{L}\p{N}_\s,.]", " "), "[łŁ]", "")
    return F.regexp_replace(fold(spaced), r"[^\x00-\x7F]", "")


def typed_params(name: Column) -> Column:
    """All parameters of a name: ``ml``, ``count`` (with its unit), ``volume`` (``2:1`` and ``2D`` are [2, 2], ``3/4D`` is
    [3, 4]; a ratio comes before a dimension), ``weeks`` and ``length``. Null and plain names give an empty map."""
    texts = F.struct(plain_name(F.coalesce(name, F.lit(""))).alias("words"), fold(F.coalesce(name, F.lit(""))).alias("marks"))
    # A lambda's argument is evaluated once, where each form would fold the name again.
    entries = F.get(F.transform(F.array(texts), lambda t: _entries(t["words"], t["marks"])), 0)
    return F.map_from_entries(F.filter(entries, lambda e: e.isNotNull()))


def _entries(words: Column, marks: Column) -> Column:
    """An array with an entry a kind, null where neither text has it."""
    part = lambda text, kind, group: F.nullif(F.regexp_extract(text, FORMS[kind], group), F.lit(""))
    number = lambda text, kind, group=1: F.replace(part(text, kind, group), F.lit(","), F.lit(".")).cast("double")

    def entry(kind: str, low: Column, high: Column, unit: Column | str = "") -> Column:
        unit = F.lit(unit) if isinstance(unit, str) else unit
        value = F.struct(F.least(low, high).alias("low"), F.greatest(low, high).alias("high"), unit.alias("unit")).cast(KIND)
        return F.when(low.isNotNull(), F.struct(F.lit(kind).alias("key"), value.alias("value")))

    ml, count, ratio, dim, weeks, length = (
        number(text, kind) for text, kind in ((words, "ml"), (words, "count"), (marks, "ratio"), (marks, "dim"), (marks, "weeks"), (marks, "length"))
    )
    return F.array(
        entry("ml", ml, ml),
        entry("count", count, count, F.substring(part(words, "count", 2), 1, 6)),
        entry("volume", F.coalesce(ratio, dim), F.coalesce(ratio, number(marks, "dim", 2), dim)),
        entry("weeks", weeks, weeks),
        entry("length", length, F.coalesce(number(marks, "length", 2), length)),
    )


KINDS = ("ml", "count", "volume", "weeks", "length")


def by_kind(params: Column) -> Column:
    """The map of parameters as a struct with a field a kind, null where the name lacks it: what pairs compare without lambdas."""
    return F.struct(*[F.try_element_at(params, F.lit(k)).alias(k) for k in KINDS])


def kinds_agree(a: Column, b: Column) -> Column:
    """``params_agree`` of two structs of ``by_kind``."""
    both = [(a[k], b[k]) for k in KINDS]
    shared = reduce(or_, [x.isNotNull() & y.isNotNull() for x, y in both])
    apart = reduce(or_, [F.coalesce((x["high"] < y["low"]) | (y["high"] < x["low"]) | (x["unit"] != y["unit"]), F.lit(False)) for x, y in both])
    return F.when(~shared, 0).when(apart, -1).otherwise(1)


def params_agree(a: Column, b: Column) -> Column:
    """1 if all kinds that both have intersect and agree in their unit, -1 if one does not, 0 if they share no kind."""
    shared = F.array_intersect(F.map_keys(a), F.map_keys(b))
    apart = lambda k: (a[k]["high"] < b[k]["low"]) | (b[k]["high"] < a[k]["low"]) | (a[k]["unit"] != b[k]["unit"])
    return F.when(F.coalesce(F.size(shared), F.lit(0)) <= 0, 0).when(F.exists(shared, apart), -1).otherwise(1)
