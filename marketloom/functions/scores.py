"""Column builders for scores, confidences and tests of names and documents. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Statuses of a verification that are not shown.
HIDDEN_STATUSES = ["package_mismatch", "low_name_similarity", "duration_mismatch"]
#: Confidences of an alias by how specific it is, and the length from which it counts as specific.
ALIAS_CONFIDENCE = {"branded": 1.0, "specific": 0.95, "generic": 0.85}
ALIAS_LENGTH = 6
#: Most points of the parts of a completeness score.
COMPLETENESS = {"described": 6, "timed": 5, "fixed": 4}
#: Checks of a text: what no text that is shown may hold.
TEXT_CHECKS = {
    "mojibake": r"Ã.|Å.|â€|\x{FFFD}",
    "placeholder": r"(?i)\b(lorem ipsum|todo|tbd|n/a)\b",
    "double_space": r"\S  +\S",
    "markdown": r"\*\*[^*]+\*\*|__[^_]+__|(?m)^#{1,6} ",
    "empty_brackets": r"\(\s*\)|\[\s*\]",
}


def fixed_price(text: Column) -> Column:
    """Whether a price text names one price: no ``od``, ``from`` nor a range."""
    low = F.trim(F.lower(text))
    return ~low.rlike(r"^od(\s|\d)|od |from | - |–")


def completeness(described: Column, timed: Column, fixed: Column, total: Column) -> Column:
    """0 to 15 points by the shares of described, timed and fixed-price offers; halves go to the even number."""
    points = sum((n * w for n, w in zip((described, timed, fixed), COMPLETENESS.values(), strict=True)), F.lit(0.0))
    return F.least(F.lit(15), F.coalesce(F.bround(F.try_divide(points, total)), F.lit(0.0)).cast("int"))


def seo(high: Column, medium: Column, low: Column) -> Column:
    """0 to 10 points; missing keywords cost 2, 1 or a half by volume, and any of them the tenth point."""
    points = F.lit(10.0) - 2 * high - medium - 0.5 * low
    points = F.when((high + medium + low > 0) & (points > 9), F.lit(9.0)).otherwise(points)
    return F.greatest(F.lit(0), F.least(F.lit(10), F.bround(points).cast("int")))


def ux(empty: Column, oversized: Column, undersized: Column, repeated: Column, largest: Column, smallest: Column) -> Column:
    """5 points less one for each fault of a price list's layout, from counts of categories and repeated names."""
    faults = [empty > 0, oversized > 0, undersized > 2, repeated > 0, (smallest > 0) & (largest > 10 * smallest)]
    return sum((-F.coalesce(f, F.lit(False)).cast("int") for f in faults), F.lit(5))


def alias_confidence(family: Column, canonical: Column, alias: Column) -> Column:
    """How sure a hit of an alias is: of a brand's family, specific (compound or long), or generic."""
    specific = canonical.contains("_") | (F.length(alias) >= ALIAS_LENGTH)
    kind = F.when(F.coalesce(family, F.lit("")) != "", "branded").when(specific, "specific").otherwise("generic")
    return F.create_map(*[F.lit(x) for pair in ALIAS_CONFIDENCE.items() for x in pair])[kind]


def neutral_category(name: Column, strong: str, weak: list[str], roots: list[str], domain: str, filler: str) -> Column:
    """``event``, ``service`` or null for the name of a category that says nothing of what is done.

    A strong pattern makes an event, a weak name only if it stands alone. A service root counts if what is left beside
    it names no domain and, without filler words, is one word at most.
    """
    low = F.trim(F.lower(name))
    out = F.when(low.rlike(strong) | low.isin(weak), "event")
    for root in roots:
        rest = F.regexp_replace(low, rf"{root}\w*", " ")
        words = F.filter(F.split(F.regexp_replace(rest, filler, " "), r"\s+"), lambda w: w != "")
        out = out.when(low.contains(root), F.when(~rest.rlike(domain) & (F.size(words) <= 1), "service"))
    return F.when(low != "", out)


def areas_compatible(a: Column, b: Column) -> Column:
    """Areas overlap, or one side names none."""
    return (F.size(a) == 0) | (F.size(b) == 0) | F.arrays_overlap(a, b)


def all_packages(name_is: Column, labels: Column, test) -> Column:
    """A package by its name, or as all labels that are not empty are packages and there is one."""
    named = F.filter(labels, lambda x: F.coalesce(x, F.lit("")) != "")
    return name_is | ((F.size(named) > 0) & F.forall(named, test))


def trigrams(text: Column) -> Column:
    """Distinct trigrams of a text in small letters, with two spaces before each word and one after it."""
    padded = F.concat(F.lit("  "), F.regexp_replace(F.trim(F.lower(text)), r"\s+", "   "), F.lit(" "))
    cut = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substr(padded, i, F.lit(3)))
    return F.array_distinct(F.filter(cut, lambda g: ~g.endswith("  ")))


def promotion(doc: Column, base: Column) -> tuple[Column, Column]:
    """Promotional price in minor units and per cent off, from JSON of three shapes.

    The price is a number or an object with one, at the top or in the first variant that has a promotion; the share
    is the rate, else the amount, else it is computed from the base price.
    """
    at = lambda path: F.get_json_object(doc, path).try_cast("double")
    roots = ("$", "$.promotion", "$.variants[0].promotion")
    positive = lambda c: F.when(c > 0, c)
    price = F.coalesce(*[positive(at(f"{r}.{p}")) for r in roots for p in ("price.price", "price")]) * 100
    rate = F.coalesce(*[positive(at(f"{r}.{p}")) for r in roots for p in ("rate", "discount_amount")])
    computed = F.when(base > 0, (1 - price / base) * 100)
    return F.round(price).cast("long"), F.when(price.isNotNull(), F.bround(F.coalesce(rate, computed)).cast("long"))


def display_rank(bucket: Column, distance: Column, order: list[Column], keys: list[str], most: int = 5) -> Column:
    """Places from 1: of the buckets ``direct`` and ``cluster`` the nearest ``most``, then all others in their order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys)
    shown = bucket.isin("direct", "cluster")
    near = F.row_number().over(w.orderBy(F.when(shown, 0).otherwise(1), distance.asc_nulls_last(), *order))
    first = F.when(shown & (near <= most), near).otherwise(F.lit(most + 1))
    return F.row_number().over(w.orderBy(first, *order))
