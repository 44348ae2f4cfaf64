"""Column builders: text folds, parsers, similarities, percentiles and classifiers. No Python runs on rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTS = "ąćęłńóśźżĄĆĘŁŃÓŚŹŻáàâäãåéèêëíìîïòôöõúùûüçñÁÀÂÄÉÈÊËÍÌÎÏÒÔÖÚÙÛÜÇÑ"
PLAIN = "acelnoszzACELNOSZZaaaaaaeeeeiiiioooouuuucnAAAAEEEEIIIIOOOUUUUCN"


# --- text -------------------------------------------------------------------------------------------------


def fold(text: Column) -> Column:
    """Lower case without accents, ``ł`` included."""
    return F.lower(F.translate(text, ACCENTS, PLAIN))


def fold_words(text: Column) -> Column:
    """Folded text whose runs of other characters than letters and digits are one space."""
    return F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " "))


def lookup_key(text: Column) -> Column:
    """Lower-case name before the first `` | ``, without quotes around it."""
    return F.trim(F.lower(F.btrim(F.trim(F.element_at(F.split(text, r" \| "), 1)), F.lit("\"'"))))


def strip_ordinal(text: Column) -> Column:
    """A name without a leading ordinal such as ``3. ``."""
    return F.regexp_replace(text, r"^\s*\d+[.)]\s*", "")


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def word_set(text: Column) -> Column:
    """Distinct folded words of over one letter."""
    return F.array_sort(F.array_distinct(F.filter(F.split(fold_words(text), " "), lambda w: F.length(w) > 1)))


def jaccard(a: Column, b: Column) -> Column:
    """Size of the intersection over that of the union; two empty sets are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_share(a: Column, b: Column) -> Column:
    """Part of ``a`` that ``b`` has too; 0 for an empty ``a``."""
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def overlap_min(a: Column, b: Column) -> Column:
    """Common elements over the smaller set; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / least)


def price_minor(text: Column) -> Column:
    """Minor units of a price text such as ``2 200,00 zł+``; null if it has no number."""
    number = F.regexp_extract(F.regexp_replace(text, r"[\s ]", ""), r"(\d+(?:[.,]\d{1,2})?)", 1)
    return F.round(F.regexp_replace(number, ",", ".").try_cast("decimal(18,2)") * 100).cast("long")


def size_mb(text: Column) -> Column:
    """Megabytes of ``12 kB``, ``1234 MB`` or ``5 GB``."""
    number = F.regexp_extract(text, r"([\d.]+)", 1).try_cast("double")
    unit = F.upper(F.regexp_extract(text, r"([kKmMgGtT])[bB]", 1))
    factor = F.when(unit == "K", 1 / 1024).when(unit == "M", 1.0).when(unit == "G", 1024.0).when(unit == "T", 1048576.0)
    return number * factor


def postcode(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d{2}-\d{3})", 1), F.lit(""))


def emails(text: Column) -> Column:
    """Distinct lower-case e-mail addresses of a page, ``mailto:`` ones first."""
    address = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
    first = F.regexp_extract_all(text, F.lit(f"mailto:({address})"), F.lit(1))
    return F.array_distinct(F.transform(F.concat(first, F.regexp_extract_all(text, F.lit(f"({address})"), F.lit(1))), F.lower))


def is_package(name: Column) -> Column:
    """Names that sell several at once: ``3x``, ``x5``, ``5+1``, or a word for it."""
    return F.coalesce(name.rlike(r"(?iU)\b\d+\s*x\b|\bx\s*\d+\b|\b\d+\s*\+\s*\d+\b|\b(pakiet|karnet|seria|package|series|set)\b"), F.lit(False))


def parameter(name: Column, unit: str) -> Column:
    """The number before a unit in a name, comma or point."""
    return F.regexp_replace(F.regexp_extract(name, rf"(?i)(\d+(?:[.,]\d+)?)\s*{unit}\b", 1), ",", ".").try_cast("double")


def volume_range(name: Column) -> Column:
    """``2:1`` and ``2D`` are [2, 2]; ``3/4D`` and ``3-4D`` are [3, 4]."""
    both = F.regexp_extract(name, r"(?i)(\d+)\s*[/-]\s*(\d+)\s*D\b", 1)
    upper = F.regexp_extract(name, r"(?i)(\d+)\s*[/-]\s*(\d+)\s*D\b", 2)
    one = F.coalesce(
        F.nullif(F.regexp_extract(name, r"(?i)\b(\d+)\s*D\b", 1), F.lit("")),
        F.nullif(F.regexp_extract(name, r"\b(\d+)\s*:\s*1\b", 1), F.lit("")),
    )
    return F.when(both != "", F.array(both.cast("int"), upper.cast("int"))).when(one.isNotNull(), F.array(one.cast("int"), one.cast("int")))


def markers(text: Column, lexicon: dict[str, str]) -> Column:
    """Sorted names of a lexicon {name: regular expression} whose expression occurs in the folded text."""
    folded = fold(text)
    return F.array_sort(F.array_compact(F.array(*[F.when(folded.rlike(rx), F.lit(name)) for name, rx in lexicon.items()])))


def first_marker(text: Column, lexicon: dict[str, str]) -> Column:
    folded = fold(text)
    return F.coalesce(*[F.when(folded.rlike(rx), F.lit(name)) for name, rx in lexicon.items()], F.lit(None).cast("string"))


def tolerant_bool(text: Column) -> Column:
    """``1/yes/true`` and ``0/no/false``; null otherwise."""
    low = F.lower(F.trim(text))
    return F.when(low.isin("1", "yes", "true"), True).when(low.isin("0", "no", "false"), False)


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


# --- numbers, vectors, space ------------------------------------------------------------------------------


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def ratio_similarity(a: Column, b: Column) -> Column:
    """Smaller over larger; 0 if either is not positive."""
    return F.when((a <= 0) | (b <= 0), F.lit(0.0)).otherwise(F.least(a, b) / F.greatest(a, b))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def haversine_m(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance in metres on a sphere of 6371 km."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(F.radians(lng2 - lng1) / 2), 2
    )
    return F.lit(2 * 6371000.0) * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


# --- percentiles and ranks: each is an operator of its own ------------------------------------------------


def pct_linear(value: Column, p: float) -> Column:
    """Linear interpolation; an empty group gives 0."""
    return F.coalesce(F.percentile(value, F.lit(p)), F.lit(0.0))


def pct_rounded(value: Column, p: float) -> Column:
    """Linear interpolation, rounded half to even."""
    return F.bround(F.percentile(value, F.lit(p))).cast("long")


def median_low(value: Column) -> Column:
    """The lower of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value._jc.toString()})")


def upper_position():
    """Position from 0 of the upper of the two middle ones among ``n`` sorted values."""
    return lambda n: F.floor(n / 2)


def floor_position(p: float):
    """Position ``floor(p * (n - 1))`` from 0 among ``n`` sorted values."""
    return lambda n: F.floor(F.lit(p) * (n - 1))


def rank_linear_map(x: Column, p25: Column, p75: Column) -> Column:
    """p25 maps to 25 and p75 to 75, clamped to 0..100; null if p75 is not above p25."""
    return F.when(p75 > p25, F.greatest(F.lit(0.0), F.least(F.lit(100.0), 25 + 50 * (x - p25) / (p75 - p25))))


# --- classifiers ------------------------------------------------------------------------------------------


def action_a(deviation: Column) -> Column:
    return F.when(deviation < -15, "raise").when(deviation > 20, "lower").otherwise("hold")


def action_b(deviation: Column) -> Column:
    return F.when(F.abs(deviation) < 10, "hold").when(deviation < 0, "raise").otherwise("lower")


def action_c(deviation: Column) -> Column:
    return F.when(deviation.isNull() | (F.abs(deviation) <= 8), "hold").when(deviation < 0, "raise").otherwise("lower")


def duration_bucket(minutes: Column) -> Column:
    return F.when(minutes.isNull(), "unknown").when(minutes <= 30, "short").when(minutes <= 90, "medium").otherwise("long")


def severity(change_pct: Column) -> Column:
    """Of a price change: a rise of over 20 % is critical, 5 % either way a warning."""
    return F.when(change_pct > 20, "critical").when(F.abs(change_pct) >= 5, "warning").otherwise("info")


def extreme_flag(status: Column, deviation: Column, open_statuses: list[str]) -> Column:
    return F.when(status.isin(open_statuses) & (F.abs(deviation) > 150), "extreme_outlier").otherwise(status)


#: Shown statuses that an extreme deviation turns over.
OPEN_STATUSES = ["verified", "method_targeted", "structured_direct"]


def verify_status(package: Column, similarity: Column, duration_ratio: Column, deviation: Column) -> Column:
    """The first gate that stops an offer. Without any deviation it is verified unseen; one that passes all gates and still
    deviates is flagged as an outlier. A gate whose input is unknown does not stop it."""
    return (
        F.when(deviation == 0, "verified")
        .when(package, "package_mismatch")
        .when(similarity < 0.80, "low_name_similarity")
        .when(duration_ratio > 2, "duration_mismatch")
        .otherwise("extreme_outlier")
    )


def package_verdict(saving_pct: Column) -> Column:
    return F.when(saving_pct >= 5, "fair").when(saving_pct <= -50, "no_match").when(saving_pct <= -5, "overpriced").otherwise("fake")


def distance_penalty(km: Column) -> Column:
    return 2 * F.greatest(F.lit(0.0), km - 5)


def composite_v1(match: Column, jac: Column, overlap: Column, ratio: Column, km: Column) -> Column:
    return 30 * match + 20 * jac + 25 * overlap + 10 * ratio - distance_penalty(km)


def composite_v2(tid: Column, profile: Column, variant: Column, embedding: Column, reviews: Column, km: Column) -> Column:
    return 30 * tid + 25 * profile + 20 * variant + 20 * embedding + 10 * reviews - distance_penalty(km)


#: Fixed values of the older rival bucket: reviews, score of a direct rival, score of a cluster, lead in review rank.
BUCKET_V1 = {"few": 20, "direct": 70, "cluster": 40, "lead": 0.3}


def bucket_v1(score: Column, reviews: Column, rank: Column, own_rank: Column) -> Column:
    """Rivals with few reviews are new; then the score decides, then a lead in review rank; null for the rest."""
    v = BUCKET_V1
    by_score = F.when(score >= v["direct"], "direct").when(score >= v["cluster"], "cluster")
    return F.when(reviews < v["few"], "new").otherwise(F.coalesce(by_score, F.when(rank >= own_rank + v["lead"], "aspirational")))


#: Fixed values of the rival bucket: few reviews; (focus or profile) and embedding of a direct rival; focus or profile of a
#: cluster rival; lead in review rank and embedding of an aspirational one.
BUCKET_V2 = {"few": 20, "direct": (0.25, 0.7, 0.85), "cluster": (0.12, 0.4), "aspirational": (0.3, 0.70)}


def bucket_v2(reviews: Column, focus: Column, profile: Column, embedding: Column, rank: Column, own_rank: Column) -> Column:
    """Rivals with few reviews are new; then likeness of focus or profile decides, then a lead in review rank; null for the rest."""
    v = BUCKET_V2
    near = lambda f, p: (focus >= f) | (profile >= p)
    return (
        F.when(reviews < v["few"], "new")
        .when(near(*v["direct"][:2]) & (embedding >= v["direct"][2]), "direct")
        .when(near(*v["cluster"]), "cluster")
        .when((rank >= own_rank + v["aspirational"][0]) & (embedding >= v["aspirational"][1]), "aspirational")
    )


def sufficiency(entities: Column) -> Column:
    return F.when(entities >= 5, "full").when(entities >= 3, "thin").otherwise("insufficient")


def confidence(entities: Column) -> Column:
    return F.least(F.lit(1.0), entities / 5)


#: The cap of an audit score by its worst issues, and the ceiling of all.
SCORE_CAPS = {"criticals": (3, 60), "critical": (1, 75), "major": (1, 85), "any": (1, 95), "ceiling": 88}


def score_cap(score: Column, critical: Column, major: Column, issues: Column) -> Column:
    """An audit score under the cap that its numbers of critical, major and all issues set, and under the ceiling."""
    caps = [F.when(n >= SCORE_CAPS[k][0], SCORE_CAPS[k][1]) for k, n in (("criticals", critical), ("critical", critical), ("major", major), ("any", issues))]
    return F.least(score, F.coalesce(*caps, F.lit(SCORE_CAPS["ceiling"])), F.lit(SCORE_CAPS["ceiling"]))


def schedule_next(at: Column, tier: Column) -> Column:
    """Next due time: 7, 14 or 30 days after ``at`` for tiers 1, 2 and 3."""
    days = F.when(tier == 1, 7).when(tier == 2, 14).otherwise(30)
    return F.timestamp_add("DAY", days, at)
