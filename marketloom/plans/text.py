"""Queries on text and JSON: folds, markers, parsers, distances and alias matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.functions.exprs import ACCENTS, PLAIN
from marketloom.operators import decisions as D
from marketloom.operators import relational as R
from marketloom.plans.vectors import CENTRES
from marketloom.sources.tables import events, table, vectors

#: A small lexicon of markers and aliases over the driver's part names.
ALIASES = ["ring", "bolt", "widget", "gear", "gizmo", "small", "blue", "absent"]
LEXICON = {"a": "a", "number": r"\d", "part": "part", "seven": "7"}


def alias_match(s, d):
    """Parts whose name holds an alias token: tokens meet aliases by an equi-join, not by one expression an alias."""
    parts = table(s, d, "part").select("p_partkey", F.explode(F.array_distinct(F.split(X.fold_words(F.col("p_name")), " "))).alias("token"))
    token = F.get(F.array(*map(F.lit, ALIASES)), F.pmod("n_nationkey", F.lit(len(ALIASES))))
    aliases = table(s, d, "nation").select(token.alias("token"), F.col("n_name").alias("method"))
    return parts.join(aliases, "token").groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("method")), ",").alias("methods"))


#: The driver's vectors are random, so its thresholds are below the operator's own.
SURE, CANDIDATE = 0.3, 0.15


def cascade(s, d):
    """Parts by a cache, an alias, or the nearest of the labels' mean vectors to the vector of the part's number."""
    p = table(s, d, "part").select("p_partkey", (F.col("p_partkey") % 500).alias("vid"))
    cache = p.filter("p_partkey % 10 = 0").select("p_partkey", F.lit("cached").alias("label"))
    alias = alias_match(s, d).select("p_partkey", F.col("methods").alias("label"))
    v = vectors(s, d)
    near = R.nearest_centroid(v, R.centroids(v, "label", F.lit(1.0)), "label", 5).select(F.col("id").alias("vid"), F.col("centre").alias("label"), "similarity")
    return D.cascade(p, cache, alias, near, "p_partkey", "vid", SURE, CANDIDATE)


QUERIES = {
    "json_extract": lambda s, d: events(s, d).select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")),
    "text_fold": lambda s, d: table(s, d, "documents").select("doc_id", F.sha2(X.fold(F.col("text")), 256).alias("folded_sha256"), F.length(X.fold(F.col("text"))).alias("n_chars")),
    "text_fold_whole": lambda s, d: table(s, d, "documents").select("doc_id", X.fold(F.col("text")).alias("folded")),
    "fold_words": lambda s, d: table(s, d, "benchmark").select("item_id", X.fold_words(F.col("text")).alias("folded")),
    "marker_extract": lambda s, d: table(s, d, "part").select("p_partkey", F.array_join(X.markers(F.col("p_name"), LEXICON), ",").alias("markers"), X.first_marker(F.col("p_type"), {"s": "s", "e": "e"}).alias("first")),
    "marker_clusters": lambda s, d: table(s, d, "part").groupBy(F.array_join(X.markers(F.col("p_name"), LEXICON), ",").alias("markers"), "p_brand").agg(F.count("*").alias("n"), F.count_distinct("p_type").alias("types")).filter("n >= 2 AND types >= 2"),
    "price_text_parse": lambda s, d: table(s, d, "part").select("p_partkey", X.price_minor(F.concat(F.regexp_replace(F.format_string("%.2f", "p_retailprice"), r"\.", ","), F.lit(" zł+"))).alias("price")),
    "word_jaccard": lambda s, d: table(s, d, "part").select("p_partkey", F.round(X.jaccard(X.word_set(F.col("p_name")), X.word_set(F.col("p_type"))), 4).alias("jaccard")),
    "edit_distance": lambda s, d: table(s, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance")),
    "email_extract": lambda s, d: table(s, d, "pages").select("page_id", F.array_join(F.array_sort(X.emails(F.col("html"))), ",").alias("emails")),
    "package_names": lambda s, d: table(s, d, "documents").select("doc_id", F.coalesce(F.col("text").rlike(r"\b\d+x\b"), F.lit(False)).alias("package")),
    "alias_match": alias_match,
    "classifier_cascade": cascade,
    "content_quality": lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.round(100.0 * F.count_if(F.length("text") >= 300) / F.count("*"), 2).alias("long_pct"), F.max(F.length("text")).alias("longest")),
    "condensed_list": lambda s, d: R.top_k(table(s, d, "part"), ["p_brand"], [F.col("p_partkey")], 5).groupBy("p_brand").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]), "; ").alias("names")),
}

_fold = f"lower(translate({{c}}, '{ACCENTS}', '{PLAIN}'))"
_words = f"trim(regexp_replace({_fold}, '[^a-z0-9]+', ' ', 'g'))"
_set = f"list_distinct(list_filter(string_split({_words}, ' '), lambda w: len(w) > 1))"
_markers = "concat_ws(',', " + ", ".join(f"CASE WHEN regexp_matches({_fold.format(c='p_name')}, '{rx}') THEN '{k}' END" for k, rx in sorted(LEXICON.items())) + ")"
_alias = f"""t AS (SELECT DISTINCT p_partkey, unnest(string_split({_words.format(c='p_name')}, ' ')) AS token FROM part),
m AS (SELECT p_partkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS methods FROM t JOIN nation ON token = {ALIASES}[n_nationkey % {len(ALIASES)} + 1] GROUP BY 1)"""
ORACLES = {
    "json_extract": "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
    "text_fold": f"SELECT doc_id, sha256(folded) AS folded_sha256, length(folded) AS n_chars FROM (SELECT doc_id, {_fold.format(c='text')} AS folded FROM documents)",
    "text_fold_whole": f"SELECT doc_id, {_fold.format(c='text')} AS folded FROM documents",
    "fold_words": f"SELECT item_id, {_words.format(c='text')} AS folded FROM benchmark",
    "marker_extract": f"SELECT p_partkey, {_markers} AS markers, CASE WHEN regexp_matches(lower(p_type), 's') THEN 's' WHEN regexp_matches(lower(p_type), 'e') THEN 'e' END AS first FROM part",
    "marker_clusters": f"SELECT {_markers} AS markers, p_brand, count(*) AS n, count(DISTINCT p_type) AS types FROM part GROUP BY 1, 2 HAVING count(*) >= 2 AND count(DISTINCT p_type) >= 2",
    "price_text_parse": "SELECT p_partkey, CAST(round(CAST(format('{:.2f}', p_retailprice) AS DECIMAL(18,2)) * 100) AS BIGINT) AS price FROM part",
    "word_jaccard": f"""WITH s AS (SELECT p_partkey, {_set.format(c='p_name')} AS a, {_set.format(c='p_type')} AS b FROM part)
      SELECT p_partkey, CASE WHEN len(a) + len(b) = 0 THEN 1.0 ELSE round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 4) END AS jaccard FROM s""",
    "edit_distance": "SELECT p_partkey, CAST(levenshtein(p_name, p_type) AS INTEGER) AS distance FROM part",
    "email_extract": "SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}'), lambda x: lower(x)))), ',') AS emails FROM pages",
    "package_names": "SELECT doc_id, coalesce(regexp_matches(text, '\\b\\d+x\\b'), false) AS package FROM documents",
    "alias_match": f"WITH {_alias} SELECT * FROM m",
    "classifier_cascade": f"""WITH {_alias}, {CENTRES}, k AS (SELECT * FROM q WHERE similarity >= {CANDIDATE} QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, centre) <= 5),
      n AS (SELECT id, max(similarity) AS best, arg_min(CAST(centre AS VARCHAR), (-similarity, centre)) AS label, string_agg(CAST(centre AS VARCHAR), ',' ORDER BY similarity DESC, CAST(centre AS VARCHAR)) AS candidates FROM k GROUP BY 1)
      SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'cached' WHEN methods IS NOT NULL THEN methods WHEN best >= {SURE} THEN label END AS label,
      CASE WHEN p_partkey % 10 = 0 THEN 'cache' WHEN methods IS NOT NULL THEN 'alias' WHEN best >= {SURE} THEN 'vector' ELSE 'none' END AS classifier,
      CASE WHEN p_partkey % 10 <> 0 AND methods IS NULL THEN candidates END AS candidates FROM part LEFT JOIN m USING (p_partkey) LEFT JOIN n ON n.id = p_partkey % 500""",
    "content_quality": "SELECT source, count(*) AS n, round(100.0 * count(*) FILTER (length(text) >= 300) / count(*), 2) AS long_pct, CAST(max(length(text)) AS INTEGER) AS longest FROM documents GROUP BY 1",
    "condensed_list": "SELECT p_brand, string_agg(p_name, '; ' ORDER BY p_partkey) AS names FROM (SELECT * FROM part QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 5) GROUP BY 1",
}
