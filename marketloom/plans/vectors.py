"""Queries on vectors: neighbours, peers and centroids."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from marketloom.operators import relational as R
from marketloom.operators import vector_index as VI
from marketloom.operators.blocks import nearest_within
from marketloom.operators.staging import shared_dir
from marketloom.sources.tables import vectors

VECTORS = "v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label, vec_id % 50 AS entity FROM embeddings)"
COS = "round(list_cosine_similarity({a}.vector, {b}.vector), 4)"


def peer_max(s, d):
    """Each vector's greatest similarity to another one of its label."""
    v = vectors(s, d)
    return nearest_within(v, v, "label", 1).select(F.col("subject_id").alias("id"), F.col("similarity").alias("peer_max_sim"))


def weighted(s, d):
    c = R.centroids(vectors(s, d), "label", 1 + F.pmod(F.col("id"), F.lit(3)))
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", "dim", F.round("x", 4).alias("x"))


def nearest(s, d):
    v = vectors(s, d)
    return R.nearest_centroid(v, R.centroids(v, "label", F.lit(1.0)), "label")


def indexed(s, d):
    """Every fiftieth vector's five nearest of all, from an index that is written and searched until its bounds prove them."""
    v = vectors(s, d)
    path = f"{shared_dir(s)}/vectors-{uuid.uuid4().hex[:12]}"
    VI.build(v, path, size=128, most=512)
    return VI.search(s, v.filter("id % 50 = 0"), path, 5)


_sums = "p_ AS (SELECT label, unnest(vector) AS x, generate_subscripts(vector, 1) - 1 AS dim, {w} AS w FROM v), m_ AS (SELECT label, dim, sum(w * x) / sum(w) AS x FROM p_ GROUP BY 1, 2)"
CENTRES = f"""{VECTORS}, {_sums.format(w='1.0')}, c AS (SELECT label AS centre, list(x ORDER BY dim) AS vector FROM m_ GROUP BY 1),
      q AS (SELECT v.id, c.centre, {COS.format(a='v', b='c')} AS similarity FROM v, c)"""

QUERIES = {
    "cosine_topk": lambda s, d: nearest_within(vectors(s, d), vectors(s, d), "entity", 5),
    "indexed_topk": indexed,
    "peer_max_sim": peer_max,
    "weighted_centroid": weighted,
    "nearest_centroid": nearest,
}

ORACLES = {
    "cosine_topk": f"""WITH {VECTORS}, p AS (SELECT a.id AS subject_id, b.id, {COS.format(a='a', b='b')} AS similarity FROM v a JOIN v b ON a.entity = b.entity AND a.id <> b.id)
      SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY similarity DESC, id) <= 5""",
    "indexed_topk": f"""WITH {VECTORS}, p AS (SELECT a.id AS subject_id, b.id, {COS.format(a='a', b='b')} AS similarity FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0)
      SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY similarity DESC, id) <= 5""",
    "peer_max_sim": f"WITH {VECTORS} SELECT a.id, max({COS.format(a='a', b='b')}) AS peer_max_sim FROM v a JOIN v b ON a.label = b.label AND a.id <> b.id GROUP BY 1",
    "weighted_centroid": f"WITH {VECTORS}, {_sums.format(w='1 + id % 3')} SELECT label, CAST(dim AS INTEGER) AS dim, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 4) AS x FROM m_",
    "nearest_centroid": f"WITH {CENTRES} SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY id ORDER BY similarity DESC, centre) = 1",
}
