"""The k nearest places of every place, whatever the density.

Points of one position are one place with a bounded list of ids. Places lie in a tree of cells that halve from level to level; a cell with
more than a few places is divided. Subjects and cells of points meet level by level: from cells as large as the radius down, a
cell stays with a subject only while it may hold one of its k nearest, which the counts and bounds of all cells met so far
prove. What remains are a few leaves, so the points that a subject meets depend on k, not on how dense the place is.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketloom.functions import exprs as X
from marketloom.operators.relational import top_k
from marketloom.operators.staging import staged

EARTH_M = 6371000.0
#: Added to bounds in metres: distances are ranked by thousandths of a metre, and sums of floats differ in their last digits.
SLACK_M = 0.01


def places(points: DataFrame, k: int) -> DataFrame:
    """``lat, lng, n, ids``: distinct positions of ``(id, lat, lng)`` rows, how many of the k smallest ids each has, and these.

    A position that many rows share is reduced within tasks first. Rows without a position are left out.
    """
    known = points.filter("lat IS NOT NULL AND lng IS NOT NULL").select("id", F.col("lat").cast("double").alias("lat"), F.col("lng").cast("double").alias("lng"))
    few = top_k(known, ["lat", "lng"], [F.col("id")], k)
    return few.groupBy("lat", "lng").agg(F.count("*").alias("n"), F.array_sort(F.collect_list("id")).alias("ids"))


#: Levels that are planned together before what is left is staged.
STAGED = 3
#: Levels below the cells of the size of the radius; a cell of the last is a leaf whatever it holds.
DEEPEST = 14


def levels_of(at: DataFrame, high: float, wide: float) -> DataFrame:
    """Each place once a level, with the row and column of its cell there."""
    finest = at.withColumns({c: F.floor(F.col(x) / (size / 2**DEEPEST)) for x, size, c in (("lat", high, "_fy"), ("lng", wide, "_fx"))})
    levels = finest.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(DEEPEST))))
    return levels.withColumns({c: F.expr(f"shiftright({f}, {DEEPEST} - level)") for f, c in (("_fy", "cy"), ("_fx", "cx"))}).drop("_fy", "_fx")


def tree(at: DataFrame, high: float, wide: float, leaf: int) -> DataFrame:
    """``level, cy, cx, n, is_leaf`` and bounds ``lat0, lat1, ...``: cells of all levels that a division reaches, by what they hold.

    Cells of all levels are counted in one aggregation; a cell belongs to the tree if the one above it was divided.
    """
    placed = levels_of(at, high, wide).withColumn("cos", F.cos(F.radians("lat")))
    cells = placed.groupBy("level", "cy", "cx").agg(
        F.count("*").alias("places"), F.sum("n").alias("n"), *[f(x).alias(f"{x}{i}") for x in ("lat", "lng", "cos") for i, f in enumerate((F.min, F.max))]
    )
    divided = (F.col("places") > leaf) & (F.col("level") < DEEPEST)
    above = cells.filter(divided).select(F.col("level") + 1, "cy", "cx").toDF("level", "py", "px")
    marked = cells.withColumn("is_leaf", ~divided).withColumns({f"p{c}": F.shiftright(f"c{c}", 1) for c in "yx"})
    below = marked.join(above, ["level", "py", "px"], "left_semi")
    return marked.filter("level = 0").unionByName(below).drop("py", "px")


def bounds(df: DataFrame, radius_m: float) -> DataFrame:
    """``_near`` and ``_far``: between these lie the distances of a point ``a`` to all points of a box ``b``, in metres.

    On a plane with the box's least and greatest cosine of latitude; what a sphere differs from it within cells of the size of
    the radius is added as a share of the distance.
    """
    rad = math.pi / 180
    off = (12 * radius_m / EARTH_M) ** 2

    def planar(lat: Column, lng: Column, cos: str, share: float) -> Column:
        return EARTH_M * rad * (1 + share) * F.sqrt(lat * lat + F.cos(F.col("a_lat") * rad) * F.col(cos) * lng * lng)

    sides = {x: (F.col(f"a_{x}") - F.col(f"b_{x}0"), F.col(f"b_{x}1") - F.col(f"a_{x}")) for x in ("lat", "lng")}
    near = [F.greatest(F.lit(0.0), -below, -above) for below, above in sides.values()]
    far = [F.greatest(below, above) for below, above in sides.values()]
    return df.withColumns({"_near": planar(*near, "b_cos0", -off), "_far": planar(*far, "b_cos1", off)})


def leaf_pairs(subjects: DataFrame, points: DataFrame, k: int, radius_m: float, high: float, wide: float) -> DataFrame:
    """``a_lat, a_lng, b_level, b_cy, b_cx``: the leaves that may hold one of the k nearest of each position of ``subjects``.

    ``points`` is a tree. The work of a level is the pairs that are left; every few levels they are staged, so that plans stay short.
    """
    box = [f"{x}{i}" for x in ("lat", "lng", "cos") for i in (0, 1)]
    key = ["a_lat", "a_lng"]
    a = subjects.select(F.col("lat").alias("a_lat"), F.col("lng").alias("a_lng"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("y"), F.lit(j).alias("x")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    home = a.withColumn("_d", steps).withColumns({f"_{c}": F.floor(F.col(f"a_{x}") / size) + F.col(f"_d.{c}") for c, x, size in (("y", "lat", high), ("x", "lng", wide))}).drop("_d")
    nodes = points.select(*[F.col(c).alias(f"b_{c}") for c in ("level", "cy", "cx", "n", "is_leaf", *box)])
    met = home.join(nodes.filter("b_level = 0"), (F.col("_y") == F.col("b_cy")) & (F.col("_x") == F.col("b_cx"))).drop("_y", "_x")
    # What a cell is replaced by on the next level: a leaf by itself, a divided cell by the four below it.
    itself = nodes.filter("b_is_leaf").withColumns({"_l": F.col("b_level"), "_y": F.col("b_cy"), "_x": F.col("b_cx")})
    below = nodes.filter("b_level > 0").withColumns({"_l": F.col("b_level") - 1, "_y": F.shiftright("b_cy", 1), "_x": F.shiftright("b_cx", 1)})
    after = itself.unionByName(below)
    depth = points.agg(F.max("level")).first()[0] or 0
    for level in range(depth + 1):
        met = bounds(met, radius_m).filter(F.col("_near") <= radius_m + SLACK_M)
        # The bound of a subject: within it, whole cells hold at least k points besides the subject itself.
        run = Window.partitionBy(*key).orderBy("_far")
        met = met.withColumn("_sum", F.sum("b_n").over(run.rangeBetween(Window.unboundedPreceding, 0)))
        limit = F.min(F.when(F.col("_sum") >= k + 1, F.col("_far"))).over(Window.partitionBy(*key))
        met = met.withColumn("_limit", limit).filter(F.col("_limit").isNull() | (F.col("_near") <= F.col("_limit") + SLACK_M))
        if level < depth:
            kept = met.select(*key, *[F.col(f"b_{c}").alias(f"_{c[-1]}") for c in ("level", "cy", "cx")])
            met = kept.join(after, ["_l", "_y", "_x"]).drop("_l", "_y", "_x")
            if level % STAGED == STAGED - 1:
                met = staged(met, "frontier")
    return met.select(*key, "b_level", "b_cy", "b_cx")


def in_leaves(at: DataFrame, nodes: DataFrame, high: float, wide: float) -> DataFrame:
    """``b_level, b_cy, b_cx, b_lat, b_lng, b_ids``: places with the leaf that holds them."""
    leaves = nodes.filter("is_leaf").select("level", "cy", "cx")
    found = levels_of(at, high, wide).join(leaves, ["level", "cy", "cx"])
    return found.select(*[F.col(c).alias(f"b_{c}") for c in ("level", "cy", "cx", "lat", "lng", "ids")])


def nearest_places(subjects: DataFrame, points: DataFrame, k: int, radius_m: float, leaf: int | None = None, met: bool = False) -> DataFrame:
    """``a_id, b_id, distance_m, place``: of every subject ``(id, lat, lng)`` its k nearest points within a radius, others than itself, by
    distance (in thousandths of a metre) and id.

    Subjects and points of one position share their work. Places that many rows share count with their k + 1 smallest ids, as
    no more can be among the k nearest. Latitudes beyond 75 degrees and pairs across the 180th meridian are not met.
    ``met`` returns the pairs of positions compared instead, to measure the work.
    """
    high = radius_m / 111_000.0
    wide = high / math.cos(math.radians(75))
    at = staged(places(points, k + 1), "places")
    nodes = staged(tree(at, high, wide, leaf or 2 * k), "tree")
    own = at if subjects is points else places(subjects, 1)
    leaves = leaf_pairs(own, nodes, k, radius_m, high, wide)
    b = in_leaves(at, nodes, high, wide)
    pairs = leaves.join(b, ["b_level", "b_cy", "b_cx"]).select("a_lat", "a_lng", "b_lat", "b_lng", "b_ids")
    if met:
        return pairs.select("a_lat", "a_lng", F.size("b_ids").alias("n"))
    exact = F.round(X.haversine_m(F.col("a_lat"), F.col("a_lng"), F.col("b_lat"), F.col("b_lng")), 3)
    near = pairs.withColumn("distance_m", exact).filter(F.col("distance_m") <= radius_m)
    one = near.select("a_lat", "a_lng", "distance_m", F.explode("b_ids").alias("b_id"))
    few = top_k(one, ["a_lat", "a_lng"], [F.col("distance_m"), F.col("b_id")], k + 1)
    who = subjects.select(F.col("id").alias("a_id"), F.col("lat").cast("double").alias("a_lat"), F.col("lng").cast("double").alias("a_lng"))
    each = who.join(few, ["a_lat", "a_lng"]).filter("a_id <> b_id")
    return top_k(each, ["a_id"], [F.col("distance_m"), F.col("b_id")], k, "place").select("a_id", "b_id", "distance_m", "place")
