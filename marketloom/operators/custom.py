"""Operators that need code on groups or batches of rows: JSON repair and patches, greedy batches, clusters.

Each runs as Arrow batches or on bounded groups inside Spark's tasks; the Python helpers work on one value.
"""

from __future__ import annotations

import json
import re
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- JSON -------------------------------------------------------------------------------------------------


#: A whole or unfinished string, a structural character, or a number or word.
_json_token = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\\?$)|[{}\[\],:]|[^\s{}\[\],:"]+', re.DOTALL)
_closing = {"{": "}", "[": "]"}


def closed(tokens: list[str]) -> str:
    """Tokens as JSON: commas only before a next item, inner brackets closed by an outer one and at the end."""
    out: list[str] = []
    open_: list[str] = []
    comma = False
    for t in tokens:
        if t == ",":
            comma = bool(out) and out[-1] not in "{["
            continue
        if t in ("}", "]"):
            if t not in open_:
                continue
            while (end := open_.pop()) != t:
                out.append(end)
        elif comma:
            out.append(",")
        comma = False
        out.append(t)
        if t in _closing:
            open_.append(_closing[t])
    return "".join(out + open_[::-1])


def repaired(text: str | None) -> str | None:
    """Valid JSON from nearly valid JSON, or None.

    Control characters count as spaces, an unfinished string ends at the end, trailing commas go, open brackets are
    closed. If that is not enough, tokens go from the end until it is: a text cut off after a key loses that key.
    """
    if text is None:
        return None
    tokens = _json_token.findall(re.sub(r"[\x00-\x1f]+", " ", text))
    if tokens and tokens[-1].startswith('"') and not re.fullmatch(r'"(?:[^"\\]|\\.)*"', tokens[-1], re.DOTALL):
        tokens[-1] = tokens[-1].removesuffix("\\") + '"'
    for n in range(len(tokens), max(0, len(tokens) - 8), -1):
        try:
            return json.dumps(json.loads(closed(tokens[:n])), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        except ValueError:
            pass
    return None


@F.pandas_udf(T.StringType())
def json_repair(text: pd.Series) -> pd.Series:
    return text.map(repaired)


def patched(doc: object, ops: list[dict], copy: bool = True) -> object:
    """A document after add, replace and remove operations on JSON pointers; ``doc`` itself is only changed without ``copy``."""
    doc = json.loads(json.dumps(doc)) if copy else doc
    for op in ops:
        path = [p.replace("~1", "/").replace("~0", "~") for p in op["path"].split("/")[1:]]
        if not path:
            doc = op.get("value")
            continue
        at = doc
        for p in path[:-1]:
            at = at[int(p)] if isinstance(at, list) else at[p]
        last = path[-1]
        if isinstance(at, list):
            k = len(at) if last == "-" else int(last)
            if op["op"] == "add":
                at.insert(k, op["value"])
            elif op["op"] == "replace":
                at[k] = op["value"]
            else:
                del at[k]
        elif op["op"] == "remove":
            del at[last]
        else:
            at[last] = op["value"]
    return doc


@F.pandas_udf(T.StringType())
def json_patch(doc: pd.Series, ops: pd.Series) -> pd.Series:
    """Patched documents; null where the document or the operations are null, or a path leads nowhere."""

    def one(d: str | None, o: str | None) -> str | None:
        if d is None or o is None:
            return None
        try:
            return json.dumps(patched(json.loads(d), json.loads(o)), sort_keys=True)
        except (LookupError, TypeError, ValueError):
            return None

    return pd.Series([one(d, o) for d, o in zip(doc, ops, strict=True)], dtype=object)


# --- greedy batches ---------------------------------------------------------------------------------------


def greedy_batches(df: DataFrame, key: str, order: str, weight: str, budget: int, items: int) -> DataFrame:
    """``batch`` numbers: consecutive rows of a key until the next would pass the budget or the number of items.

    Rows stream by in order within a sorted partition, so a key of any length needs constant memory. Each batch
    depends on the one before it, so the rows of one key pass one task: keys bound how far this spreads.
    """
    schema = f"{key} {dict(df.dtypes)[key]}, {order} {dict(df.dtypes)[order]}, {weight} {dict(df.dtypes)[weight]}, batch long"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, batch, used, n = object(), 0, 0, 0
        for f in frames:
            out = []
            for k, w in zip(f[key], f[weight], strict=True):
                if k != now:
                    now, batch, used, n = k, 0, 0, 0
                elif used + w > budget or n >= items:
                    batch, used, n = batch + 1, 0, 0
                used, n = used + w, n + 1
                out.append(batch)
            yield f.assign(batch=np.array(out, np.int64))

    return df.select(key, order, weight).repartition(key).sortWithinPartitions(key, order).mapInPandas(run, schema)


# --- clusters ---------------------------------------------------------------------------------------------


def checkpoints(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; only a single-JVM session may leave it unset."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="marketloom-"))


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``id, component`` from undirected edges ``a, b``: the smallest label travels along edges, and labels take
    their label's label, so that long chains halve in each round. Rounds are checkpointed in the shared folder."""
    checkpoints(edges.sparkSession)
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().checkpoint()
    labels = both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("component")).checkpoint()
    for _ in range(rounds):
        near = both.join(labels.select(F.col("id").alias("b"), F.col("component").alias("c")), "b").groupBy("a").agg(F.min("c").alias("c"))
        step = labels.join(near, labels["id"] == near["a"]).select("id", F.least("component", "c").alias("component"))
        up = step.select(F.col("id").alias("component"), F.col("component").alias("top"))
        new = step.join(up, "component").select("id", "top").withColumnRenamed("top", "component").checkpoint()
        moved = new.join(labels.withColumnRenamed("component", "old"), "id").filter("component <> old").limit(1).count()
        labels = new
        if not moved:
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def close_names(df: DataFrame, key: str, id_: str, name: Column, least: int = 8, most: int = 2) -> DataFrame:
    """Edges ``a, b`` between names of one key within an edit distance: they share a deletion variant of the name.

    Names within two edits of each other share a string with at most two letters left out, so pairs meet by an
    equi-join on such strings, and the distance decides.
    """
    rows = df.select(key, F.col(id_).alias("id"), name.alias("name")).filter(F.length("name") >= least)
    n = F.length("name")
    one = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substr("name", F.lit(1), i - 1), F.substr("name", i + 1, n)))
    two = F.flatten(F.transform(one, lambda s: F.transform(F.sequence(F.lit(1), F.length(s)), lambda i: F.concat(F.substr(s, F.lit(1), i - 1), F.substr(s, i + 1, F.length(s))))))
    variants = rows.select(key, "id", "name", F.explode(F.array_distinct(F.concat(F.array("name"), one, two))).alias("v"))
    other = variants.select(key, "v", F.col("id").alias("b"), F.col("name").alias("other"))
    pairs = variants.join(other, [key, "v"]).filter(F.col("id") < F.col("b")).select(F.col("id").alias("a"), "b", "name", "other").distinct()
    return pairs.filter(F.levenshtein("name", "other", most) >= 0).select("a", "b")
