"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import Scratch


#: So many edges are followed by one task, which holds a few bytes for each; more take rounds of joins, with the same result.
FEW = 200_000


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    above: dict[int, int] = {}

    def find(a: int) -> int:
        while above.setdefault(a, a) != a:
            above[a] = above[above[a]]
            a = above[a]
        return a

    for batch in batches:
        for u, v in zip(batch["u"].to_pylist(), batch["v"].to_pylist(), strict=True):
            x, y = find(u), find(v)
            above[max(x, y)] = min(x, y)
    nodes = list(above)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(a) for a in nodes], pa.int64())], ["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[:]


def connected_components(edges: DataFrame, scratch: Scratch, label: str, src: str = "u", dst: str = "v") -> DataFrame:
    """``node, component``: the least node of its component, for every node of an edge to another node.

    Null ends and self-loops are ignored. Every round rewrites the edges towards the least node of
    a neighbourhood and is written to the shared folder; the number of rounds grows with the
    logarithm of the longest chain. Minima are combined map-side, and nothing is collected. Up to
    ``FEW`` edges need no rounds.
    """
    pairs = edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).dropna().filter("u <> v").distinct()
    pairs = scratch.write(pairs, f"{label}-0")
    before, k = _state(pairs), 0
    if before[0] <= FEW:
        members = scratch.write(pairs.coalesce(1).mapInArrow(_followed, "node long, component long"), label)
        scratch.drop(f"{label}-0")
        return members
    while before[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        k += 1
        new = scratch.write(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        pairs, after = new, _state(new)
        if after == before:
            break
        before = after
    members = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
