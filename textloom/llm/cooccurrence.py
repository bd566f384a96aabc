"""Pairs of items that share a basket, with their count, pointwise mutual information and lift."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.plans.scratch import Scratch

#: Baskets with more distinct items are split: the pairs of one basket are then made by SALTS tasks.
LARGE_BASKET = 128
SALTS = 32


def cooccurring_pairs(baskets: DataFrame, basket: str, item: str, min_count: int = 1, min_lift: float = 0.0) -> DataFrame:
    """Columns ``item_1, item_2`` (smaller first), ``k, a, b, n, pmi, lift``.

    ``k`` baskets hold both, ``a`` and ``b`` hold each, ``n`` hold any item; a basket counts an
    item once. Rows with a null basket or item don't count. ``pmi`` is ``log2(k n / (a b))``.

    Two exact bounds keep rows out before pairs are made: an item in fewer than ``min_count``
    baskets is in no pair, and since ``k <= min(a, b)``, one in more than ``n / min_lift`` is in
    none either. With a lift threshold this takes out the items that are nearly everywhere, and
    no item left can hold more than ``1 / min_lift`` of the baskets. Pairs are counted map-side
    first; a basket above ``LARGE_BASKET`` items is spread over ``SALTS`` join keys.
    """
    spark = baskets.sparkSession
    scratch = Scratch(spark, "pairs")
    rows = baskets.select(F.col(f"`{basket}`").alias("c"), F.col(f"`{item}`").alias("x")).dropna().distinct()
    rows = scratch.write(rows, "rows")
    n = rows.agg(F.count_distinct("c")).first()[0]
    counts = rows.groupBy("x").agg(F.count("*").alias("m"))
    usable = counts.filter(F.col("m") >= min_count)
    if min_lift > 0:
        usable = usable.filter(F.col("m") * F.lit(min_lift) <= F.lit(n))
    # numbers in the order of the items: pairs are shuffled as two longs, not as two texts
    usable = scratch.write(usable.orderBy("x").withColumn("i", F.monotonically_increasing_id()), "items")
    if min_lift > 0:
        # what is nearly everywhere goes first: at most min_lift * (mean basket size) items, so small
        everywhere = scratch.write(counts.filter(F.col("m") * F.lit(min_lift) > F.lit(n)).select("x"), "everywhere")
        rows = rows.join(F.broadcast(everywhere), "x", "left_anti")
    rows = rows.join(usable.select("x", "i"), "x").select("c", "i")
    large = rows.groupBy("c").count().filter(F.col("count") > LARGE_BASKET).select("c", F.lit(True).alias("large"))
    rows = rows.join(large, "c", "left")
    left = rows.withColumn("salt", F.when(F.col("large"), F.pmod(F.xxhash64("i"), F.lit(SALTS)).cast("int")).otherwise(0))
    right = rows.withColumn("salt", F.explode(F.when(F.col("large"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    pairs = (
        left.select("c", "salt", F.col("i").alias("i_1"))
        .join(right.select("c", "salt", F.col("i").alias("i_2")), ["c", "salt"])
        .filter(F.col("i_1") < F.col("i_2"))
        .groupBy("i_1", "i_2")
        .agg(F.count("*").alias("k"))
        .filter(F.col("k") >= min_count)
    )
    a = usable.select(F.col("i").alias("i_1"), F.col("x").alias("item_1"), F.col("m").alias("a"))
    b = usable.select(F.col("i").alias("i_2"), F.col("x").alias("item_2"), F.col("m").alias("b"))
    pairs = pairs.join(a, "i_1").join(b, "i_2").drop("i_1", "i_2").withColumn("n", F.lit(n).cast("long"))
    if min_lift > 0:
        pairs = pairs.filter(F.col("k") * F.col("n") >= F.lit(min_lift) * F.col("a") * F.col("b"))
    lift = F.col("k") * F.col("n") / (F.col("a").cast("double") * F.col("b"))
    return pairs.withColumn("lift", lift).withColumn("pmi", F.ln("lift") / F.lit(math.log(2)))
