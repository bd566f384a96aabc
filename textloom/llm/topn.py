"""The N best items of every group, by descending score bands.

Bands are ranges of the score, processed from the top: rows of groups that are already filled are
dropped by an anti-join before anything is shuffled for them, and the band in which a group fills
up is finished by exact ranking of its ties. The first band holds about as many rows as fill all
groups, the next one half of what is left; a band in which no score can lie is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.scratch import Scratch

#: A group counts as hot from this share of the rows on, so there are at most 1 / HOT_SHARE of them.
HOT_SHARE = 0.001
SALTS = 32


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """Columns ``group, item, score, rank`` (1 to ``n``), named like the input's columns.

    An item counts once per group, with its highest score. The order is score descending, then
    item ascending by its bytes, so it is the same in every run. Rows with a null group, item or
    score don't count; NaN scores rank first, as Spark orders them. Groups with fewer than ``n``
    items keep what they have; an empty input gives no rows. Other columns are ignored.

    A hot group is spread over ``SALTS`` parts until each part holds at most ``2 n - 1`` rows of
    it, and the list of hot groups is broadcast: its length is bounded by ``1 / HOT_SHARE``.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topn")
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), F.col(f"`{score}`").alias("s")).dropna()

    shares = [k / 100 for k in range(1, 100)]
    total, groups, least, cuts = rows.agg(F.count("*"), F.approx_count_distinct("g"), F.min("s"), F.percentile_approx("s", shares, 10000)).first()
    above = 1 - min(1.0, n * groups / max(total, 1))
    bounds = sorted({cuts[int(100 * q) - 1] for q in (above, above / 2) if q >= 0.01} if cuts else (), reverse=True)
    bounds = [b for b in bounds if b > least]
    hot = F.broadcast(scratch.write(rows.groupBy("g").count().filter(F.col("count") >= max(total * HOT_SHARE, 10 * SALTS)).select("g"), "hot"))
    rows = rows.join(hot.withColumn("h", F.lit(True)), "g", "left").withColumn("salt", F.when(F.col("h"), F.pmod(F.xxhash64("i"), F.lit(SALTS))).otherwise(F.lit(0)).cast("int")).drop("h")

    order = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    kept: list[DataFrame] = []
    partial: DataFrame | None = None
    upper = None
    for k, lower in enumerate([*bounds, None]):
        band = rows
        if lower is not None:
            band = band.filter(F.col("s") >= lower)
        if upper is not None:
            band = band.filter(F.col("s") < upper)
        if kept:
            filled = kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])
            for more in kept[2:]:
                filled = filled.unionByName(more)
            filled = filled.filter("r = 1").select("g")
            band = band.join(F.broadcast(filled.join(hot, "g", "left_semi")), "g", "left_anti")
            band = band.join(filled.withColumn("salt", F.lit(0)), ["g", "salt"], "left_anti")
        band = band.groupBy("g", "salt", "i").agg(F.max("s").alias("s"))
        band = band.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= 2 * n - 1).select("g", "i", "s")
        if partial is not None:
            band = band.unionByName(partial).groupBy("g", "i").agg(F.max("s").alias("s"))
        ranked = band.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= n)
        ranked = ranked.withColumn("full", F.max("r").over(Window.partitionBy("g")) == n)
        ranked = scratch.write(ranked, f"band-{k}")
        kept.append(ranked.filter("full").select("g", "i", "s", "r"))
        partial = ranked.filter("not full").select("g", "i", "s")
        last, upper = ranked, lower
    result = last.filter("not full").select("g", "i", "s", "r")
    for part in kept:
        result = result.unionByName(part)
    return result.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))
