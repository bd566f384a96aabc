"""Relevance levels from several judges, weighted by how well each agrees with the mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def level_of(label: Column) -> Column:
    """The digit a label starts with; null for an unreadable label."""
    digit = F.substring(F.regexp_replace(label, "^\\s+", ""), 1, 1)
    return F.when(digit.rlike("^[0-9]$"), digit.cast("int"))


def mean_levels(judgements: DataFrame) -> DataFrame:
    return judgements.groupBy("queryId", "documentId").agg(F.avg("level").alias("mean_level"))


def tied(mean: Column) -> Column:
    return mean % 1 == 0.5


def reliability(judgements: DataFrame) -> DataFrame:
    """``userId, r2``: explained variance of the pair means, clipped to [0, 1].

    A judge whose pairs all have the same mean gets 0, or null if the answers hit it throughout.
    The mean of each pair comes from a window, so the judgements aren't joined with themselves.
    """
    rows = judgements.withColumn("m", F.avg("level").over(Window.partitionBy("queryId", "documentId")))
    rows = rows.withColumn("mu", F.avg("m").over(Window.partitionBy("userId")))
    sums = rows.groupBy("userId").agg(
        F.round(F.sum((F.col("m") - F.col("level")) ** 2), 9).alias("off"), F.round(F.sum((F.col("m") - F.col("mu")) ** 2), 9).alias("spread")
    )
    r2 = F.when(F.col("spread") != 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col("off") / F.col("spread")))).when(F.col("off") > 0, 0.0)
    return sums.select("userId", r2.alias("r2"))


def aggregate_judgements(judgements: DataFrame) -> DataFrame:
    """``queryId, Q0, documentId, relevanceLevel`` from ``userId, queryId, documentId, level``.

    Pairs whose mean isn't halfway between two levels get it rounded. For the others the mean is
    weighted by the judges' reliability and rounded half to even; without any weight it is null.
    Rows with a null level, pair or judge don't count.
    """
    rows = judgements.dropna(subset=["userId", "queryId", "documentId", "level"])
    means = mean_levels(rows)
    clear = means.filter(~tied(F.col("mean_level"))).select("queryId", "documentId", F.bround("mean_level").cast("int").alias("relevanceLevel"))
    open_pairs = means.filter(tied(F.col("mean_level"))).select("queryId", "documentId")
    weighted = rows.join(open_pairs, ["queryId", "documentId"], "left_semi").join(reliability(rows), "userId")
    value = F.try_divide(F.sum(F.col("r2") * F.col("level")), F.sum("r2"))
    settled = weighted.groupBy("queryId", "documentId").agg(F.bround(F.round(value, 9)).cast("int").alias("relevanceLevel"))
    return clear.unionByName(settled).select("queryId", F.lit("Q0").alias("Q0"), "documentId", "relevanceLevel")
