"""Judgement aggregation: AG1-AG3, JN1-JN3, PF1-PF3, PF6, ST1, ST5, SF18, SF19."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import judgements as J
from textloom.plans.session import table
from textloom.registry import query

_ROWS = """rows AS (
  SELECT userId, queryId, documentId, CAST(substr(ltrim(relevanceLevel, E' \\t\\n'), 1, 1) AS INTEGER) AS level
  FROM judgements WHERE substr(ltrim(relevanceLevel, E' \\t\\n'), 1, 1) BETWEEN '0' AND '9'
    AND userId IS NOT NULL AND queryId IS NOT NULL AND documentId IS NOT NULL)"""
_MEANS = ", means AS (SELECT queryId, documentId, avg(level) AS mean_level FROM rows GROUP BY 1, 2)"
_R2 = """, joined AS (SELECT r.*, m.mean_level AS m, avg(m.mean_level) OVER (PARTITION BY userId) AS mu FROM rows r JOIN means m USING (queryId, documentId)),
sums AS (SELECT userId, round(sum((m - level) ** 2), 9) AS o, round(sum((m - mu) ** 2), 9) AS s FROM joined GROUP BY 1),
users AS (SELECT userId, CASE WHEN s <> 0 THEN greatest(0, least(1, 1 - o / s)) WHEN o > 0 THEN 0.0 END AS r2 FROM sums)"""


def rows(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements", "userId", "queryId", "documentId", "relevanceLevel")
    return j.select("userId", "queryId", "documentId", J.level_of(F.col("relevanceLevel")).alias("level")).dropna()


@query(f"""WITH {_ROWS}{_MEANS}{_R2},
clear AS (SELECT queryId, documentId, CAST(round_even(mean_level, 0) AS INTEGER) AS relevanceLevel FROM means WHERE mean_level % 1 <> 0.5),
settled AS (SELECT j.queryId, j.documentId, CAST(round_even(round(sum(u.r2 * j.level) / nullif(sum(u.r2), 0), 9), 0) AS INTEGER) AS relevanceLevel
  FROM joined j JOIN users u USING (userId) WHERE m % 1 = 0.5 GROUP BY 1, 2)
SELECT queryId, 'Q0' AS Q0, documentId, relevanceLevel FROM clear UNION ALL SELECT queryId, 'Q0', documentId, relevanceLevel FROM settled""")
def ag3_judgement_aggregation(spark: SparkSession, d: str) -> DataFrame:
    return J.aggregate_judgements(rows(spark, d))


@query(f"WITH {_ROWS}{_MEANS} SELECT queryId, documentId, round(mean_level, 6) AS mean_level, mean_level % 1 = 0.5 AS tied FROM means")
def ag1_pf6_mean_level(spark: SparkSession, d: str) -> DataFrame:
    return J.mean_levels(rows(spark, d)).select("queryId", "documentId", F.round("mean_level", 6).alias("mean_level"), J.tied(F.col("mean_level")).alias("tied"))


@query(f"WITH {_ROWS}{_MEANS}{_R2} SELECT userId, round(r2, 6) AS r2 FROM users")
def ag2_user_reliability(spark: SparkSession, d: str) -> DataFrame:
    return J.reliability(rows(spark, d)).select("userId", F.round("r2", 6).alias("r2"))


@query(f"WITH {_ROWS}{_MEANS} SELECT r.*, round(m.mean_level, 6) AS mean_level FROM rows r JOIN means m USING (queryId, documentId)")
def jn1_levels_with_mean(spark: SparkSession, d: str) -> DataFrame:
    return rows(spark, d).join(J.mean_levels(rows(spark, d)), ["queryId", "documentId"]).withColumn("mean_level", F.round("mean_level", 6))


@query(f"WITH {_ROWS}{_MEANS} SELECT queryId, documentId FROM means WHERE (queryId, documentId) NOT IN (SELECT (queryId, documentId) FROM means WHERE mean_level % 1 = 0.5)")
def jn2_st5_untied_pairs(spark: SparkSession, d: str) -> DataFrame:
    means = J.mean_levels(rows(spark, d))
    return means.join(means.filter(J.tied(F.col("mean_level"))), ["queryId", "documentId"], "left_anti").select("queryId", "documentId")


@query(f"WITH {_ROWS}{_MEANS}{_R2} SELECT userId, queryId, documentId, level, round(r2, 6) AS r2 FROM joined JOIN users USING (userId) WHERE m % 1 = 0.5")
def jn3_tied_judgements_with_reliability(spark: SparkSession, d: str) -> DataFrame:
    own = rows(spark, d)
    ties = J.mean_levels(own).filter(J.tied(F.col("mean_level")))
    return own.join(ties, ["queryId", "documentId"], "left_semi").join(J.reliability(own), "userId").withColumn("r2", F.round("r2", 6))


@query("""SELECT queryId AS qid, 'Q0' AS c1, documentId AS docid, CAST(substr(ltrim(relevanceLevel, E' \\t\\n'), 1, 1) AS INTEGER) AS grade FROM judgements
WHERE substr(ltrim(relevanceLevel, E' \\t\\n'), 1, 1) BETWEEN '0' AND '9'""")
def pf1_pf2_pf3_project_rename_derive(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "judgements", "queryId", "documentId", "relevanceLevel")
    return j.select("queryId", F.lit("Q0"), "documentId", J.level_of(F.col("relevanceLevel"))).toDF("qid", "c1", "docid", "grade").filter("grade is not null")


@query("""SELECT x, CAST(round_even(x, 0) AS INTEGER) AS even, greatest(0, least(1, x)) AS clipped, x - floor(x) AS fraction
FROM (SELECT DISTINCT round(l_quantity / 4 - 3, 2) AS x FROM lineitem)""")
def sf18_sf19_round_even_clip(spark: SparkSession, d: str) -> DataFrame:
    x = table(spark, d, "lineitem", "l_quantity").select(F.round(F.col("l_quantity") / 4 - 3, 2).alias("x")).distinct()
    return x.select("x", F.bround("x").cast("int").alias("even"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x")).alias("clipped"), (F.col("x") - F.floor("x")).alias("fraction"))
