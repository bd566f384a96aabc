"""Ranked retrieval: AG14-AG16, AG19, AG26, WN2, WN4, WN5, JN16-JN18, TK1, TK2, PF5."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import ranking as R
from textloom.plans.session import table
from textloom.registry import query

_DATA = """qrels AS (SELECT queryid AS qid, documentid AS docid, CAST(max(relevance) AS DOUBLE) AS grade FROM qa_tuples
  WHERE documentid IS NOT NULL AND queryid IS NOT NULL GROUP BY 1, 2 HAVING max(relevance) > 0.0001),
scores AS (SELECT queryid AS qid, documentid AS docid, max(length(document_text)) AS score, documentid AS ord FROM qa_tuples
  WHERE documentid IS NOT NULL AND queryid IS NOT NULL GROUP BY 1, 2),
ranking AS (SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC NULLS LAST, ord) AS INTEGER) AS rank FROM scores)"""
_HITS = """, hits AS (SELECT r.qid, r.docid, r.rank, q.grade, CAST(q.grade >= 1 AS INTEGER) AS relevant,
  CAST(sum(CAST(q.grade >= 1 AS INTEGER)) OVER (PARTITION BY r.qid ORDER BY r.rank ROWS UNBOUNDED PRECEDING) AS BIGINT) AS nth
  FROM ranking r JOIN qrels q ON r.qid = q.qid AND r.docid = q.docid)"""
_PER = (
    """, per AS (SELECT qid, min(CASE WHEN relevant = 1 THEN rank END) AS first_rank, sum(CASE WHEN relevant = 1 AND rank <= 1000 THEN nth / rank END) AS ps,"""
    + ", ".join(f"sum(CASE WHEN relevant = 1 AND rank <= {k} THEN 1 ELSE 0 END) AS f{k}" for k in R.CUTOFFS)
    + ", "
    + ", ".join(f"sum(CASE WHEN rank <= {k} THEN grade / log2(1.0 + rank) ELSE 0 END) AS d{k}" for k in R.GAIN_CUTOFFS)
    + """ FROM hits GROUP BY 1), placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docid) AS place FROM qrels),
ideal AS (SELECT qid, sum(CAST(grade >= 1 AS INTEGER)) AS n, """
    + ", ".join(f"sum(CASE WHEN place <= {k} THEN grade / log2(1.0 + place) ELSE 0 END) AS i{k}" for k in R.GAIN_CUTOFFS)
    + """ FROM placed GROUP BY 1),
q AS (SELECT r.qid, i.qid IS NOT NULL AS judged, first_rank, coalesce(ps / nullif(n, 0), 0) AS ap, """
    + ", ".join(f"coalesce(f{k} / nullif(n, 0), 0) AS recall_{k}" for k in R.CUTOFFS)
    + ", "
    + ", ".join(f"coalesce(d{k} / nullif(i{k}, 0), 0) AS ndcg_{k}" for k in R.GAIN_CUTOFFS)
    + " FROM (SELECT DISTINCT qid FROM ranking) r LEFT JOIN ideal i ON r.qid = i.qid LEFT JOIN per p ON r.qid = p.qid)"
)
_NUMBERS = ["ap", *(f"recall_{k}" for k in R.CUTOFFS), *(f"ndcg_{k}" for k in R.GAIN_CUTOFFS)]


def qrels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_tuples", "queryid", "documentid", "relevance").dropna(subset=["queryid", "documentid"])
    grades = rows.groupBy(F.col("queryid").alias("qid"), F.col("documentid").alias("docid")).agg(F.max("relevance").cast("double").alias("grade"))
    return grades.filter("grade > 0.0001")


def scores(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_tuples", "queryid", "documentid", "document_text").dropna(subset=["queryid", "documentid"])
    return rows.groupBy(F.col("queryid").alias("qid"), F.col("documentid").alias("docid")).agg(F.max(F.length("document_text")).alias("score")).withColumn("ord", F.col("docid"))


@query(f"WITH {_DATA} SELECT qid, docid, grade FROM qrels")
def pf5_positive_grades(spark: SparkSession, d: str) -> DataFrame:
    return qrels(spark, d)


@query(f"WITH {_DATA} SELECT * FROM ranking")
def wn2_rank_by_score(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(scores(spark, d))


@query(f"WITH {_DATA}{_HITS} SELECT * FROM hits")
def jn16_wn4_hits(spark: SparkSession, d: str) -> DataFrame:
    return R.hits(R.ranked(scores(spark, d)), qrels(spark, d))


@query(f"WITH {_DATA} SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY grade DESC, docid) AS INTEGER) AS place FROM qrels")
def wn5_ideal_ranking(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    return qrels(spark, d).withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "docid")))


@query(f"WITH {_DATA} SELECT r.* FROM ranking r WHERE EXISTS (SELECT 1 FROM qrels q WHERE q.qid = r.qid AND q.docid = r.docid)")
def jn17_ranking_semi_qrels(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(scores(spark, d)).join(qrels(spark, d), ["qid", "docid"], "left_semi")


@query(f"WITH {_DATA} SELECT DISTINCT qid FROM ranking WHERE qid IN (SELECT qid FROM qrels)")
def jn18_judged_queries(spark: SparkSession, d: str) -> DataFrame:
    return scores(spark, d).select("qid").distinct().join(qrels(spark, d).select("qid").distinct(), "qid", "left_semi")


@query(f"WITH {_DATA}{_HITS}{_PER} SELECT qid, judged, first_rank, " + ", ".join(f"round({c}, 6) AS {c}" for c in _NUMBERS) + " FROM q")
def ag15_ag16_per_query(spark: SparkSession, d: str) -> DataFrame:
    return R.per_query(R.ranked(scores(spark, d)), qrels(spark, d)).withColumns({c: F.round(c, 6) for c in _NUMBERS})


_M = [
    *(
        x
        for k in R.CUTOFFS
        for x in (
            (f"MRR@{k}", f"sum(CASE WHEN first_rank <= {k} THEN 1.0 / first_rank ELSE 0 END) / sum(CAST(judged AS INTEGER))"),
            (f"Recall@{k}", f"sum(recall_{k}) / sum(CAST(judged AS INTEGER))"),
            (f"QueriesWithNoRelevant@{k}", f"sum(CASE WHEN first_rank <= {k} THEN 0 ELSE 1 END)"),
            (f"QueriesWithRelevant@{k}", f"sum(CASE WHEN first_rank <= {k} THEN 1 ELSE 0 END)"),
            (f"AverageRankGoldLabel@{k}", f"coalesce(avg(CASE WHEN first_rank <= {k} THEN first_rank END), 0)"),
            (f"MedianRankGoldLabel@{k}", f"coalesce(median(CASE WHEN first_rank <= {k} THEN first_rank END), 0)"),
        )
    ),
    *((f"nDCG@{k}", f"sum(ndcg_{k}) / sum(CAST(judged AS INTEGER))") for k in R.GAIN_CUTOFFS),
    ("QueriesRanked", "sum(CAST(judged AS INTEGER))"),
    ("MAP@1000", "sum(ap) / sum(CAST(judged AS INTEGER))"),
]


@query(f"WITH {_DATA}{_HITS}{_PER} " + " UNION ALL ".join(f"SELECT '{n}' AS metric, round(CAST({e} AS DOUBLE), 6) AS value FROM q" for n, e in _M))
def ag14_ir_metrics(spark: SparkSession, d: str) -> DataFrame:
    return R.metrics(R.ranked(scores(spark, d)), qrels(spark, d)).withColumn("value", F.round("value", 6))


@query(f"WITH {_DATA} SELECT qid AS query_id, docid AS doc_id FROM ranking WHERE rank = 1")
def tk1_top_document(spark: SparkSession, d: str) -> DataFrame:
    return R.top_document(R.ranked(scores(spark, d))).toDF("query_id", "doc_id")


@query("""SELECT queryid, documentid, relevance FROM (SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY relevance DESC NULLS LAST, documentid NULLS LAST) AS place
FROM (SELECT DISTINCT queryid, documentid, relevance FROM qa_tuples)) WHERE place = 1""")
def tk2_most_relevant(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_tuples", "queryid", "documentid", "relevance").distinct()
    return R.most_relevant(rows, "queryid", "documentid", "relevance")


@query("""SELECT queryid, documentid, relevance FROM (SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY relevance DESC NULLS LAST, md5(concat_ws('|', documentid, '42')), documentid NULLS FIRST) AS place
FROM (SELECT DISTINCT queryid, documentid, relevance FROM qa_tuples)) WHERE place = 1""")
def tk2_most_relevant_drawn(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_tuples", "queryid", "documentid", "relevance").distinct()
    return R.most_relevant(rows, "queryid", "documentid", "relevance", seed=42)


@query("""SELECT round(avg(loss), 6) AS loss, count(*) AS batches FROM (SELECT o_orderkey // 128 AS batch, avg(greatest(0, 2 - o_totalprice / 100000)) AS loss FROM orders GROUP BY 1)""")
def ag19_distance_loss(spark: SparkSession, d: str) -> DataFrame:
    """Mean over batches of the distance of scores below 2."""
    rows = table(spark, d, "orders", "o_orderkey", "o_totalprice").select(F.floor(F.col("o_orderkey") / 128).alias("batch"), (F.col("o_totalprice") / 100000).alias("score"))
    per = rows.groupBy("batch").agg(F.avg(F.greatest(F.lit(0.0), 2 - F.col("score"))).alias("loss"))
    return per.agg(F.round(F.avg("loss"), 6).alias("loss"), F.count("*").alias("batches"))


@query("""SELECT model, min_by(epoch, (loss, epoch)) AS epoch, min(loss) AS loss FROM (
SELECT c_mktsegment AS model, c_nationkey AS epoch, round(avg(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 10000 END), 4) AS loss FROM customer GROUP BY 1, 2) GROUP BY 1""")
def ag26_best_epoch(spark: SparkSession, d: str) -> DataFrame:
    """The earliest epoch of least loss; a missing loss counts as 10000."""
    loss = F.round(F.avg(F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).otherwise(10000.0)), 4)
    rows = table(spark, d, "customer", "c_mktsegment", "c_nationkey", "c_acctbal").groupBy(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").alias("epoch")).agg(loss.alias("loss"))
    return rows.groupBy("model").agg(F.min(F.struct("loss", "epoch")).alias("best")).select("model", "best.epoch", "best.loss")
