"""Ranked retrieval: ranks, metrics at several cutoffs, top documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.order import running

CUTOFFS = (10, 20, 1000)
GAIN_CUTOFFS = (3, 5, 10, 20, 1000)
MAP_CUTOFF = 1000


def ranked(scores: DataFrame) -> DataFrame:
    """``qid, docid, rank`` from ``qid, docid, score, ord``: score descending, then order of arrival."""
    rows = running(scores.select("qid", "docid", "score", "ord"), ["qid"], [F.col("score").desc(), F.col("ord")], F.lit(1), "rank")
    return rows.select("qid", "docid", F.col("rank").cast("int").alias("rank"))


def hits(ranking: DataFrame, qrels: DataFrame, binary_from: float = 1.0) -> DataFrame:
    """The ranking's judged documents with grade, binary relevance and running number of binary hits."""
    joined = ranking.join(qrels, ["qid", "docid"]).withColumn("relevant", (F.col("grade") >= binary_from).cast("int"))
    return running(joined, ["qid"], [F.col("rank")], F.col("relevant"), "nth")


def per_query(ranking: DataFrame, qrels: DataFrame, binary_from: float = 1.0) -> DataFrame:
    """One row a ranked query: first relevant rank, AP, recall and nDCG at every cutoff.

    The ranking is joined with the judgements once; all cutoffs are conditional sums. Queries
    without judgements have ``judged`` false and zeros; a document ranked twice counts twice.
    """
    found = hits(ranking, qrels, binary_from)
    gain = F.col("grade") / F.log2(1.0 + F.col("rank"))
    per = found.groupBy("qid").agg(
        F.min(F.when(F.col("relevant") == 1, F.col("rank"))).alias("first_rank"),
        F.sum(F.when((F.col("relevant") == 1) & (F.col("rank") <= MAP_CUTOFF), F.col("nth") / F.col("rank"))).alias("precision_sum"),
        *(F.sum(F.when((F.col("relevant") == 1) & (F.col("rank") <= k), 1).otherwise(0)).alias(f"found_{k}") for k in CUTOFFS),
        *(F.sum(F.when(F.col("rank") <= k, gain).otherwise(0.0)).alias(f"dcg_{k}") for k in GAIN_CUTOFFS),
    )
    # only the first places count for the gain, so each task passes on no more of a query than these
    placed = qrels.withColumn("at", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("grade").desc(), "docid"))).filter(F.col("at") <= max(GAIN_CUTOFFS))
    best = F.col("grade") / F.log2(1.0 + F.col("at"))
    gains = placed.groupBy("qid").agg(*(F.sum(F.when(F.col("at") <= k, best).otherwise(0.0)).alias(f"idcg_{k}") for k in GAIN_CUTOFFS))
    ideal = qrels.groupBy("qid").agg(F.sum((F.col("grade") >= binary_from).cast("int")).alias("n_relevant")).join(gains, "qid")
    rows = ranking.select("qid").distinct().join(ideal, "qid", "left").join(per, "qid", "left")
    zero = F.lit(0.0)
    return rows.select(
        "qid",
        F.col("n_relevant").isNotNull().alias("judged"),
        "first_rank",
        F.coalesce(F.try_divide("precision_sum", "n_relevant"), zero).alias("ap"),
        *(F.coalesce(F.try_divide(F.col(f"found_{k}").cast("double"), F.col("n_relevant")), zero).alias(f"recall_{k}") for k in CUTOFFS),
        *(F.coalesce(F.try_divide(f"dcg_{k}", f"idcg_{k}"), zero).alias(f"ndcg_{k}") for k in GAIN_CUTOFFS),
    )


def metrics(ranking: DataFrame, qrels: DataFrame, binary_from: float = 1.0) -> DataFrame:
    """``metric, value``: means over judged queries; queries without a hit are counted over all ranked ones."""
    rows = per_query(ranking, qrels, binary_from)
    judged = F.sum(F.col("judged").cast("int"))
    names, values = [], []
    for k in CUTOFFS:
        near = F.col("first_rank") <= k
        named = {
            f"MRR@{k}": F.try_divide(F.sum(F.when(near, 1.0 / F.col("first_rank")).otherwise(0.0)), judged),
            f"Recall@{k}": F.try_divide(F.sum(f"recall_{k}"), judged),
            f"QueriesWithNoRelevant@{k}": F.sum(F.when(near, 0).otherwise(1)),
            f"QueriesWithRelevant@{k}": F.sum(F.when(near, 1).otherwise(0)),
            f"AverageRankGoldLabel@{k}": F.coalesce(F.avg(F.when(near, F.col("first_rank"))), F.lit(0.0)),
            f"MedianRankGoldLabel@{k}": F.coalesce(F.median(F.when(near, F.col("first_rank"))), F.lit(0.0)),
        }
        names += named
        values += named.values()
    for k in GAIN_CUTOFFS:
        names.append(f"nDCG@{k}")
        values.append(F.try_divide(F.sum(f"ndcg_{k}"), judged))
    names += ["QueriesRanked", f"MAP@{MAP_CUTOFF}"]
    values += [judged, F.try_divide(F.sum("ap"), judged)]
    one = rows.agg(F.array(*(F.struct(F.lit(n).alias("metric"), v.cast("double").alias("value")) for n, v in zip(names, values, strict=True))).alias("m"))
    return one.select(F.inline("m"))


def top_document(ranking: DataFrame) -> DataFrame:
    """The first document of every query."""
    return ranking.filter("rank = 1").select("qid", "docid")


def most_relevant(rows: DataFrame, query: str, document: str, relevance: str, seed: int | None = None) -> DataFrame:
    """One most relevant row per query. Ties go to the least document id, or with a seed to the least hash: a reproducible draw."""
    tie = F.col(document) if seed is None else F.md5(F.concat_ws("|", F.col(document), F.lit(str(seed))))
    first = [F.col(relevance).isNull(), -F.col(relevance), tie.isNull(), tie, F.col(document)]
    key = F.struct(*(c.alias(f"k{i}") for i, c in enumerate(first)), F.struct(*rows.columns).alias("row"))
    # the least of a group is combined map-side, so a query with many rows needs no task of its own
    return rows.groupBy(F.col(query).alias("__query")).agg(F.min(key).alias("best")).select("best.row.*")
