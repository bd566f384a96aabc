"""Question answering: JN4-JN7, PF9, PF14, PF15, PF17, AG17, AG18, AG25, ST4, ST6, SF2-SF5, ML23, SM2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions import text as T
from textloom.operators import qa as Q
from textloom.operators import ranking as R
from textloom.plans.session import table
from textloom.registry import query

_TOP = """top1 AS (SELECT queryid AS query_id, documentid AS doc_id FROM (SELECT *, row_number() OVER (PARTITION BY queryid ORDER BY relevance DESC NULLS LAST, documentid NULLS LAST) AS place
  FROM (SELECT DISTINCT queryid, documentid, relevance FROM qa_tuples)) WHERE place = 1)"""
_NORM = """trim(regexp_replace(regexp_replace(' ' || regexp_replace(regexp_replace(lower(coalesce({0}, '')), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+', '  ', 'g') || ' ', '[\\s\\x{{00a0}}](a|an|the)[\\s\\x{{00a0}}]', ' ', 'g'), '[\\s\\x{{00a0}}]+', ' ', 'g'))"""


def _norm(x: str) -> str:
    return _NORM.format(x)


def top1(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_tuples", "queryid", "documentid", "relevance").distinct()
    return R.most_relevant(rows, "queryid", "documentid", "relevance").select(F.col("queryid").alias("query_id"), F.col("documentid").alias("doc_id"))


def tuples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "qa_tuples", "queryid", "documentid", "query_text", "document_text")


@query(f"WITH {_TOP} SELECT query_id, doc_id, query_text FROM (SELECT DISTINCT query_id, doc_id, queryid, query_text FROM top1 LEFT JOIN qa_tuples ON query_id = queryid)")
def jn4_answers_with_query_text(spark: SparkSession, d: str) -> DataFrame:
    return Q.with_query_text(top1(spark, d), tuples(spark, d))


@query(f"""WITH {_TOP}, q AS (SELECT DISTINCT query_id, doc_id, queryid, query_text FROM top1 LEFT JOIN qa_tuples ON query_id = queryid)
SELECT query_id, doc_id, q.query_text, t.document_text FROM q JOIN qa_tuples t ON doc_id = t.documentid
WHERE query_id IS NOT NULL AND q.query_text IS NOT NULL AND t.document_text IS NOT NULL""")
def jn5_pf9_answers_with_document_text(spark: SparkSession, d: str) -> DataFrame:
    return Q.with_document_text(Q.with_query_text(top1(spark, d), tuples(spark, d)), tuples(spark, d))


@query(f"""WITH {_TOP}, q AS (SELECT DISTINCT query_id, doc_id, queryid, query_text FROM top1 LEFT JOIN qa_tuples ON query_id = queryid)
SELECT DISTINCT query_id, doc_id, q.query_text, t.document_text FROM q LEFT JOIN qa_tuples t ON doc_id = t.documentid""")
def jn5_ag25_answers_deduplicated(spark: SparkSession, d: str) -> DataFrame:
    return Q.with_document_text(Q.with_query_text(top1(spark, d), tuples(spark, d)), tuples(spark, d), complete=False)


@query("SELECT DISTINCT queryid FROM qa_tuples WHERE queryid IN (SELECT queryId FROM judgements)")
def jn6_st4_common_queries(spark: SparkSession, d: str) -> DataFrame:
    return Q.common_queries(table(spark, d, "qa_tuples", "queryid"), table(spark, d, "judgements", "queryId"), "queryid", "queryId")


@query("SELECT queryid, documentid, relevance FROM qa_tuples WHERE queryid IN (SELECT queryId FROM judgements)")
def pf14_in_common_queries(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "judgements", F.col("queryId").alias("queryid")).distinct()
    return table(spark, d, "qa_tuples", "queryid", "documentid", "relevance").join(wanted, "queryid", "left_semi")


@query("""SELECT DISTINCT queryid, documentid FROM qa_tuples t WHERE NOT EXISTS (SELECT 1 FROM judgements j WHERE j.queryId = t.queryid AND j.documentId = t.documentid)""")
def pf15_sm2_pending_pairs(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "judgements", F.col("queryId").alias("queryid"), F.col("documentId").alias("documentid"))
    return Q.pending(table(spark, d, "qa_tuples", "queryid", "documentid"), done, ["queryid", "documentid"])


@query("""SELECT queryid, TRY_CAST(queryid AS BIGINT) AS as_long, TRY_CAST(documentid AS BIGINT) AS doc_long, CAST(relevance AS VARCHAR) AS as_text FROM qa_tuples""")
def pf17_casts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_tuples", "queryid", "documentid", "relevance")
    return rows.select("queryid", F.col("queryid").try_cast("long").alias("as_long"), F.col("documentid").try_cast("long").alias("doc_long"), F.col("relevance").cast("string").alias("as_text"))


def _answers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "qa_tuples", "queryid", "text_selection", "document_text").filter("queryid is not null")
    one = rows.groupBy("queryid").agg(F.min("text_selection").alias("gold"), F.max("document_text").alias("guess"))
    return one.select("queryid", F.col("gold").alias("answer")), one.select("queryid", F.col("guess").alias("answer"))


_ONE = "one AS (SELECT queryid, min(text_selection) AS gold, max(document_text) AS guess FROM qa_tuples WHERE queryid IS NOT NULL GROUP BY 1)"
_SCORED = f"""{_ONE}, normal AS (SELECT queryid, gold, guess, {_norm("gold")} AS ng, {_norm("guess")} AS np FROM one),
sides AS (SELECT *, CASE WHEN ng = '' THEN [] ELSE string_split(ng, ' ') END AS tg, CASE WHEN np = '' THEN [] ELSE string_split(np, ' ') END AS tp FROM normal),
shared AS (SELECT *, list_sum(list_transform(list_distinct(tg), lambda t: least(len(list_filter(tg, lambda x: x = t)), len(list_filter(tp, lambda x: x = t))))) AS n FROM sides),
scored AS (SELECT queryid, gold, guess, CAST(ng = np AS INTEGER) AS exact, CASE WHEN len(tg) = 0 OR len(tp) = 0 THEN CAST(len(tg) = len(tp) AS DOUBLE) WHEN coalesce(n, 0) = 0 THEN 0
  ELSE 2 * (n / len(tp)) * (n / len(tg)) / (n / len(tp) + n / len(tg)) END AS f1 FROM shared)"""


@query(f"WITH {_SCORED} SELECT queryid, exact, round(f1, 6) AS f1 FROM scored")
def ag18_sf5_answer_f1(spark: SparkSession, d: str) -> DataFrame:
    gold, guess = _answers(spark, d)
    return Q.answer_scores(gold, guess, "queryid", "answer").select("queryid", "exact", F.round("f1", 6).alias("f1"))


@query(f"WITH {_SCORED} SELECT round(avg(exact), 6) AS exact, round(avg(f1), 6) AS f1, count(*) AS n FROM scored")
def ag17_ag18_averages(spark: SparkSession, d: str) -> DataFrame:
    gold, guess = _answers(spark, d)
    return Q.answer_scores(gold, guess, "queryid", "answer").agg(F.round(F.avg("exact"), 6).alias("exact"), F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


@query(f"WITH {_ONE} SELECT queryid, {_norm('guess')} AS normal FROM one")
def sf2_normalize_answer(spark: SparkSession, d: str) -> DataFrame:
    _, guess = _answers(spark, d)
    return guess.select("queryid", T.normalize_answer(F.coalesce("answer", F.lit(""))).alias("normal"))


@query(f"WITH {_ONE} SELECT queryid, len(CASE WHEN x = '' THEN [] ELSE string_split(x, ' ') END) AS tokens FROM (SELECT queryid, {_norm('gold')} AS x FROM one)")
def sf3_answer_tokens(spark: SparkSession, d: str) -> DataFrame:
    gold, _ = _answers(spark, d)
    return gold.select("queryid", F.size(T.answer_tokens(F.col("answer"))).cast("long").alias("tokens"))


@query(f"WITH {_ONE} SELECT queryid, CAST({_norm('gold')} = {_norm('guess')} AS INTEGER) AS exact FROM one")
def sf4_exact(spark: SparkSession, d: str) -> DataFrame:
    gold, guess = _answers(spark, d)
    return Q.answer_scores(gold, guess, "queryid", "answer").select("queryid", "exact")


@query("""WITH a AS (SELECT relevance, row_number() OVER (ORDER BY relevance) AS n FROM (SELECT relevance FROM qa_tuples WHERE relevance IS NOT NULL))
SELECT x.n AS n, x.relevance AS gold, y.level AS predicted FROM a x
JOIN (SELECT o_shippriority AS level, row_number() OVER (ORDER BY o_shippriority) AS n FROM (SELECT CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS o_shippriority FROM orders)) y USING (n)""")
def jn7_positional_join(spark: SparkSession, d: str) -> DataFrame:
    """Two lists joined by place, as far as the shorter goes."""
    from textloom.plans.order import numbered

    left = numbered(table(spark, d, "qa_tuples", F.col("relevance").alias("gold")).dropna(), [F.col("gold")])
    level = table(spark, d, "orders", F.substring("o_orderpriority", 1, 1).cast("int").alias("predicted"))
    return left.join(numbered(level, [F.col("predicted")]), "n")


@query("""SELECT x, CAST(count(*) AS BIGINT) AS n FROM (SELECT event_type AS x FROM events WHERE user_id % 2 = 0 INTERSECT ALL SELECT event_type FROM events WHERE user_id % 2 = 1) GROUP BY 1""")
def st6_multiset_intersection(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events", "event_type", "user_id")
    even, odd = events.filter("user_id % 2 = 0").select("event_type"), events.filter("user_id % 2 = 1").select("event_type")
    return even.intersectAll(odd).groupBy(F.col("event_type").alias("x")).agg(F.count("*").alias("n"))


@query()
def ml23_extracted_answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "qa_tuples", "queryid", "documentid", "query_text", "document_text").distinct()
    return Q.extract_answers(rows, ["queryid", "documentid"])
