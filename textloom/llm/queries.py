"""The pN queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm import chunking, consensus, cooccurrence, history, leakage, mixing, names, sentences, topn
from textloom.operators.packed import NAMES, split_packed
from textloom.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _judged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "judgements", "userId", "queryId", "documentId", "relevanceLevel", "judged_at", "loaded_at")
    return consensus.consensus(rows, ["queryId", "documentId"], "userId", "relevanceLevel", "judged_at", "loaded_at")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[0].filter("n_users >= 3").select("queryId", "documentId", "level")


def p1_consensus(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[0].select("queryId", "documentId", "level", F.round("confidence", 6).alias("confidence"), F.round("agreement", 6).alias("agreement"), "n_users", F.round("tilt", 6).alias("tilt"))


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d)[1].select("userId", "n_items", F.round("accuracy", 6).alias("accuracy"), F.round("reliability", 6).alias("reliability"))


def p2_top3(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "qa_tuples", "queryid", "documentid", "relevance"), "queryid", "documentid", "relevance", 3)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return p2_top3(spark, d).select("queryid", "documentid")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks", "chunk_id", "text").select(F.lit("chunks").alias("item_table"), F.col("chunk_id").alias("item_key"), "text")
    articles = table(spark, d, "article_info_long", "id", "abstract").select(F.lit("article_info_long").alias("item_table"), F.col("id").cast("string").alias("item_key"), F.col("abstract").alias("text"))
    return chunking.split_oversized(chunks.unionByName(articles), ["item_table", "item_key"], "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4_pieces(spark, d).filter("pieces > 1").select("item_table", "item_key").distinct()


def _label(node: Column) -> Column:
    return F.lower(F.regexp_replace(node, "^[\\s\\u00a0]+|[\\s\\u00a0]+$", ""))


def _baskets(spark: SparkSession, d: str) -> DataFrame:
    graph = table(spark, d, "graph", "chunk_id", "node_1", "node_2")
    return graph.select("chunk_id", F.explode(F.array("node_1", "node_2")).alias("node")).select("chunk_id", _label(F.col("node")).alias("node")).filter("node <> ''")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return cooccurrence.cooccurring_pairs(_baskets(spark, d), "chunk_id", "node", min_count=5, min_lift=6.0).select(F.col("item_1").alias("node_1"), F.col("item_2").alias("node_2"))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = cooccurrence.cooccurring_pairs(_baskets(spark, d), "chunk_id", "node")
    return pairs.select("item_1", "item_2", "k", "a", "b", "n", F.round("lift", 6).alias("lift"), F.round("pmi", 6).alias("pmi"))


def p6_decisions(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "article_info_long", "id", "fetch_batch", "pubmed_id", "doi", "title")
    return history.deduplicate_batches(articles, "id", "fetch_batch", "pubmed_id", "doi", "title")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_decisions(spark, d).filter("held_id is not null").select(F.col("held_id").alias("id_1"), F.col("id").alias("id_2")).distinct()


def p7_spellings(spark: SparkSession, d: str) -> DataFrame:
    authors = split_packed(table(spark, d, "article_info_long", "id", "authors"), "authors", NAMES, ["id"])
    return names.link_names(authors, "val")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return names.linked_pairs(p7_spellings(spark, d), "val")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "eval_items", "item_id", "passage"), "doc_id", "text", "item_id", "passage")


def p8_leaked_items(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "eval_items", "item_id", "testset")
    return p8_found(spark, d).join(items, "item_id").groupBy("testset", "item_id").agg(F.count("*").alias("documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    import public_tokenizers

    counter = mixing.token_counter(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    documents = table(spark, d, "documents", "doc_id", "text", "source")
    return mixing.mix_sources(documents, table(spark, d, "mix_targets"), "doc_id", "text", "source", counter)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    shares = _mixed(spark, d)[1]
    return shares.withColumns({"quota_tokens": F.round("quota_tokens", 3), "reached_share": F.round("reached_share", 6)})


def p10_sentences(spark: SparkSession, d: str) -> DataFrame:
    return sentences.split_sentences(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_sentences(spark, d).select("doc_id", "start_char", "end_char")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_consensus, p1_reliability, p2_found, p2_top3, p4_found, p4_pieces, p5_found, p5_pairs, p6_found, p6_decisions,
        p7_found, p7_spellings, p8_found, p8_leaked_items, p9_mixture, p9_shares, p10_found, p10_sentences,
    )
}

_TOP3 = """
WITH best AS (
  SELECT queryid, documentid, max(relevance) AS relevance FROM qa_tuples
  WHERE queryid IS NOT NULL AND documentid IS NOT NULL AND relevance IS NOT NULL GROUP BY 1, 2
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY queryid ORDER BY relevance DESC, documentid) AS INTEGER) AS rank FROM best
)"""
_PAIRS = r"""
WITH labels AS (
  SELECT DISTINCT chunk_id, lower(regexp_replace(node, '^[\s\x{00a0}]+|[\s\x{00a0}]+$', '', 'g')) AS node
  FROM (SELECT chunk_id, node_1 AS node FROM graph UNION ALL SELECT chunk_id, node_2 FROM graph)
  WHERE chunk_id IS NOT NULL AND node IS NOT NULL
), rows AS (SELECT * FROM labels WHERE node <> ''
), counts AS (SELECT node, count(*) AS m FROM rows GROUP BY 1
), pairs AS (
  SELECT l.node AS item_1, r.node AS item_2, count(*) AS k
  FROM rows l JOIN rows r ON l.chunk_id = r.chunk_id AND l.node < r.node GROUP BY 1, 2
), full_pairs AS (
  SELECT item_1, item_2, k, a.m AS a, b.m AS b, (SELECT count(DISTINCT chunk_id) FROM rows) AS n
  FROM pairs JOIN counts a ON a.node = item_1 JOIN counts b ON b.node = item_2
)"""

ORACLE: dict[str, str] = {
    "p2_found": _TOP3 + "SELECT queryid, documentid FROM ranked WHERE rank <= 3",
    "p2_top3": _TOP3 + "SELECT queryid, documentid, relevance, rank FROM ranked WHERE rank <= 3",
    "p4_found": """
        SELECT DISTINCT 'chunks' AS item_table, chunk_id AS item_key FROM chunks WHERE length(text) > 1500
        UNION ALL SELECT DISTINCT 'article_info_long', CAST(id AS VARCHAR) FROM article_info_long WHERE length(abstract) > 1500""",
    "p5_found": _PAIRS + "SELECT item_1 AS node_1, item_2 AS node_2 FROM full_pairs WHERE k >= 5 AND k * n >= 6 * a * b",
    "p5_pairs": _PAIRS
    + """SELECT item_1, item_2, k, a, b, n, round(k * n / (CAST(a AS DOUBLE) * b), 6) AS lift,
         round(ln(k * n / (CAST(a AS DOUBLE) * b)) / ln(2), 6) AS pmi FROM full_pairs""",
}
