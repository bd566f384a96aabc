"""Sources, sinks and catalog: SC1-SC20, SK1-SK11, JN15, PF18, SM1. Each query writes, reads back and returns what it read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators import catalog
from textloom.operators.qa import pending
from textloom.plans.scratch import Scratch
from textloom.plans.session import table
from textloom.queries import ranking as QR
from textloom.registry import ORACLE, query
from textloom.sources import readers, sinks
from textloom.streaming import backfill


@query("SELECT userId, queryId, documentId, relevanceLevel FROM judgements")
def sc1_tsv_with_header(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("judgements.tsv")
    sinks.write_delimited(table(spark, d, "judgements", "userId", "queryId", "documentId", "relevanceLevel"), path, "\t", escaped=True)
    return readers.read_delimited(spark, path, readers.JUDGEMENTS, header=True, escaped=True)


@query("SELECT queryid, documentid, relevance, query_text FROM qa_tuples")
def sc2_tsv_projected(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("qa.tsv")
    sinks.write_delimited(table(spark, d, "qa_tuples"), path, "\t", header=False, escaped=True)
    return readers.read_delimited(spark, path, readers.QA_TUPLES, columns=["queryid", "documentid", "relevance", "query_text"], escaped=True)


_POSITIVE = "SELECT queryid AS qid, documentid AS docid, CAST(max(relevance) AS DOUBLE) AS grade FROM qa_tuples WHERE documentid IS NOT NULL AND queryid IS NOT NULL GROUP BY 1, 2 HAVING max(relevance) > 0.0001"


@query(_POSITIVE)
def sc3_sk1_qrels(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("qrels.txt")
    sinks.write_spaced(QR.qrels(spark, d).select("qid", F.lit("Q0"), "docid", F.col("grade").cast("int")), path)
    return readers.read_qrels(spark, path)


@query("""SELECT queryid AS qid, documentid AS docid, CAST(row_number() OVER (PARTITION BY queryid ORDER BY documentid) AS INTEGER) AS rank
FROM (SELECT DISTINCT queryid, documentid FROM qa_tuples WHERE documentid IS NOT NULL AND queryid IS NOT NULL AND relevance > 0)""")
def sc4_ranking(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("ranking.txt")
    rows = table(spark, d, "qa_tuples", "queryid", "documentid").dropna().distinct().orderBy("queryid", "documentid")
    sinks.write_spaced(rows.select("queryid", F.lit("Q0"), "documentid", F.lit("1"), F.lit("0.5"), F.lit("run")), path)
    return readers.read_ranking(spark, path, QR.qrels(spark, d))


@query("SELECT question AS query, testset AS doc_pos, lang AS doc_neg FROM eval_items")
def sc5_training_triples(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("triples.tsv")
    table(spark, d, "eval_items").select(F.concat_ws("\t", "question", "testset", "lang").alias("value")).write.text(path)
    return readers.read_fields(spark, path, readers.TRIPLES)


@query("SELECT CAST(item_id AS VARCHAR) AS query_id, testset AS doc_id, question AS query, passage AS doc FROM eval_items")
def sc6_labeled_tuples(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("tuples.tsv")
    table(spark, d, "eval_items").select(F.concat_ws("\t", F.col("item_id").cast("string"), "testset", "question", "passage").alias("value")).write.text(path)
    return readers.read_fields(spark, path, readers.LABELED)


@query("SELECT coalesce(doi, 'None') AS value FROM article_info_long")
def sc8_first_column(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "article_info_long", "doi", "id").createOrReplaceTempView("textloom_articles")
    return catalog.first_column(spark, "SELECT doi, id FROM textloom_articles")


@query()
def sc10_whole_texts(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("texts")
    table(spark, d, "documents", "text", "lang").filter("text is not null").select(F.col("text").alias("value")).write.text(path)
    return readers.read_texts(spark, path).select(F.length("text").alias("characters"))


@query("SELECT node_1, node_2, edge, chunk_id FROM graph")
def sc11_sk2_pipe_csv(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("graph.csv")
    sinks.write_delimited(table(spark, d, "graph", "node_1", "node_2", "edge", "chunk_id"), path, "|", escaped=True)
    return readers.read_delimited(spark, path, "node_1 string, node_2 string, edge string, chunk_id string", "|", header=True, escaped=True)


@query("SELECT c_custkey AS node_id, c_name AS node_label FROM customer")
def sc12_sk3_node_csv(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("nodes.csv")
    sinks.write_delimited(table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label")), path)
    return readers.read_delimited(spark, path, "id long, label string", ",", header=True).toDF("node_id", "node_label")


@query("SELECT id, doi, (SELECT count(*) FROM article_info_long b WHERE b.doi = a.doi) AS citations FROM article_info_long a WHERE doi IS NOT NULL")
def sc15_counts_by_doi(spark: SparkSession, d: str) -> DataFrame:
    articles = table(spark, d, "article_info_long", "id", "doi").filter("doi is not null")
    return articles.join(articles.groupBy("doi").agg(F.count("*").alias("citations")), "doi").select("id", "doi", "citations")


@query("SELECT CAST(event_id AS VARCHAR) AS query_id, event_type AS doc_id, round(value, 4) AS score FROM events")
def sk8_predictions(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("predictions.tsv")
    rows = table(spark, d, "events").select(F.col("event_id").cast("string").alias("query_id"), F.col("event_type").alias("doc_id"), F.round("value", 4).alias("score"))
    sinks.write_delimited(rows, path, "\t", header=False)
    return readers.read_delimited(spark, path, "query_id string, doc_id string, score double")


@query(ORACLE["tk1_top_document"])
def sk9_sc2_top_answers(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("top1.tsv")
    sinks.write_delimited(QR.tk1_top_document(spark, d), path, "\t")
    return readers.read_delimited(spark, path, "query_id string, doc_id string", header=True)


@query(f"SELECT metric || ': ' || CAST(value AS VARCHAR) AS value FROM ({ORACLE['ag14_ir_metrics']}) UNION ALL SELECT '===== metrics =====' UNION ALL SELECT repeat('=', 19)")
def sk10_metric_report(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("metrics.txt")
    sinks.write_metrics(QR.ag14_ir_metrics(spark, d), path, "metrics")
    return spark.read.text(path)


@query("SELECT DISTINCT queryid, documentid FROM qa_tuples WHERE documentid IS NOT NULL AND queryid IS NOT NULL")
def sk11_sc19_checkpoint(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("results")
    schema = "queryid string, documentid string"
    work = table(spark, d, "qa_tuples", "queryid", "documentid").dropna()
    for part in (work.limit(1000), work):  # the second run resumes after the first
        done = readers.read_checkpoint(spark, path, schema)
        sinks.append_checkpoint(pending(part, done, ["queryid", "documentid"]), path, ["queryid", "documentid"])
    return readers.read_checkpoint(spark, path, schema)


@query("SELECT id, title, 'asthma' AS search_term FROM article_info_long WHERE id % 2 = 0 UNION ALL SELECT id, title, 'cough' FROM article_info_long WHERE id % 2 = 1")
def sk4_append_by_term(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("terms")
    articles = table(spark, d, "article_info_long", "id", "title")
    sinks.append_by_term(articles.filter("id % 2 = 0"), path, "asthma")
    sinks.append_by_term(articles.filter("id % 2 = 1"), path, "cough")
    return spark.read.schema("id long, title string, search_term string").parquet(path)


@query("SELECT doc_id, multiple_topics FROM topic_modelling")
def sk5_replaced_table(spark: SparkSession, d: str) -> DataFrame:
    """A table of other content is replaced, and what replaced it read back."""
    scratch = Scratch(spark, "io")
    rows, name = table(spark, d, "topic_modelling", "doc_id", "multiple_topics"), f"textloom_topics_{uuid.uuid4().hex}"
    sinks.replace_table(rows.withColumn("multiple_topics", F.upper("multiple_topics")), name, scratch.path("topics"))
    return sinks.replace_table(rows, name, scratch.path("topics"))


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def sk6_ensured_rows(spark: SparkSession, d: str) -> DataFrame:
    """A table is made once and filled twice."""
    name, path = f"textloom_nations_{uuid.uuid4().hex}", Scratch(spark, "io").path("nations")
    for _ in range(2):
        catalog.ensure_rows(spark, name, "n_nationkey int, n_name string, n_regionkey int", table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), path)
    return spark.table(name)


def _local(path: str) -> str:
    """The path of the shared folder for programs that know only mounted files."""
    if not path.startswith(("file:", "/")):
        raise ValueError(f"{path} is no mounted folder")
    return "/" + path.removeprefix("file:").lstrip("/")


@query("SELECT id, title FROM article_info_long WHERE abstract IS NOT NULL ORDER BY id LIMIT 250")
def sc7_sqlite_scan(spark: SparkSession, d: str) -> DataFrame:
    """Filter, order and limit run inside SQLite."""
    scratch = Scratch(spark, "io")
    scratch.save("made", "")
    path = _local(scratch.path("articles.sqlite"))
    sinks.write_sqlite(table(spark, d, "article_info_long", "id", "title", "abstract"), path, "article_info_long")
    return readers.read_sqlite(spark, path, "SELECT id, title FROM article_info_long WHERE abstract IS NOT NULL ORDER BY id LIMIT 250", "id long, title string")


@query("SELECT pubmed_id, title, strftime(fetched_at, '%Y-%m-%d') AS publication_date, authors FROM article_info_long WHERE fetched_at IS NOT NULL")
def sc13_article_feed(spark: SparkSession, d: str) -> DataFrame:
    """All days of the feed, one partition each; the day an article was fetched stands for its date."""
    from textloom.sources.feeds import register_feeds

    register_feeds(spark)
    path = Scratch(spark, "io").path("feed")
    day = F.date_format("fetched_at", "yyyy-MM-dd")
    rows = table(spark, d, "article_info_long", "pubmed_id", "title", "authors", "fetched_at").filter("fetched_at is not null").select("pubmed_id", "title", "authors", day.alias("day"))
    rows.repartition("day").write.partitionBy("day").json(path)
    first, last = rows.agg(F.min("day"), F.max("day")).first()
    return spark.read.format("article_feed").option("path", _local(path)).option("start", first or "2000-01-01").option("end", last or "2000-01-01").option("max_results", str(2**62)).load()


@query("SELECT testset || '-' || item_id AS title, question || ' ' || passage AS body FROM eval_items")
def sc14_page_feed(spark: SparkSession, d: str) -> DataFrame:
    """Pages as text: markup and blanks around it are gone."""
    from textloom.sources.feeds import register_feeds

    register_feeds(spark)
    scratch = Scratch(spark, "io")
    page = F.concat(F.lit("<html><head><title>x</title></head><body><h1>"), "question", F.lit("</h1>\n <p class='a'>"), F.replace(F.replace("passage", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p></body></html>"))
    rows = table(spark, d, "eval_items", "item_id", "testset", "question", "passage")
    rows.select(F.concat_ws("-", "testset", F.col("item_id").cast("string")).alias("title"), page.alias("html")).write.json(scratch.path("pages"))
    return spark.read.format("page_feed").option("path", _local(scratch.path("pages"))).load()


@query("SELECT 'v' || vec_id AS token, CAST(row_number() OVER (ORDER BY vec_id) AS INTEGER) AS id, round(CAST(embedding[1] AS DOUBLE), 4) AS first_x, len(embedding) AS width FROM embeddings")
def sc18_vectors(spark: SparkSession, d: str) -> DataFrame:
    path = Scratch(spark, "io").path("vectors.txt")
    line = F.concat(F.lit("v"), F.col("vec_id"), F.lit(" "), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    table(spark, d, "embeddings", "vec_id", "embedding").orderBy("vec_id").select(line.alias("value")).write.text(path)
    return readers.read_vectors(spark, path, 64).select("token", "id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("first_x"), F.size("vector").cast("long").alias("width"))


@query("SELECT node_1 AS source, node_2 AS target, edge AS relationship FROM graph")
def sk7_sent_rows(spark: SparkSession, d: str) -> DataFrame:
    """Edges handed to an outside store in batches by the tasks; a folder of files stands for the store."""
    scratch = Scratch(spark, "io")
    scratch.save("sent/_made", "")
    where = _local(scratch.path("sent"))

    def send(rows: list) -> None:
        import json

        with open(f"{where}/{uuid.uuid4().hex}.json", "w", encoding="utf-8") as out:
            out.writelines(json.dumps(r.asDict()) + "\n" for r in rows)

    sinks.send_rows(sinks.property_graph(table(spark, d, "graph", "node_1", "node_2", "edge", "chunk_id"))[1], send)
    return spark.read.schema("source string, target string, relationship string").json(scratch.path("sent"))


_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings judgements qa_tuples article_info_long topic_modelling topic_info chunks graph eval_items mix_targets".split()
)
_KINDS = {"string": "TEXT", "bigint": "LONG", "int": "INT", "double": "DOUBLE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "array<float>": "FLOATS", "array<string>": "TEXTS"}
_COLUMNS = " UNION ALL ".join(
    f"""SELECT '{t}' AS table_name, column_name, CASE WHEN column_type LIKE 'TIMESTAMP%' THEN 'TIMESTAMP' WHEN column_type = 'VARCHAR' THEN 'TEXT' WHEN column_type = 'BIGINT' THEN 'LONG'
    WHEN column_type = 'INTEGER' THEN 'INT' WHEN column_type = 'FLOAT[]' THEN 'FLOATS' WHEN column_type = 'VARCHAR[]' THEN 'TEXTS' ELSE column_type END AS column_type FROM (DESCRIBE SELECT * FROM {t})"""
    for t in _TABLES
)


def _schemas(spark: SparkSession, d: str) -> dict[str, list[tuple[str, str]]]:
    """Columns of the real tables, and an internal one that must not show."""
    return {t: [(c, _KINDS[kind]) for c, kind in table(spark, d, t).dtypes] for t in _TABLES} | {"sqlite_stat": [("x", "TEXT")]}


@query(_COLUMNS)
def jn15_table_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.described(spark, _schemas(spark, d))


@query(f"SELECT * FROM ({_COLUMNS}) WHERE column_type IN ('TEXT', 'CLOB')")
def pf18_text_columns(spark: SparkSession, d: str) -> DataFrame:
    return catalog.described(spark, _schemas(spark, d), ["TEXT", "CLOB"])


@query("SELECT id, fetch_batch FROM article_info_long")
def sm1_backfill_all(spark: SparkSession, d: str) -> DataFrame:
    """A file stream taken in twice: the second call finds nothing new."""
    scratch = Scratch(spark, "io")
    scratch.write(table(spark, d, "article_info_long", "id", "fetch_batch"), "incoming")
    for _ in range(2):
        backfill.backfill(spark, scratch.path("incoming"), "id long, fetch_batch int", scratch.path("held"), scratch.path("state"), key=None)
    return spark.read.schema("id long, fetch_batch int").parquet(scratch.path("held"))


@query("SELECT DISTINCT doi FROM article_info_long WHERE doi IS NOT NULL UNION ALL SELECT doi FROM article_info_long WHERE doi IS NULL")
def sm1_backfill_keyed(spark: SparkSession, d: str) -> DataFrame:
    scratch = Scratch(spark, "io")
    scratch.write(table(spark, d, "article_info_long", "doi"), "incoming")
    backfill.backfill(spark, scratch.path("incoming"), "doi string", scratch.path("held"), scratch.path("state"), key="doi")
    return spark.read.schema("doi string").parquet(scratch.path("held"))


@query("SELECT window_start, count(*) AS n FROM (SELECT CAST(o_orderdate AS DATE) AS window_start FROM orders UNION ALL SELECT CAST(o_orderdate AS DATE) - 1 FROM orders) GROUP BY 1")
def sm1_daily_windows(spark: SparkSession, d: str) -> DataFrame:
    return backfill.daily(table(spark, d, "orders", "o_orderkey", "o_orderdate"), "o_orderdate")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type AS kind, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_event_windows(spark: SparkSession, d: str) -> DataFrame:
    """An extension: tumbling windows; the same function runs on a stream with a watermark."""
    return backfill.event_windows(table(spark, d, "events")).withColumn("total", F.round("total", 4))


