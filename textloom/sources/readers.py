"""Readers with declared schemas; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.plans.order import numbered

JUDGEMENTS = "userId string, queryId string, documentId string, relevanceLevel string"
QA_TUPLES = "queryid string, documentid string, relevance int, query_text string, document_text string, text_selection string"
TRIPLES = "query string, doc_pos string, doc_neg string"
LABELED = "query_id string, doc_id string, query string, doc string"
ARTICLES = "id long, pubmed_id string, title string, publication_date string, journal string, abstract string, conclusions string, methods string, results string, copyrights string, doi string, authors string"


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "\t", header: bool = False, columns: list[str] | None = None, quote: str = '"', escaped: bool = False) -> DataFrame:
    """A delimited file; a row that doesn't fit the schema fails the job. Projection reaches the scan.

    ``escaped`` reads nulls, line ends and backslashes as ``write_delimited`` escapes them.
    """
    df = spark.read.csv(path, schema=schema, sep=sep, header=header, quote=quote, escape='"', mode="FAILFAST", enforceSchema=True, nullValue="\\N" if escaped else "", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    df = df.select(*columns) if columns else df
    return df.withColumns({f.name: _unescaped(F.col(f"`{f.name}`")) for f in df.schema if f.dataType == T.StringType()}) if escaped else df


def _unescaped(text):  # noqa: ANN001, ANN202
    for letter, mark in (("n", "\n"), ("r", "\r")):  # after an even number of backslashes
        text = F.regexp_replace(text, f"(?<!\\\\)((?:\\\\\\\\)*)\\\\{letter}", f"$1{mark}")
    return F.replace(text, F.lit("\\\\"), F.lit("\\"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no, value``: lines with their place, which sorts by file name, then by place in the file."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))
    return spark.read.text(path).select(place.alias("line_no"), "value")


def _fields(lines: DataFrame) -> DataFrame:
    return lines.withColumn("f", F.split(F.trim("value"), "\\s+")).filter(F.length(F.trim("value")) > 0)


def read_qrels(spark: SparkSession, path: str, least: float = 0.0001) -> DataFrame:
    """``qid, docid, grade`` from four white-space separated fields; the last line of a pair wins, malformed lines raise."""
    rows = _fields(read_lines(spark, path))
    grade = F.get("f", F.lit(3)).try_cast("double")
    checked = F.when((F.size("f") < 4) | grade.isNull(), F.raise_error(F.concat(F.lit("malformed qrels line: "), "value"))).otherwise(grade)
    rows = rows.select("line_no", F.get("f", F.lit(0)).alias("qid"), F.get("f", F.lit(2)).alias("docid"), checked.alias("grade")).filter(F.col("grade") > least)
    return rows.groupBy("qid", "docid").agg(F.max_by("grade", "line_no").alias("grade"))


def read_ranking(spark: SparkSession, path: str, qrels: DataFrame | None = None) -> DataFrame:
    """``qid, docid, rank`` from four or six fields; the order of lines is the rank, other widths raise."""
    rows = _fields(read_lines(spark, path))
    doc = F.when(F.size("f") == 4, F.get("f", F.lit(1))).when(F.size("f") == 6, F.get("f", F.lit(2))).otherwise(F.raise_error(F.concat(F.lit("malformed ranking line: "), "value")))
    rows = rows.select("line_no", F.get("f", F.lit(0)).alias("qid"), doc.alias("docid"))
    if qrels is not None:
        rows = rows.join(qrels.select("qid", "docid"), ["qid", "docid"], "left_semi")
    return rows.select("qid", "docid", F.row_number().over(Window.partitionBy("qid").orderBy("line_no")).alias("rank"))


def read_fields(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated lines with exactly the schema's fields; empty lines are skipped, others raise."""
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    rows = spark.read.text(path).filter(F.length("value") > 0).withColumn("f", F.split("value", "\t", -1))
    checked = F.when(F.size("f") != len(names), F.raise_error(F.concat(F.lit("wrong number of fields: "), "value"))).otherwise(F.col("f"))
    return rows.select(checked.alias("f")).select(*(F.get("f", F.lit(i)).alias(n) for i, n in enumerate(names)))


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``text, source``: whole files with where they came from."""
    return spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("source"))


def read_checkpoint(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table, or an empty one where nothing was written yet."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def latest_checkpoint(files: DataFrame, name: str, model: str) -> DataFrame:
    """The file of the model's latest epoch; no row if it has none."""
    epoch = F.regexp_extract(name, "epoch_(\\d+)", 1)
    rows = files.filter(F.col(name).startswith(model) & (epoch != "")).select(F.col(name).alias("file"), epoch.cast("int").alias("epoch"))
    return rows.groupBy().agg(F.max_by("file", "epoch").alias("file"), F.max("epoch").alias("epoch")).filter("file is not null")


def read_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """``token, id, vector`` from lines of a token and its numbers; ids from 1, 0 is for padding."""
    rows = read_lines(spark, path).withColumn("f", F.split("value", " "))
    vector = F.transform(F.slice("f", 2, width), lambda x: x.cast("float"))
    return numbered(rows.select("line_no", F.get("f", F.lit(0)).alias("token"), vector.alias("vector")), [F.col("line_no")], "id").select("token", F.col("id").cast("int").alias("id"), "vector")


def read_sqlite(spark: SparkSession, path: str, sql: str, schema: str) -> DataFrame:
    """Rows of a query against a SQLite file, read in one task: the predicate and limit run inside SQLite."""

    def scan(frames):  # noqa: ANN001, ANN202
        import sqlite3

        import pandas as pd

        for frame in frames:
            for where in frame["path"]:
                with sqlite3.connect(where) as connection:
                    cursor = connection.execute(sql)
                    while rows := cursor.fetchmany(10_000):
                        yield pd.DataFrame(rows, columns=[c[0] for c in cursor.description])

    return spark.createDataFrame([(path,)], "path string").mapInPandas(scan, schema)
