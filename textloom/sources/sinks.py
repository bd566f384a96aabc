"""Sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_spaced(df: DataFrame, path: str) -> None:
    """Space-separated lines without header, as evaluation tools read them; nulls become ``null``."""
    df.select(F.concat_ws(" ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("null")) for c in df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_delimited(df: DataFrame, path: str, sep: str = ",", header: bool = True, escaped: bool = False) -> None:
    """Quoted where needed; nulls and empty texts are empty fields.

    ``escaped`` writes nulls as ``\\N``, and line ends as ``\\n`` and ``\\r``, so every row stays on one
    line and the files can be split; ``read_delimited`` undoes it.
    """
    if escaped:
        text = {c: F.col(f"`{c}`") for c, kind in df.dtypes if kind == "string"}
        for old, new in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r")):
            text = {c: F.replace(x, F.lit(old), F.lit(new)) for c, x in text.items()}
        df = df.withColumns(text)
    null = "\\N" if escaped else ""
    df.write.mode("overwrite").csv(path, sep=sep, header=header, quote='"', escape='"', nullValue=null, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def append_by_term(df: DataFrame, path: str, term: str) -> None:
    """Append rows to the partition of a search term."""
    df.withColumn("search_term", F.lit(term)).write.mode("append").partitionBy("search_term").parquet(path)


def replace_table(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Replace a table and read it back; ``path`` is where its files lie, else they go to the warehouse."""
    writer = df.write.mode("overwrite")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return df.sparkSession.table(name)


def write_sqlite(df: DataFrame, path: str, table: str) -> None:
    """One SQLite file with one table, written by the one task that such a file allows, row by row as they arrive."""
    columns = ", ".join(f'"{c}"' for c in df.columns)
    marks = ", ".join("?" for _ in df.columns)

    def store(frames):  # noqa: ANN001, ANN202
        import sqlite3

        import pandas as pd

        n = 0
        with sqlite3.connect(path) as connection:
            connection.execute(f'DROP TABLE IF EXISTS "{table}"')
            connection.execute(f'CREATE TABLE "{table}" ({columns})')
            for frame in frames:
                rows = frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None)
                connection.executemany(f'INSERT INTO "{table}" VALUES ({marks})', rows)
                n += len(frame)
        yield pd.DataFrame({"n": [n]})

    df.coalesce(1).mapInPandas(store, "n long").collect()


def property_graph(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices, each once, and edges of a property graph; all rows of the input."""
    ends = edges.select(F.col("node_1").alias("node"), "chunk_id").unionByName(edges.select(F.col("node_2").alias("node"), "chunk_id"))
    return ends.groupBy("node").agg(F.min("chunk_id").alias("first_chunk")), edges.select(F.col("node_1").alias("source"), F.col("node_2").alias("target"), F.col("edge").alias("relationship"))


def send_rows(df: DataFrame, send: Callable[[list], None], batch: int = 500) -> None:
    """Hand the rows to an outside store in batches, from the tasks that hold them."""

    def post(rows) -> None:  # noqa: ANN001
        held = []
        for row in rows:
            held.append(row)
            if len(held) == batch:
                send(held)
                held = []
        if held:
            send(held)

    df.foreachPartition(post)


def write_metrics(metrics: DataFrame, path: str, title: str) -> None:
    """``name: value`` lines between banners."""
    lines = metrics.orderBy("metric").select(F.concat_ws(": ", "metric", F.col("value").cast("string")).alias("value"))
    spark = metrics.sparkSession
    banner = spark.createDataFrame([(0, f"===== {title} ====="), (2, "=" * (12 + len(title)))], "part int, value string")
    lines.select(F.lit(1).alias("part"), "value").unionByName(banner).coalesce(1).sortWithinPartitions("part", "value").select("value").write.mode("overwrite").text(path)


def append_checkpoint(df: DataFrame, path: str, keys: list[str]) -> None:
    """Append results; a key comes once a call."""
    df.dropDuplicates(keys).write.mode("append").parquet(path)
