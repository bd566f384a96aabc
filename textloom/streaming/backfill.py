"""Incremental ingest: files as a stream, exactly the rows that are new, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def backfill(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, key: str | None = "pubmed_id") -> None:
    """Take in all files that are new since the last call. With ``key`` rows already taken are left out, without it they are kept."""

    def take(batch: DataFrame, _: int) -> None:
        if key is not None:
            from textloom.sources.readers import read_checkpoint

            held = read_checkpoint(spark, target, schema).select(key)
            named, unnamed = batch.filter(F.col(key).isNotNull()), batch.filter(F.col(key).isNull())
            batch = named.dropDuplicates([key]).join(held, key, "left_anti").select(*batch.columns).unionByName(unnamed)
        batch.write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def resumed(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str, keys: list[str], work) -> None:  # noqa: ANN001
    """Run ``work`` on the keys of new files that have no result yet, and append its results."""

    def take(batch: DataFrame, _: int) -> None:
        from textloom.operators.qa import pending
        from textloom.sources.readers import read_checkpoint

        results = work(batch)
        done = read_checkpoint(spark, target, results.schema.simpleString()[7:-1].replace(":", " "))
        work(pending(batch, done, keys)).write.mode("append").parquet(target)

    stream = spark.readStream.schema(schema).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily(rows: DataFrame, date: str, key: str | None = None) -> DataFrame:
    """``window_start, n``: rows of each day's window, which holds the next day, too; with ``key`` each key counts once a window."""
    both = rows.select("*", F.explode(F.array(F.to_date(date), F.date_sub(F.to_date(date), 1))).alias("window_start"))
    count = F.count("*") if key is None else F.count_distinct(key)
    return both.groupBy("window_start").agg(count.alias("n"))


def event_windows(events: DataFrame, time: str = "ts", kind: str = "event_type", value: str = "value", length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """``start, kind, n, total`` of tumbling windows; the watermark bounds the state when ``events`` is a stream."""
    held = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late) if events.isStreaming else events
    rows = held.groupBy(F.window(time, length).alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return rows.select(F.col("w.start").alias("start"), "kind", "n", "total")
