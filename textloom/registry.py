"""Every query of the library by name, with the SQL it is checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.packed import LABELS, NAMES, split_packed
from textloom.plans.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL if there is any."""

    def register(f: Query) -> Query:
        key = name or f.__name__
        if key in QUERIES:
            raise ValueError(f"{key} is registered twice")
        QUERIES[key] = f
        if sql is not None:
            ORACLE[key] = sql
        return f

    return register


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per author and topic name, with its position in the field."""
    authors = split_packed(table(spark, d, "article_info_long", "id", "authors"), "authors", NAMES, ["id"])
    topics = split_packed(table(spark, d, "topic_modelling", "doc_id", "multiple_topics"), "multiple_topics", LABELS, ["doc_id"])
    return authors.select(F.lit("authors").alias("field_name"), F.col("id").cast("long").alias("record_id"), "pos", "val").unionByName(
        topics.select(F.lit("multiple_topics").alias("field_name"), F.col("doc_id").cast("long").alias("record_id"), "pos", "val")
    )


def load() -> None:
    """Import the query modules of all families."""
    import importlib
    import pkgutil

    from textloom import queries

    for module in pkgutil.iter_modules(queries.__path__):
        importlib.import_module(f"{queries.__name__}.{module.name}")
