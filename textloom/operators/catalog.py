"""Tables that describe tables, and plain SQL surfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


def register_table_info(spark: SparkSession, schemas: dict[str, list[tuple[str, str]]], name: str = "table_info") -> None:
    """A table function ``table_info(table)`` with ``cid, column_name, column_type``."""
    known = {t: list(c) for t, c in schemas.items()}

    class TableInfo:
        def eval(self, wanted: str):  # noqa: ANN201
            for i, (column, kind) in enumerate(known.get(wanted, [])):
                yield i, column, kind

    spark.udtf.register(name, udtf(TableInfo, returnType="cid int, column_name string, column_type string"))


def described(spark: SparkSession, schemas: dict[str, list[tuple[str, str]]], types: list[str] | None = None) -> DataFrame:
    """``table_name, column_name, column_type`` of all tables by a lateral left join; internal tables are left out."""
    register_table_info(spark, schemas)
    spark.createDataFrame([(t, "table") for t in sorted(schemas)], "name string, type string").createOrReplaceTempView("textloom_tables")
    rows = spark.sql(
        """SELECT m.name AS table_name, p.column_name, p.column_type FROM textloom_tables m LEFT JOIN LATERAL table_info(m.name) p ON m.name <> p.column_name
        WHERE m.type IN ('table', 'view') AND m.name NOT LIKE 'sqlite_%'"""
    )
    return rows.filter(F.col("column_type").isin(types)) if types else rows


def first_column(spark: SparkSession, sql: str) -> DataFrame:
    """The first column of a query as text, ``None`` for null; errors are raised."""
    df = spark.sql(sql)
    return df.select(F.coalesce(F.col(f"`{df.columns[0]}`").cast("string"), F.lit("None")).alias("value"))


def ensure_rows(spark: SparkSession, name: str, schema: str, rows: list[tuple] | DataFrame, path: str | None = None) -> DataFrame:
    """Create a table if there is none, insert the rows, and list the tables; ``path`` is where its files lie."""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet" + (f" LOCATION '{path}'" if path else ""))
    (rows if isinstance(rows, DataFrame) else spark.createDataFrame(rows, schema)).write.insertInto(name)
    return spark.sql("SHOW TABLES").select("tableName")
