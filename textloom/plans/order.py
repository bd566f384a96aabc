"""Consecutive numbers and running sums in an order, without gathering rows or groups in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.plans.scratch import Scratch

#: A key of more rows than this is met by SALTS tasks.
LARGE, SALTS = 128, 32


def _placed(df: DataFrame, by: list[Column]) -> DataFrame:
    """The rows in sorted range partitions, written once, with ``__part`` and their place in it, ``__at``."""
    row = F.monotonically_increasing_id()
    parts = {"__part": F.shiftrightunsigned(row, 33), "__at": row.bitwiseAND(F.lit(2**33 - 1))}
    return Scratch(df.sparkSession, "order").write(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns(parts), "rows")


def numbered(df: DataFrame, by: list[Column], name: str = "n", start: int = 1) -> DataFrame:
    """Adds ``name``: numbers from ``start`` in the order of ``by``. Each range partition begins where those before it end."""
    rows = _placed(df, by)
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__m"))  # one row a partition
    before = F.sum("__m").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__before"))
    return rows.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__before") + F.col("__at") + start).drop("__part", "__at", "__before")


def running(df: DataFrame, group: list[str], by: list[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to the row within its group, in the order of ``by``.

    A group may lie in several range partitions, so one that holds a third of all rows is summed by
    many tasks; what earlier partitions hold of a group is added to its rows in the later ones.
    """
    rows = _placed(df.withColumn("__value", value), [*map(F.col, group), *by])
    inside = F.sum("__value").over(Window.partitionBy("__part", *group).orderBy("__at").rowsBetween(Window.unboundedPreceding, 0))
    parts = rows.groupBy(*group, "__part").agg(F.sum("__value").alias("__m"))
    before = F.sum("__m").over(Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    # only groups that go on in another partition have anything before
    offsets = parts.withColumn("__before", before).filter("__before is not null").drop("__m")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in group] + [F.col("r.__part") == F.col("o.__part")]
    joined = rows.withColumn(name, inside).alias("r").join(offsets.alias("o"), same, "left")
    return joined.select(*(F.col(f"r.{c}") for c in df.columns), (F.col(f"r.{name}") + F.coalesce("o.__before", F.lit(0))).alias(name))


def met(rows: DataFrame, key: str, left: dict[str, str], right: dict[str, str]) -> DataFrame:
    """The self-join of ``rows`` on ``key``, each side's columns renamed as given; the pairs of a large key are made by SALTS tasks."""
    large = rows.groupBy(key).count().filter(F.col("count") > LARGE).select(key, F.lit(True).alias("__large"))
    rows = rows.join(large, key, "left")
    one = F.when(F.col("__large"), F.pmod(F.xxhash64(*left), F.lit(SALTS)).cast("int")).otherwise(0)
    every = F.explode(F.when(F.col("__large"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0))))
    a = rows.select(key, one.alias("__salt"), *(F.col(c).alias(n) for c, n in left.items()))
    b = rows.select(key, every.alias("__salt"), *(F.col(c).alias(n) for c, n in right.items()))
    return a.join(b, [key, "__salt"]).drop("__salt")
