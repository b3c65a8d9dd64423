"""Dense numbers and running sums over a whole table, without sorting it in one task.

The rows are dealt to ranges of the order, each range is numbered or summed by itself, and what the
ranges before it hold is added: one row a range, which is all that meets in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import keep


def _ranged(df: DataFrame, order: list[str]) -> DataFrame:
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(parts, *order).withColumn("_rows_part", F.spark_partition_id()))


def running_sums(df: DataFrame, order: list[str], sums: dict[str, str], kind: str = "long") -> DataFrame:
    """Adds for each value: name of `sums` the value's sum over all rows before, by the order, as `kind`."""
    rows = _ranged(df, order)
    inside = Window.partitionBy("_rows_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_rows_part").agg(*[F.sum(v).alias(f"_rows_sum{i}") for i, v in enumerate(sums)])
    upto = Window.orderBy("_rows_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = parts.select("_rows_part", *[F.coalesce(F.sum(f"_rows_sum{i}").over(upto), F.lit(0)).alias(f"_rows_before{i}") for i in range(len(sums))])
    rows = rows.select("*", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(f"_rows_own{i}") for i, v in enumerate(sums)])
    rows = rows.join(F.broadcast(before), "_rows_part")
    named = [(F.col(f"_rows_own{i}") + F.col(f"_rows_before{i}")).cast(kind).alias(name) for i, name in enumerate(sums.values())]
    return rows.select(*[F.col(c) for c in df.columns if c not in sums.values()], *named)


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of `value` over all rows before, by the order, as a long."""
    return running_sums(df, order, {value: name})


def dense_number(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds 0, 1, 2, ... by the order."""
    return running_sums(df.withColumn("_rows_one", F.lit(1)), order, {"_rows_one": name}).drop("_rows_one")
