"""Joins that hold when one key owns a large share of the rows, and broadcasts behind a size check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scratch import Scratch

#: A side is broadcast only up to so many bytes by the optimizer's own estimate.
BROADCAST_BYTES = 16 << 20


def plan_bytes(df: DataFrame) -> int:
    """Size estimate of the optimised plan; for a file scan it starts from the bytes on disk."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def maybe_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``broadcast(df)`` if its estimated size is within the limit, else ``df`` and the join shuffles."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def salted_join(many: DataFrame, one: DataFrame, on: str, hot: DataFrame, salts: int = 64, how: str = "inner") -> DataFrame:
    """Equi-join of ``many`` with ``one`` (few rows a key); keys in ``hot`` are spread over ``salts`` tasks.

    ``hot`` has the column ``on`` alone, distinct; it is small by construction (keys above a share of the rows).
    Rows of ``one`` with a hot key are repeated once a salt, all other rows once. Null keys match nothing.
    """
    mark = F.broadcast(hot.select(on).withColumn("_hot", F.lit(True)))
    salt: Column = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    left = many.join(mark, on, "left").withColumn("_salt", salt).drop("_hot")
    right = one.join(mark, on, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return left.join(right, [on, "_salt"], how).drop("_salt")


def hot_values(rows: DataFrame, column: str, share: int = 200, least: int = 1000) -> DataFrame:
    """(column): the values that hold more than one in ``share`` of the rows: fewer than ``share``, whatever the input."""
    counts = rows.groupBy(column).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    return counts.join(F.broadcast(total)).filter((F.col("_n") > least) & (F.col("_n") > F.col("_all") / share)).select(column)


def ranked(rows: DataFrame, by: list[str], order: list, name: str) -> DataFrame:
    """rows with ``name``: their place from 1 in the order within ``by``, which may be empty or have few values.

    A window over so few groups would be so few tasks. Instead the rows are range-partitioned in the order and written, each
    range counts its own, and the counts of the ranges before it (a row a range) are added.
    """
    parts = rows.repartitionByRange(*[F.col(c) for c in by], *order).withColumn("_range", F.spark_partition_id())
    parts = Scratch(rows.sparkSession, "ranked").keep(parts, "ranges")
    sums = parts.groupBy(*by, "_range").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy(*by, "_range").orderBy(*order))
    of = sums.select(F.col("_range").alias("_r"), "_before", *[F.col(c).alias(f"_by{n}") for n, c in enumerate(by)])
    on = [F.col("_range") == F.col("_r"), *[F.col(c).eqNullSafe(F.col(f"_by{n}")) for n, c in enumerate(by)]]
    placed = parts.withColumn("_at", at).join(F.broadcast(of), on).withColumn(name, F.col("_before") + F.col("_at"))
    return placed.select(*rows.columns, name)


def distinct_lists(rows: DataFrame, key: list[str], column: str, name: str | None = None) -> DataFrame:
    """(key, name): the sorted different elements of an array column a key. Repeats go in the tasks and once more after the shuffle by
    (key, element), so what meets in one place is the result and no more."""
    each = rows.select(*key, F.explode(column).alias("_e")).filter("_e IS NOT NULL").distinct()
    return each.groupBy(*key).agg(F.array_sort(F.collect_list("_e")).alias(name or column))
