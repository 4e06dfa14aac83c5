"""Order, top rows, samples, de-duplication, set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import shared


def unique_names(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Repeated names get ``__1``, ``__2``, ... in the order given; single ones stay."""
    w = Window.partitionBy(name)
    n, k = F.count(F.lit(1)).over(w), F.row_number().over(w.orderBy(*order))
    return df.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit("__"), k.cast("string"))).otherwise(F.col(name)))


def numbered(df: DataFrame, *order: str | Column, name: str = "k") -> DataFrame:
    """Rows numbered from 1 in the order given, over the whole table and without a task that sees it whole: rows are dealt by ranges of the order
    and kept so (``checkpoint``), each range is numbered alone, and the ranges' counts add up. Equal rows of the order stay in one range."""
    placed = shared(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    counts, rows = sorted(placed.groupBy("_range").count().collect()), []  # a number for each partition
    for part, n in counts:
        rows.append((part, rows[-1][1] + rows[-1][2] if rows else 0, n))
    before = df.sparkSession.createDataFrame([r[:2] for r in rows], "_range int, _before long")
    k = F.row_number().over(Window.partitionBy("_range").orderBy(*order)) + F.col("_before")
    return placed.join(F.broadcast(before), "_range").withColumn(name, k).drop("_range", "_before")


def recent(df: DataFrame, n: int, date: str = "date", name: str = "name") -> DataFrame:
    """The latest n rows, in ascending order."""
    return df.orderBy(F.desc(date), F.desc(name)).limit(n).orderBy(date, name)


def sample(df: DataFrame, n: int, seed: int) -> DataFrame:
    return df.orderBy(F.rand(seed)).limit(n)


def first_of(df: DataFrame, key: str, *order: str) -> DataFrame:
    """One row for each key, the first in the order."""
    least = df.groupBy(key).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_x"))
    return least.select(*(F.col("_x")[c].alias(c) for c in df.columns))


def walk_recent(df: DataFrame, keep: Column, n: int, date: str = "date", key: str = "seq_id") -> DataFrame:
    """Going back in time, the first n rows that ``keep`` holds for."""
    return df.where(keep).orderBy(F.desc(date), key).limit(n)


def with_base(base: DataFrame, selected: DataFrame, included: DataFrame) -> DataFrame:
    """Base first, then the selection without it, then what is included and not yet there; column ``part`` orders them."""
    names = base.select("name")
    rest = selected.join(names, "name", "left_anti")
    more = included.join(names.unionByName(selected.select("name")).distinct(), "name", "left_anti")
    return base.withColumn("part", F.lit(0)).unionByName(rest.withColumn("part", F.lit(1))).unionByName(more.withColumn("part", F.lit(2)))


def common_length(df: DataFrame, column: str) -> DataFrame:
    """The most common length (the least of several) as one row ``n``."""
    return df.agg(F.mode(F.length(column), True).alias("n"))


def to_common_length(df: DataFrame, column: str, fill: str = "-") -> DataFrame:
    n = common_length(df, column)
    return df.crossJoin(F.broadcast(n)).withColumn(column, F.rpad(F.col(column), F.col("n"), F.lit(fill))).drop("n")


def left_part(df: DataFrame, shift: str) -> DataFrame:
    """The positions in front of the aligned part: max(-shift), at least 0, as one row ``left``."""
    return df.agg(F.greatest(F.lit(0), F.coalesce(F.max(-F.col(shift)), F.lit(0))).alias("left"))
