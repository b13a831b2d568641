"""Ranges: lookups of values in sorted ranges, islands of contiguous ranges, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.ranks import as_of


def lookup(values: DataFrame, ranges: DataFrame, value: str, out: str, default) -> DataFrame:
    """values with the label of the range [lo, hi] that starts last at or before the value, where it reaches that far, or the default.

    A range of any width is one row of the sort that brings starts and values together. Of ranges with the same start the
    widest counts; a range inside another hides it from its start on.
    """
    starts = ranges.select("lo", F.struct("hi", F.col("label").alias("label")).alias("__range")).where("hi IS NOT NULL")
    met = as_of(values, starts, value, "lo", "__range")
    inside = F.col("__range.hi") >= F.col(value)
    return met.select(*(F.col(c) for c in values.columns), F.when(inside, F.coalesce(F.col("__range.label"), F.lit(default))).otherwise(F.lit(default)).alias(out))


def merged(ranges: DataFrame, label: str) -> DataFrame:
    """label, lo, hi: contiguous ranges of one label as one range."""
    line = Window.partitionBy(label).orderBy("lo")
    starts = F.when(F.lag("hi").over(line) + 1 == F.col("lo"), 0).otherwise(1)
    island = F.sum("starts").over(line)
    return ranges.withColumn("starts", starts).withColumn("island", island).groupBy(label, "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def retained(files: DataFrame, when: str, key: str, last: int) -> DataFrame:
    """The first file of each month, and the last few of all."""
    month = F.year(when) * 100 + F.month(when)
    first = files.groupBy(month.alias("month")).agg(F.min(F.struct(when, key))[key].alias(key)).select(key)
    newest = files.orderBy(F.desc(when), F.desc(key)).limit(last).select(key)
    return files.join(first.union(newest).distinct(), key, "left_semi")
