"""Places of rows in an order, and the last row before another, over range partitions.

Rows are sorted over range partitions of the whole order (a composite key, so that ties of the first column are cut as well) and
written once; a row's place is its place in its partition and the sizes of the partitions before. No task sees all rows. The
sizes are a row for each partition, as many as Spark makes, and are added up on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources import store

ROW = "__sorted_row"


def sorted_rows(df: DataFrame, *order: Column) -> DataFrame:
    """df in range partitions of an order, sorted, saved, with ROW: partition and place in it."""
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(ROW, F.monotonically_increasing_id())
    return store.saved(rows, store.new_folder(df.sparkSession, "sorted"))


def _part() -> Column:
    return F.shiftright(ROW, 33)


def ranked_by(df: DataFrame, *order: Column, name: str = "rank", kind: str = "int") -> DataFrame:
    """df with each row's place, from 1, in an order; rows that tie in all of it have any order among them."""
    rows = sorted_rows(df, *order)
    sizes = rows.groupBy(_part().alias("part")).agg(F.count("*").alias("n")).collect()
    before, seen = [], 0
    for r in sorted(sizes):
        before.append((r["part"], seen))
        seen += r["n"]
    if not before:
        return df.withColumn(name, F.lit(0).cast(kind))
    # a row for each partition
    ahead = F.broadcast(df.sparkSession.createDataFrame(before, "__part long, __before long"))
    place = F.col(ROW) - F.shiftleft(F.col("__part"), 33) + 1 + F.col("__before")
    return rows.join(ahead, _part() == F.col("__part")).withColumn(name, place.cast(kind)).drop(ROW, "__part", "__before")


def page(df: DataFrame, offset: int, size: int, *order: Column) -> DataFrame:
    """The rows at some places of an order: each task keeps the first ``offset + size`` of its own."""
    return df.orderBy(*order).offset(offset).limit(size)


def as_of(values: DataFrame, starts: DataFrame, value: str, start: str, label: str) -> DataFrame:
    """values with ``label`` of the last start that isn't above the value; null where there is none.

    Values and starts are sorted as one table, starts before equal values, equal values in any order, so that one value that
    most rows have is cut over several partitions. Of equal starts the one with the greatest label counts. The last start of
    each partition is carried to those that follow.
    """
    names = values.columns
    salt = F.xxhash64(*(F.col(c) for c in names)) if names else F.lit(0)
    ours = values.select(F.col(value).alias("__at"), F.lit(1).alias("__kind"), salt.alias("__salt"), F.struct(*names).alias("__row_of"))
    theirs = starts.select(F.col(start).alias("__at"), F.lit(0).alias("__kind"), F.lit(0).cast("long").alias("__salt"), F.col(label).alias("__label")).where("__at IS NOT NULL")
    both = ours.unionByName(theirs, allowMissingColumns=True)
    rows = sorted_rows(both, F.asc("__at"), F.asc("__kind"), F.asc_nulls_first("__label"), F.asc("__salt"))
    last = rows.where("__kind = 0").groupBy(_part().alias("part")).agg(F.max(ROW).alias(ROW)).select(ROW)
    ends = rows.join(F.broadcast(last), ROW).select(_part().alias("part"), "__label").collect()  # a row for each partition
    parts = sorted(r["part"] for r in rows.select(_part().alias("part")).distinct().collect())
    held, carry, by = None, [], {r["part"]: r["__label"] for r in ends}
    for p in parts:
        carry.append((p, held))
        held = by.get(p, held)
    if not parts:
        return values.withColumn(label, F.lit(None).cast(starts.schema[label].dataType))
    from pyspark.sql.types import LongType, StructField, StructType

    ahead = F.broadcast(values.sparkSession.createDataFrame(carry, StructType([StructField("__part", LongType()), StructField("__carried", starts.schema[label].dataType)])))
    line = Window.partitionBy("__part").orderBy(ROW).rowsBetween(Window.unboundedPreceding, 0)
    met = rows.join(ahead, _part() == F.col("__part")).withColumn("__found", F.coalesce(F.last("__label", ignorenulls=True).over(line), "__carried"))
    return met.where("__kind = 1").select("__row_of.*", F.when(F.col("__at").isNotNull(), F.col("__found")).alias(label))
