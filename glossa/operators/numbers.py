"""Distinct numbers for rows, out of a space of numbers some of which are in use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.operators.ranks import as_of, ranked_by
from glossa.sources import store


def free_numbers(wanted: DataFrame, taken: DataFrame, place: str, out: str) -> DataFrame:
    """wanted with the free number at a place (from 0) among the numbers that ``taken`` (number, distinct) doesn't have.

    Before the r-th taken number t there are t - r + 1 free ones, so the free number at a place is the place and the taken
    numbers up to there: the last of them by an as-of look-up.
    """
    before = ranked_by(taken.select("number"), F.asc("number"), name="__rank", kind="long").select((F.col("number") - F.col("__rank") + 1).alias("__free"), F.col("__rank").alias("__upto"))
    met = as_of(wanted, before, place, "__free", "__upto")
    return met.withColumn(out, F.col(place) + F.coalesce("__upto", F.lit(0))).drop("__upto")


def unique_numbers(rows: DataFrame, key: Column, space: int, taken: DataFrame | None = None, out: str = "number", rounds: int = 8) -> DataFrame:
    """rows, each with a number below ``space`` of its own that ``taken`` (number) doesn't have; no row is lost.

    A row's first number is a hash of its key. Where rows meet, or meet a taken number, one keeps it at most, and the others
    hash again with the row and the round; what is left after some rounds, as in a space that is almost full, gets the
    free numbers from the lowest on. Rows and each round are written down. More rows than free numbers are an error.
    """
    spark = rows.sparkSession
    keep = lambda df, name: store.saved(df, store.new_folder(spark, name))
    given = keep(rows.withColumn("__row", F.monotonically_increasing_id()).withColumn("__key", F.xxhash64(key)), "rows")
    used = taken.select(F.col("number").cast("long").alias("number")).distinct() if taken is not None else spark.createDataFrame([], "number long")
    used = keep(used.where((F.col("number") >= 0) & (F.col("number") < space)), "taken")
    n = given.count()
    if used.count() + n > space:
        raise ValueError(f"{n} rows don't fit beside the numbers in use in a space of {space}")
    left, got = given.select("__row", "__key"), spark.createDataFrame([], "__row long, number long")
    for i in range(rounds):
        tries = left.withColumn("number", F.pmod(F.col("__key") if i == 0 else F.xxhash64("__key", "__row", F.lit(i)), F.lit(space).cast("long")))
        # of rows that meet, the first keeps the number
        best = tries.groupBy("number").agg(F.min("__row").alias("__row")).join(used, "number", "left_anti").select("__row", "number")
        best = keep(best, "won")
        got, used = got.union(best), used.union(best.select("number"))
        left = keep(left.join(best, "__row", "left_anti"), "left")
        if left.isEmpty():
            break
    else:
        placed = ranked_by(left.select("__row"), F.asc("__row"), name="__place", kind="long").withColumn("__place", F.col("__place") - 1)
        got = got.union(free_numbers(placed, used, "__place", "number").select("__row", "number"))
    return given.join(got.withColumnRenamed("number", out), "__row").drop("__row", "__key")
