"""Lexicon building: membership of headwords in sources, frequency caps, rank fusion, coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.sources import store

NO_RANK = 99_999


def membership(sources: dict[str, DataFrame], key: str) -> DataFrame:
    """key and one flag a source, over the union of all keys. One shuffle: sources are stacked and grouped."""
    stacked = reduce(DataFrame.unionByName, (df.select(key).withColumn("__in", F.lit(name)) for name, df in sources.items()))
    return stacked.groupBy(key).agg(*(F.max(F.col("__in") == name).alias(f"in_{name}") for name in sources))


def with_rank(df: DataFrame, ranks: DataFrame, key: str) -> DataFrame:
    return df.join(ranks.select(key, "rank"), key, "left").withColumn("rank", F.coalesce("rank", F.lit(NO_RANK)))


def rare(pairs: DataFrame, value: str, most: int) -> DataFrame:
    """Pairs whose value is used by at most ``most`` keys. The values used by more are few, are written down, and are broadcast if they are."""
    common = pairs.groupBy(value).agg(F.count("*").alias("k")).where(F.col("k") > most).select(value)
    return pairs.join(sent(store.saved(common, store.new_folder(pairs.sparkSession, "common"))), value, "left_anti")


def first_ok(items: DataFrame, key: str, place: str, value: str, banned: DataFrame) -> DataFrame:
    """Items of keys whose first item isn't banned, without their banned items. Banned values are written down, and broadcast if they are few."""
    banned = sent(store.saved(banned.select(value).distinct(), store.new_folder(items.sparkSession, "banned")))
    bad = items.where(F.col(place) == 0).join(banned, value, "left_semi").select(key).distinct()
    return items.join(bad, key, "left_anti").join(banned, value, "left_anti")


def fused(lists: list[DataFrame], key: str, item: str, place: str, most: int) -> DataFrame:
    """key, item, score: sum over the lists of (most - place)."""
    stacked = reduce(DataFrame.unionByName, (df.select(key, item, place) for df in lists))
    return stacked.groupBy(key, item).agg(F.sum(most - F.col(place)).alias("score"))


def buckets(df: DataFrame, rank: Column, hit: Column, width: int = 1000, many: int | None = 99) -> DataFrame:
    """bucket, n, hits of ranks in buckets of a width; of the first ``many`` buckets, or of all."""
    cut = df.select(F.floor(rank / width).cast("long").alias("bucket"), hit.alias("h"))
    return (cut if many is None else cut.where(F.col("bucket") < many)).groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.col("h").cast("long")).alias("hits"))


def grams(text: Column, size: int) -> Column:
    """Distinct runs of ``size`` characters of a text; none for shorter ones."""
    n = F.length(text)
    return F.when(n >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - (size - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def contained(texts: DataFrame, patterns: DataFrame, text: str, pattern: str, size: int = 3) -> DataFrame:
    """(text, pattern): distinct patterns that occur inside distinct texts.

    A pattern is looked for by the rarest of its runs of ``size`` characters, counted over the texts, and then verified; a
    pattern with a run that no text has is dropped at once. Shorter patterns are runs of their own length. So a text makes
    at most ``size`` rows for each of its characters before the join. Empty patterns occur nowhere. Both sides are written
    down first, as they are read several times.
    """
    spark = texts.sparkSession
    keep = lambda df, c, name: store.saved(df.select(F.col(c).alias(name)).where(F.length(name) > 0).distinct(), store.new_folder(spark, name))
    longs, shorts = keep(texts, text, "__long"), keep(patterns, pattern, "__short")
    runs = lambda c, n: F.explode(grams(F.col(c), n))
    exact = longs.select("__long", F.explode(F.flatten(F.array(*(grams(F.col("__long"), n) for n in range(1, size))))).alias("__short")).join(sent(shorts.where(F.length("__short") < size)), "__short")
    of_long = longs.select("__long", runs("__long", size).alias("g"))
    of_short = shorts.where(F.length("__short") >= size).select("__short", runs("__short", size).alias("g"))
    n = store.saved(of_long.groupBy("g").agg(F.count("*").alias("n")), store.new_folder(spark, "grams"))
    # a pattern with a run that no text has is gone here
    rated = of_short.join(sent(n), "g", "left").groupBy("__short").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "g")).alias("best"))
    signs = store.saved(rated.where("best.n > 0").select("__short", F.col("best.g").alias("g")), store.new_folder(spark, "signs"))
    met = of_long.join(sent(signs), "g").where(F.contains("__long", F.col("__short"))).select("__long", "__short")
    out = met.unionByName(exact.select("__long", "__short"))
    return out.select(F.col("__long").alias(text), F.col("__short").alias(pattern))


#: Rows and characters of a saved table up to which it is broadcast: some 60 MB.
FEW_ROWS, FEW_CHARACTERS = 500_000, 10_000_000


def sent(df: DataFrame) -> DataFrame:
    """A saved table of texts and numbers, marked for a broadcast where it is small enough."""
    texts = [F.length(f.name) for f in df.schema.fields if f.dataType.simpleString() == "string"]
    rows, size = df.agg(F.count("*"), F.coalesce(F.sum(sum(texts, F.lit(0))), F.lit(0))).first()
    return F.broadcast(df) if rows <= FEW_ROWS and size <= FEW_CHARACTERS else df


PART, LONGER = 1, 2


def scope(seeds: DataFrame, heads: DataFrame) -> DataFrame:
    """number, kind, head: what each seed (number, seed) brings in: itself (0), heads inside it (1), then heads around it (2).

    A head belongs to the first seed that reaches it, and is a part before it is something longer. A head that is a seed itself
    is listed once more under an earlier seed that reaches it, but not under later ones.
    """
    seeds = store.saved(seeds.groupBy("seed").agg(F.min("number").alias("number")), store.new_folder(seeds.sparkSession, "seeds"))
    inside = contained(seeds, heads, "seed", "head").select("seed", "head", F.lit(PART).alias("kind"))
    around = contained(heads, seeds, "head", "seed").select("seed", "head", F.lit(LONGER).alias("kind"))
    met = inside.union(around).where("seed <> head").join(sent(seeds), "seed")
    first = met.groupBy("head").agg(F.min(F.struct("number", "kind")).alias("at"))
    own = seeds.select(F.col("seed").alias("head"), F.col("number").alias("own"))
    brought = first.join(own, "head", "left").where("own IS NULL OR at.number < own").select("at.number", "at.kind", "head")
    return seeds.select("number", F.lit(0).alias("kind"), F.col("seed").alias("head")).union(brought)


def scope_counts(scoped: DataFrame, seeds: DataFrame, others: DataFrame) -> DataFrame:
    """One row: seeds, parts, longer heads, distinct heads, and places of another dictionary's heads inside the seeds."""
    many = lambda k: F.sum((F.col("kind") == k).cast("long")).alias(("seeds", "parts", "longer")[k])
    found = contained(seeds, others, "seed", "head").where("seed <> head").agg(F.count("*").alias("parts_elsewhere"))
    return scoped.agg(many(0), many(PART), many(LONGER), F.count_distinct("head").alias("heads")).join(F.broadcast(found))  # one row
