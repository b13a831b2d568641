"""Parallel segments and collocations: pairs of turns, co-occurrence counts, association scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import words
from glossa.operators.lexicon import sent
from glossa.sources import store


#: Distinct words of segments of a task that makes pairs of them.
TASK_WORDS = 100_000


def turn_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, src, trg: each user turn with the assistant turn that follows it."""
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    told = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("trg"))
    return asked.join(told, ["conv_id", "turn"])


def zipped(left: DataFrame, right: DataFrame, line: str = "line") -> DataFrame:
    """Two line tables joined by line number; a line that only one of them has is an error when it is read."""
    both = left.join(right.withColumnRenamed("text", "other"), line, "full_outer")
    bad = F.col("text").isNull() | F.col("other").isNull()
    return both.select(line, F.when(bad, F.raise_error(F.concat(F.lit("line counts differ at line "), F.col(line).cast("string")))).otherwise(F.col("text")).alias("text"), "other")


def counted(pairs: DataFrame, least_src: int, least_trg: int, src: str = "src", trg: str = "trg") -> DataFrame:
    """src, trg, n, src_freq, trg_freq: token pairs of all segments, with multiplicity, of words frequent enough.

    Words are counted by segment and written down once. Frequent words get numbers; where they are few they are broadcast, and
    only they are brought together again, so that pairs are made inside rows and counted as two numbers.
    """
    spark = pairs.sparkSession
    side = lambda c, k: F.transform(words(F.coalesce(F.col(c), F.lit(""))), lambda w: F.struct(F.lit(k).alias("side"), w.alias("word")))
    # numbered before words become rows
    numbered = pairs.select(F.monotonically_increasing_id().alias("row"), F.concat(side(src, 0), side(trg, 1)).alias("w"))
    each = numbered.select("row", F.explode("w").alias("x")).select("row", "x.*")
    each = store.saved(each.groupBy("row", "side", "word").agg(F.count("*").alias("times")), store.new_folder(spark, "segments"))
    often = each.groupBy("side", "word").agg(F.sum("times").alias("freq")).where(F.col("freq") >= F.when(F.col("side") == 0, least_src).otherwise(least_trg))
    often = store.saved(often.withColumn("id", F.monotonically_increasing_id()), store.new_folder(spark, "often"))
    own = lambda k: F.collect_list(F.when(F.col("side") == k, F.struct("id", "times")))
    # dealt to as many tasks as the words need, so that what a task counts doesn't grow with the segments
    met = each.join(sent(often.select("side", "word", "id")), ["side", "word"]).repartition(-(-each.count() // TASK_WORDS) or 1, "row")
    kept = met.groupBy("row").agg(own(0).alias("s"), own(1).alias("t"))
    met = kept.select(F.explode("s").alias("a"), "t").select("a", F.explode("t").alias("b"))
    n = met.groupBy(F.col("a.id").alias("__a"), F.col("b.id").alias("__b")).agg(F.sum(F.col("a.times") * F.col("b.times")).alias("n"))
    named = lambda name, key: often.select(F.col("id").alias(key), F.col("word").alias(name), F.col("freq").alias(f"{name}_freq"))
    return n.join(named("src", "__a"), "__a").join(named("trg", "__b"), "__b").select("src", "trg", "n", "src_freq", "trg_freq")


def _xlnx(x: Column) -> Column:
    # F.log gives null where x isn't positive; a condition of its own would make the row's method too long to be compiled
    return x * F.log(x)


def mutual_information(n: Column, a: Column, b: Column, total: Column) -> Column:
    return F.log(total / (a.cast("double") * b.cast("double")) * n)


def log_likelihood(n: Column, src: Column, trg: Column, total: Column) -> Column:
    """Dunning's ratio with the fourth cell as N - b - c + a. A cell that isn't positive gives null."""
    a = n.cast("double")
    b, c = src - a, trg - a
    d = total - b - c + a
    x = _xlnx
    return 2 * (x(a) + x(b) + x(c) + x(d) - x(a + b) - x(a + c) - x(b + d) - x(c + d) + x(a + b + c + d))


def scored(pairs: DataFrame, counts: DataFrame, least_ll: float, least_mi: float) -> DataFrame:
    """src, trg, n, ll, mi of pairs over either threshold."""
    total = F.broadcast(pairs.agg(F.count("*").cast("double").alias("total")))  # one row
    both = counts.join(total)
    both = both.withColumns({"ll": log_likelihood(F.col("n"), F.col("src_freq"), F.col("trg_freq"), F.col("total")), "mi": mutual_information(F.col("n"), F.col("src_freq"), F.col("trg_freq"), F.col("total"))})
    return both.where((F.col("ll") >= least_ll) | (F.col("mi") >= least_mi)).select("src", "trg", "n", F.round("ll", 4).alias("ll"), F.round("mi", 4).alias("mi"))


def capped(pairs: DataFrame, a: str, b: str, most_a: int, most_b: int) -> DataFrame:
    """Pairs of which neither value is in more pairs than its cap, as one row for each a with its list."""
    few = lambda c, k: pairs.groupBy(c).agg(F.count("*").alias("k")).where(F.col("k") <= k).select(c)
    kept = pairs.join(few(a, most_a), a, "left_semi").join(few(b, most_b), b, "left_semi")
    return kept.groupBy(a).agg(F.count("*").alias("n_items"), F.array_join(F.array_sort(F.collect_list(b)), " ").alias("items"))
