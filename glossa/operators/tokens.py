"""Token tables: words of texts as rows, frequencies, n-grams, and ranks without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import let, words
from glossa.operators import neighbours as N
from glossa.operators.ranks import ranked_by
from glossa.sources import store


def tokens(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, pos (from 0), word."""
    return df.select(key, F.posexplode(words(F.col(text))).alias("pos", "word"))


def frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """word, freq. Counting starts in the map tasks."""
    return df.select(F.explode(words(F.col(text))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def bigrams(df: DataFrame, text: str = "text") -> DataFrame:
    """a, b of each word and the one after it, made inside the row; b is null for a text's last word."""
    w = words(F.col(text))
    return df.select(w.alias("w")).select(F.explode(F.transform("w", lambda x, i: F.struct(x.alias("a"), F.get("w", i + 1).alias("b")))).alias("p")).select("p.a", "p.b")


def counted(rows: DataFrame, tokens_col: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows of tokens: neighbouring countable tokens (a, b, n) and countable tokens (word, freq) found ``least`` times or more, and one row of sums.

    The sums (pairs, words) count rare ones as well. Tokens that start with punctuation or a digit aren't countable. A token is
    found at least as often as a pair that it begins or ends, so no frequency of a pair that is given is missing.
    """
    each = N.counted(rows, tokens_col, least)
    total = lambda kind, name: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0)).alias(name)
    return each.where(F.col("kind") == N.PAIR).select("a", "b", "n"), each.where(F.col("kind") == N.WORD).select(F.col("a").alias("word"), F.col("n").alias("freq")), each.agg(total(N.PAIRS, "pairs"), total(N.WORDS, "words"))


def _counted_words(df: DataFrame, text: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    return counted(df.select(words(F.col(text)).alias("tokens")), "tokens", least)


def _with_frequencies(pairs: DataFrame, single: DataFrame) -> DataFrame:
    a, b = (single.select(F.col("word").alias(c), F.col("freq").alias(f"f{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b")


def scores(counts: tuple[DataFrame, DataFrame, DataFrame], score: float, blocked=None) -> DataFrame:
    """a, b, n, mi of counted pairs with mutual information above ``score``, but for blocked ones.

    ``blocked(a, b)`` says which pairs must not become one token.
    """
    pairs, single, sums = counts
    if blocked is not None:
        pairs = pairs.where(~blocked(F.col("a"), F.col("b")))
    met = _with_frequencies(pairs, single).join(F.broadcast(sums))  # one row
    mi = F.log(F.col("pairs") / (F.col("fa").cast("double") * F.col("fb")) * F.col("n"))
    return met.withColumn("mi", F.round(mi, 6)).where(mi > score).select("a", "b", "n", "mi")


def bigram_scores(df: DataFrame, least: int, score: float, text: str = "text") -> DataFrame:
    """a, b, n, mi of pairs found at least ``least`` times, with mutual information above ``score``."""
    return scores(_counted_words(df, text, least), score)


def phrases(df: DataFrame, least: int, score: float, text: str = "text") -> DataFrame:
    """a, b, n, npmi of pairs found at least ``least`` times, with normalised mutual information above ``score``."""
    pairs, single, sums = _counted_words(df, text, least)
    met = _with_frequencies(pairs, single).join(F.broadcast(sums.select(F.col("words").cast("double").alias("total"))))  # one row
    share = lambda c: F.col(c) / F.col("total")
    npmi = F.log(share("n") / (share("fa") * share("fb"))) / -F.log(share("n"))
    return met.withColumn("npmi", F.round(npmi, 6)).where(npmi > score).select("a", "b", "n", "npmi")


def best_places(places: DataFrame, key: str) -> DataFrame:
    """Of places (key, pos, mi) those taken when the best goes first, of equal ones the first, and none next to a taken one is taken.

    A place that beats both neighbours is taken. Down a slope from there every second place is, so a place is taken when the
    runs of falling places that end in it, from the left and from the right, both have an even number of steps. So no rounds
    are needed, however long a run of places is.
    """
    line = Window.partitionBy(key).orderBy("pos")
    falls = lambda step, beats: (step("pos").over(line) == F.col("pos") + (-1 if step is F.lag else 1)) & beats(step("mi").over(line), F.col("mi"))
    marked = places.withColumns({
        "__l": F.when(~F.coalesce(falls(F.lag, lambda x, y: x >= y), F.lit(False)), F.col("pos")), "__r": F.when(~F.coalesce(falls(F.lead, lambda x, y: x > y), F.lit(False)), F.col("pos")),
    })
    left = F.col("pos") - F.max("__l").over(line.rowsBetween(Window.unboundedPreceding, 0))
    right = F.min("__r").over(line.rowsBetween(0, Window.unboundedFollowing)) - F.col("pos")
    return marked.withColumn("__ok", (left % 2 == 0) & (right % 2 == 0)).where("__ok").select(*places.columns)


def merge_pass(df: DataFrame, merges: DataFrame, key: str, tokens_col: str = "tokens") -> DataFrame:
    """Joins neighbouring tokens that are in merges (a, b, mi), best score first where pairs overlap, of equal ones the first."""
    found = N.places(df, merges, key, tokens_col).join(merges.select("a", "b", "mi"), ["a", "b"]).select(key, "pos", "mi")
    starts = best_places(found, key).groupBy(key).agg(F.array_sort(F.collect_list("pos")).alias("starts"))
    # dealt as one text, which is a third of the array, where that gives the same tokens back
    line = F.array_join(tokens_col, N.NEXT)
    same = F.coalesce(F.size(F.split(line, N.NEXT)) == F.size(tokens_col), F.lit(False))
    rest = [c for c in df.columns if c != tokens_col]
    dealt = df.select(*rest, F.when(same, line).alias("__line"), F.when(~same, F.col(tokens_col)).alias("__tokens"))
    joined = dealt.join(starts, key, "left").withColumn("starts", F.coalesce("starts", F.array().cast("array<int>")))

    def pieces(t: Column) -> Column:
        # pieces between the places, in order: tokens as they are, then the joined pair
        cuts = F.transform("starts", lambda s, i: F.struct(F.coalesce(F.get("starts", i - 1) + 2, F.lit(0)).alias("lo"), s.alias("hi")))
        head = F.flatten(F.transform(cuts, lambda c: F.concat(F.slice(t, c["lo"] + 1, c["hi"] - c["lo"]), F.array(F.concat(F.get(t, c["hi"]), F.get(t, c["hi"] + 1))))))
        end = F.coalesce(F.try_element_at("starts", F.lit(-1)) + 2, F.lit(0))
        return F.concat(head, F.slice(t, end + 1, F.greatest(F.size(t) - end, F.lit(0))))

    return joined.withColumn(tokens_col, let(F.coalesce("__tokens", F.split("__line", N.NEXT)), pieces)).select(*df.columns)


def merged_tokens(rows: DataFrame, key: str, passes: list[tuple[int, float]], blocked=None) -> DataFrame:
    """rows (key, tokens) after passes of (least count, least score): in each, pairs are counted anew and joined best first.

    Each pass is written down, as it is read by the next one's counts and merges.
    """
    spark = rows.sparkSession
    for least, score in passes:
        rows = store.saved(rows, store.new_folder(spark, "tokens"))
        merges = store.saved(scores(counted(rows, "tokens", least), score, blocked), store.new_folder(spark, "merges"))
        rows = merge_pass(rows, merges, key)
    return rows


def running(df: DataFrame, key: str, value: Column, name: str = "before", span: int = 4096, depth: int = 3) -> DataFrame:
    """df with the sum of a value over the rows of smaller keys; keys are distinct integers.

    Keys are cut into spans, whose sums are cut into spans again: sums inside a span and sums before it add up. With spans of
    4,096 and three depths the one task at the top has a row for each 7 * 10^10 keys.
    """
    v, at, total, up, inside = (f"__{x}{depth}" for x in ("value", "span", "total", "above", "inside"))
    ahead = lambda w: F.coalesce(F.sum(v).over(w.orderBy(key).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    given = df.withColumn(v, value.cast("long"))
    if depth == 0:
        return given.withColumn(name, ahead(Window)).drop(v)
    cut = given.withColumn(at, F.expr(f"{key} div {span}"))
    above = running(cut.groupBy(at).agg(F.sum(v).alias(total)), at, F.col(total), up, span, depth - 1).select(at, up)
    return cut.withColumn(inside, ahead(Window.partitionBy(at))).join(above, at).withColumn(name, F.col(inside) + F.col(up)).drop(v, at, inside, up)


def ranked(df: DataFrame, key: str, span: int = 4096) -> DataFrame:
    """df with ``rank``: the row's place, from 1, in the order of a distinct integer key; no task sorts all rows."""
    return running(df, key, F.lit(1), "rank", span).withColumn("rank", F.col("rank") + 1)


def numbered(df: DataFrame, text: str) -> DataFrame:
    """df with ``number``: the row's place, from 1, in the order of a distinct text."""
    return ranked_by(df, F.asc(text), name="number", kind="long")


def sampled(df: DataFrame, key: str, step: int, most: int, offset: int = 0) -> DataFrame:
    """Every step-th row in key order, of those whose place leaves ``offset``, the first ``most`` of them."""
    return ranked(df, key).where((F.pmod("rank", F.lit(step)) == offset) & (F.col("rank") <= step * most - (step - offset if offset else 0)))


def histogram(df: DataFrame, band: Column, value: Column) -> DataFrame:
    """band, n, mean, deviation and upper median of a value, by counts of distinct values."""
    counted = df.select(band.alias("band"), value.alias("value")).where("band IS NOT NULL").groupBy("band", "value").agg(F.count("*").alias("c"))
    up_to = Window.partitionBy("band").orderBy("value")
    total = counted.groupBy("band").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("value")).alias("s"), F.sum(F.col("c") * F.col("value") * F.col("value")).alias("q"))
    at = counted.withColumn("seen", F.sum("c").over(up_to)).join(total.select("band", "n"), "band").where("seen > n div 2").groupBy("band").agg(F.min("value").alias("upper_median"))
    mean = F.col("s") / F.col("n")
    deviation = F.when(F.col("n") > 1, F.sqrt(F.greatest((F.col("q") - F.col("s") * mean) / (F.col("n") - 1), F.lit(0.0))))
    return total.join(at, "band").select("band", "n", F.round(mean, 4).alias("mean"), F.round(deviation, 4).alias("deviation"), "upper_median")
