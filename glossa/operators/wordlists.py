"""Lexicon building from word lists: dictionaries side by side, translation logs, suggestions for new headwords."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.target import without_punctuation
from glossa.operators.tokens import running


def side_by_side(first: DataFrame, second: DataFrame, near: DataFrame, head: str, most: int) -> DataFrame:
    """head, first, second, near: both dictionaries' entries of each headword (full outer), and its nearest words, best first.

    near has head, word and sim. Of a headword's near words the ``most`` best go on, of equal ones the first.
    """
    lists = (df.groupBy(head).agg(F.array_join(F.array_sort(F.collect_set("entry")), " @@ ").alias(name)) for df, name in ((first, "first"), (second, "second")))
    both = reduce(lambda a, b: a.join(b, head, "full_outer"), lists)
    place = F.row_number().over(Window.partitionBy(head).orderBy(F.desc("sim"), "word"))
    best = near.withColumn("place", place).where(F.col("place") <= most).groupBy(head).agg(F.array_sort(F.collect_list(F.struct("place", "word"))).alias("near"))
    return both.join(best, head, "left").select(head, "first", "second", F.array_join(F.transform("near", lambda x: x["word"]), " ").alias("near"))


# The two kinds of lines of a translation log.
SENTENCE, HYPOTHESIS = r"^[^\]]+\] SENT[^:]+:(.+)$", r"^[^\]]+\] \[([^\]]+)\] (.+)$"


def hypotheses(log: DataFrame) -> DataFrame:
    """sentence (number), source, place, score, text of a translation log (line, text) of SENT lines and scored lines after each.

    Texts lose joiners, punctuation and a leading article; those with digits, empty ones and repeats in a sentence go.
    """
    kinds = log.select("line", F.regexp_extract("text", SENTENCE, 1).alias("source"), F.regexp_extract("text", HYPOTHESIS, 1).alias("score"), F.regexp_extract("text", HYPOTHESIS, 2).alias("raw"))
    grouped = running(kinds, "line", F.col("source") != "", "before")
    heads = grouped.where("source <> ''").select((F.col("before") + 1).alias("sentence"), F.regexp_replace("source", r"[ \t]", "").alias("source"))
    clean = without_punctuation(F.trim(F.replace("raw", F.lit("￭ "), F.lit(""))))
    found = grouped.where("score <> ''").select(F.col("before").alias("sentence"), "line", F.col("score").try_cast("double").alias("score"), clean.alias("text")).where("text <> ''")
    once = found.groupBy("sentence", "text").agg(F.min_by(F.struct("line", "score"), "line").alias("at"))
    place = F.row_number().over(Window.partitionBy("sentence").orderBy("at.line")) - 1
    return once.withColumn("place", place).join(heads, "sentence").select("sentence", "source", "place", "at.score", "text")


def hypothesis_counts(found: DataFrame) -> DataFrame:
    """text, n, words: in how many sentences a hypothesis stands, and how many words that makes."""
    return found.groupBy("text").agg(F.count("*").alias("n")).withColumn("words", F.col("n") * F.size(F.split("text", " ")))


def suggestions(query: Column, heads: DataFrame, info: DataFrame, ids: DataFrame) -> DataFrame:
    """id, place, trads, readings for each character of simplified queries (ids has id and the query's column).

    Forms of known headwords (simp, trad, pinyin as an array of text) come first; then the character's own variants and
    readings (info has hanzi, trad and pinyin as arrays). Of a character without a known headword, the first variant that
    shares its first reading comes before the others. Lists have no repeats.
    """
    each = ids.select("id", query.alias("q")).select("id", "q", F.posexplode(F.filter(F.split("q", ""), lambda c: c != "")).alias("place", "hanzi"))
    known = each.join(heads.select(F.col("simp").alias("q"), "trad", "pinyin"), "q").groupBy("id", "place").agg(F.array_sort(F.collect_set(F.struct(F.substring(F.col("trad"), F.col("place") + 1, F.lit(1)).alias("t"), F.get("pinyin", F.col("place")).alias("p")))).alias("known"))
    own = each.join(info, "hanzi", "left")
    fits = own.select("id", "place", F.posexplode_outer("trad").alias("nth", "variant"), F.get("pinyin", F.lit(0)).alias("favourite"))
    fits = fits.join(info.select(F.col("hanzi").alias("variant"), F.col("pinyin").alias("theirs")), "variant").where(F.array_contains("theirs", F.col("favourite"))).groupBy("id", "place").agg(F.min_by("variant", "nth").alias("best"))
    none = F.array().cast("array<string>")
    met = own.join(known, ["id", "place"], "left").join(fits, ["id", "place"], "left")
    first = F.when(F.col("known").isNotNull(), F.transform("known", lambda x: x["t"])).when(F.col("best").isNotNull(), F.array("best")).otherwise(none)
    return met.select(
        "id", "place", F.array_distinct(F.concat(first, F.coalesce("trad", none))).alias("trads"),
        F.array_distinct(F.concat(F.coalesce(F.transform("known", lambda x: x["p"]), none), F.coalesce("pinyin", none))).alias("readings"), F.col("known").isNotNull().alias("known"),
    )


def head_variants(heads: DataFrame, info: DataFrame) -> DataFrame:
    """simp, trad of headwords without repeats whose every traditional character is the simplified one or one of its variants."""
    chars = heads.select("simp", "trad").distinct().withColumn("c", F.arrays_zip(F.filter(F.split("simp", ""), lambda c: c != "").alias("s"), F.filter(F.split("trad", ""), lambda c: c != "").alias("t")))
    each = chars.select("simp", "trad", F.explode("c").alias("c")).join(info.select(F.col("hanzi").alias("hanzi"), F.col("trad").alias("forms")), F.col("c.s") == F.col("hanzi"), "left")
    ok = (F.col("c.s") == F.col("c.t")) | F.coalesce(F.array_contains("forms", F.col("c.t")), F.lit(False))
    return each.groupBy("simp", "trad").agg(F.min(ok).alias("ok")).where("ok").select("simp", "trad")


def compared_heads(new: DataFrame, reference: DataFrame) -> DataFrame:
    """id, in_reference, simp_known: whether a new headword (id, simp, trad, pinyin) is in a reference as it is, or its simplified form alone."""
    whole = reference.select("simp", "trad", "pinyin", F.lit(True).alias("w")).distinct()
    simp = reference.select("simp", F.lit(True).alias("s")).distinct()
    met = new.join(whole, ["simp", "trad", "pinyin"], "left").join(simp, "simp", "left")
    return met.select("id", F.coalesce("w", F.lit(False)).alias("in_reference"), F.coalesce("s", F.lit(False)).alias("simp_known"))


def tokenised(chunks: DataFrame, tokens: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens: each text's chunks (parted by spaces) replaced by their tokens (chunk, tokens); a chunk without any stays as it is."""
    each = chunks.select(key, F.posexplode(F.filter(F.split(text, " +"), lambda c: c != "")).alias("pos", "chunk"))
    met = each.join(tokens.select("chunk", "tokens"), "chunk", "left").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("tokens", "chunk").alias("t")))).alias("rows"))
    return met.select(key, F.array_join(F.transform("rows", lambda r: r["t"]), " ").alias("tokens"))


def exported(segments: DataFrame, last_change, written_at) -> DataFrame | None:
    """segments to write, or nothing where what was written is newer than the last change."""
    return None if written_at is not None and last_change is not None and written_at >= last_change else segments


def corpus_files(segments: DataFrame) -> dict[str, DataFrame]:
    """The tables of a built corpus: whole segments, and source, lower-case target and stems by id."""
    ids = F.col("segment_id")
    return {
        "segments": segments, "zh": segments.select(ids.alias("id"), F.col("src").alias("text")), "hulo": segments.select(ids.alias("id"), F.lower("trg").alias("text")),
        "hustem": segments.select(ids.alias("id"), F.array_join(F.transform("stems", lambda t: F.lower(t)), " ").alias("text")),
    }


def ten_columns(segments: DataFrame) -> DataFrame:
    """The ten columns of a remixed corpus file, maps and alignments as text."""
    spans = lambda c: F.array_join(F.transform(c, lambda p: F.concat_ws("/", p["a"].cast("string"), p["b"].cast("string"))), " ")
    pairs = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["ix1"].cast("string"), F.lit("-"), x["ix2"].cast("string"), F.lit("!"), x["score"].cast("string"))), " ")
    return segments.select(
        F.col("segment_id").alias("ix"), F.col("src").alias("zh"), F.col("trg").alias("hu"), spans("src_map").alias("zh_map"), spans("trg_map").alias("hu_map"),
        F.array_join("src_tokens", " ").alias("zh_tokens"), F.array_join("stems", " ").alias("hu_stems"), pairs("align").alias("zh_hu"), pairs("back").alias("hu_zh"), F.size("align").alias("n_pairs"),
    )
