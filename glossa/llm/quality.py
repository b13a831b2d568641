"""Quality rules by cross-document line frequency, in DataFrame functions alone.

Lines are normalised (lower case, digits as 0, runs of white space as one space, trimmed) and hashed; for each host the
distinct documents that hold a line are counted. Exact copies of a text are one document in that count. A line held by
at least ``min_docs`` documents of its host is boilerplate. That is a number and no share of the host, so that the limit
doesn't grow with the host; a host of fewer documents has no boilerplate. A document is rejected when base rules fail or
when, without its boilerplate, it has under ``min_words`` words or under ``min_left`` of its words.

Defined cases: a null text is empty and is rejected for want of words; a null host and an empty one are one host; equal rows give
equal results; an empty table gives no rows; a text of any length is read whole. Columns beside those named here pass
through ``clean`` untouched, and working columns are named so as not to clash with them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import all_of, let, unused, words_of

MIN_WORDS, REPEAT_PERCENT = 50, 50
MIN_DOCS, MIN_LEFT = 20, 0.3
WORD = r"[^\x20\x09-\x0D]"
#: Bits of a packed window that hold its place.
PLACE_BITS = 20


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that are found twice or more in the text.

    Windows are 64-bit hashes. Each is packed with its place into one long (44 bits of hash, 20 of place) so that a
    sort of plain longs brings equal windows together, and equal ones are confirmed on all 64 bits. Texts of over
    2^20 words, and those in which different windows share 44 bits, take a sort of (hash, place) pairs instead.
    """
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(
        let(
            F.filter(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), lambda h, i: i < F.size(words) - 2),
            lambda hashes: F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(
                _covered(F.when(F.size(hashes) < (1 << PLACE_BITS), _places_packed(hashes)).otherwise(_places_paired(hashes)))
            ),
        )
    )


def _places_packed(hashes: Column) -> Column:
    """Sorted places of the windows that are not alone."""
    low = F.lit((1 << PLACE_BITS) - 1)
    packed = F.sort_array(F.transform(hashes, lambda h, i: F.shiftleft(F.shiftright(h, PLACE_BITS), PLACE_BITS).bitwiseOR(i.cast("long"))))
    place = lambda x: x.bitwiseAND(low).cast("int")
    same = lambda s, x, j: F.coalesce(F.get(hashes, place(F.get(s, j))) == F.get(hashes, place(x)), F.lit(False))
    # neighbours that share the high bits and are different windows, which could part equal ones
    clash = lambda s: F.exists(F.filter(s, lambda x, j: (F.shiftright(x, PLACE_BITS) == F.shiftright(F.get(s, j - 1), PLACE_BITS)) & ~same(s, x, j - 1)), lambda x: F.lit(True))
    return let(packed, lambda s: F.when(clash(s), _places_paired(hashes)).otherwise(F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j + 1) | same(s, x, j - 1)), place))))


def _places_paired(hashes: Column) -> Column:
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
    return let(pairs, lambda s: F.sort_array(F.transform(F.filter(s, lambda x, j: same(s, x, j + 1) | same(s, x, j - 1)), lambda x: x["i"])))


def _covered(places: Column) -> Column:
    """Words covered by three-word windows at sorted places."""
    return let(
        places,
        lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda a, b: F.coalesce(F.least(b - a, F.lit(3)), F.lit(3))), F.lit(0), lambda s, x: s + x),
    )


def line_key(line: Column) -> Column:
    """Hash of a normalised line."""
    return F.xxhash64(F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), r"[0-9]", "0"), r"[\x20\x09-\x0D]+", " ")))


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, the counts of the base rules and base_failed, and the keys __host and __text of the line statistics."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("__host"), F.md5(text).alias("__text"), text.alias("text"), words_of(text).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(WORD))
    counted = keyed.select(
        "doc_id", "__host", "__text",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        let(F.col("words"), repeated_words).cast("long").alias("n_repeat_words"),
    )
    return counted.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words")))


def line_table(docs: DataFrame) -> DataFrame:
    """One row for each host and distinct text: __host, __text, lines (line hash, words in all such lines)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.transform(F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)), lambda x: F.struct(line_key(x).alias("line"), F.size(words_of(x)).alias("words")))
    return docs.select(F.coalesce("source", F.lit("")).alias("__host"), F.md5(text).alias("__text"), lines.alias("lines")).dropDuplicates(["__host", "__text"])


def boilerplate(table: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """__host, line: the lines at or above the limit. Counts are pre-aggregated, so a hot host or line is no hot group."""
    held = table.select("__host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["line"]))).alias("line"))
    return held.groupBy("__host", "line").agg(F.count("*").alias("held")).where(F.col("held") >= min_docs).select("__host", "line")


def removed_words(table: DataFrame, common: DataFrame) -> DataFrame:
    """__host, __text, removed (words in boilerplate lines), gone (their hashes), for texts with such lines only."""
    each = table.select("__host", "__text", F.explode("lines").alias("x")).select("__host", "__text", "x.line", "x.words")
    return each.join(common, ["__host", "line"]).groupBy("__host", "__text").agg(F.sum("words").alias("removed"), F.collect_set("line").alias("gone"))


def _judged(base: DataFrame, removed: DataFrame, min_left: float) -> DataFrame:
    left = F.col("n_words") - F.coalesce("removed", F.lit(0))
    return base.join(removed, ["__host", "__text"], "left").withColumns(
        {"n_left_words": left.cast("long"), "kept": ~F.col("base_failed") & (left >= MIN_WORDS) & (left >= min_left * F.col("n_words"))}
    )


def quality(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """One row a document: its counts, base_failed, n_left_words (outside boilerplate) and kept."""
    table = line_table(docs)
    removed = removed_words(table, boilerplate(table, min_docs)).drop("gone")
    return _judged(base_rules(docs), removed, min_left).drop("__host", "__text", "removed")


def clean(docs: DataFrame, min_docs: int = MIN_DOCS, min_left: float = MIN_LEFT) -> DataFrame:
    """The documents that are kept, without their boilerplate lines; columns as they came, n_chars brought up to date."""
    table = line_table(docs)
    removed = removed_words(table, boilerplate(table, min_docs))
    ident, of, at, gone = unused(docs, "id", "of", "at", "gone")
    kept = _judged(base_rules(docs), removed, min_left).where("kept").select(F.col("doc_id").alias(ident), F.col("__text").alias(of), F.col("__host").alias(at), F.col("gone").alias(gone)).distinct()
    text = F.coalesce("text", F.lit(""))
    joined = docs.join(kept, F.col("doc_id").eqNullSafe(F.col(ident)) & (F.md5(text) == F.col(of)) & (F.coalesce("source", F.lit("")) == F.col(at)))
    rest = F.array_join(F.filter(F.split("text", "\n"), lambda x: ~(x.rlike(WORD) & F.array_contains(gone, line_key(x)))), "\n")
    out = joined.withColumn("text", F.when(F.col(gone).isNotNull(), rest).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*all_of(docs))
