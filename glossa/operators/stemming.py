"""Stems from morphological analyses: a dictionary of the shortest stems, segments as stem tokens, and what that covers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.morphology import stem_of, stemmed_text
from glossa.operators.tokens import numbered


def stem_dictionary(candidates: DataFrame, frequent: DataFrame, as_they_are: list[str]) -> DataFrame:
    """surf, stem, analysed: of a surface's candidates (surf, place, stem) the shortest that isn't empty, of equal ones the first, in lower case.

    Surfaces whose stem is in ``as_they_are`` keep their own form. Without a stem, frequent surfaces (surf) in lower case
    stand for themselves; others have none and are left out, but for their row with a null stem.
    """
    best = candidates.groupBy("surf").agg(F.min(F.when(F.col("stem") != "", F.struct(F.length("stem").alias("n"), "place", "stem")))["stem"].alias("stem"))
    own = F.lower("surf")
    known = best.join(frequent.select("surf", F.lit(True).alias("often")).distinct(), "surf", "left")
    stem = F.when(F.col("stem").isin(*as_they_are), own).when(F.col("stem").isNotNull(), F.lower("stem")).when(F.col("often") & (own == F.col("surf")), own)
    return known.select("surf", stem.alias("stem"), F.col("stem").isNotNull().alias("analysed"))


def stem_tokens(segments: DataFrame, dictionary: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens, n, bad: `pieces/stem#surface` for each word of a segment, a compound's stems one by one.

    Words that start with punctuation are left out. A word without a stem stands for itself in lower case, and is bad unless
    it starts with a capital. Words are made distinct inside a segment before they meet the dictionary.
    """
    surfs = F.filter(F.split(text, " "), lambda t: (t != "") & ~t.rlike(r"^\p{P}"))
    each = segments.select(key, F.posexplode(surfs).alias("pos", "surf"))
    words = each.groupBy("surf", key).agg(F.collect_list("pos").alias("at"))
    met = words.join(dictionary.select("surf", "stem").where("stem IS NOT NULL"), "surf", "left").select(key, F.explode("at").alias("pos"), "surf", "stem")
    parts = F.split(F.coalesce("stem", F.lower("surf")), r"\+")
    written = F.array_join(F.transform(parts, lambda p: F.concat(F.size(parts).cast("string"), F.lit("/"), p, F.lit("#"), F.col("surf"))), " ")
    capital = F.col("surf").rlike(r"^\p{Lu}")
    row = F.struct("pos", written.alias("t"))
    grouped = met.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("rows"), F.sum(F.size(parts)).alias("n"), F.sum((F.col("stem").isNull() & ~capital).cast("long")).alias("bad"))
    return grouped.select(key, F.array_join(F.transform("rows", lambda r: r["t"]), " ").alias("tokens"), "n", "bad")


def quality(stemmed: DataFrame) -> DataFrame:
    """One row: segments with no, one and more unknown words."""
    many = lambda c: F.sum(c.cast("long"))
    return stemmed.agg(F.count("*").alias("total"), many(F.col("bad") == 0).alias("none"), many(F.col("bad") == 1).alias("one"), many(F.col("bad") > 1).alias("more"))


def coverage(dictionary: DataFrame) -> DataFrame:
    """One row: surfaces, those with a stem, and distinct stems."""
    return dictionary.agg(F.count("*").alias("surfaces"), F.count("stem").alias("stemmed"), F.count_distinct("stem").alias("stems"))


def stem_file(dictionary: DataFrame) -> DataFrame:
    """number, surf, stem in lower case, without surfaces that are their own stem; of surfaces that differ in case one row."""
    rows = dictionary.where("stem IS NOT NULL").select(F.lower("surf").alias("surf"), F.lower("stem").alias("stem")).where("surf <> stem")
    return numbered(rows.groupBy("surf").agg(F.min("stem").alias("stem")), "surf").select("number", "surf", "stem")


def candidates(groups: DataFrame) -> DataFrame:
    """surf, place, stem: what each analysis of a surface form (surf, analyses) gives; an empty stem for forms that have none.

    A form whose first analysis ends with a question mark is unknown. Twin words with different endings give no stem.
    """
    known = ~F.endswith(F.get("analyses", F.lit(0)), F.lit("?"))
    each = groups.select("surf", F.posexplode_outer(F.when(known, F.col("analyses"))).alias("place", "analysis"))
    found = each.select("surf", F.coalesce("place", F.lit(0)).alias("place"), F.when(F.col("analysis").isNotNull(), stem_of(F.col("analysis"))).alias("s"))
    return found.select("surf", "place", F.when(~F.col("s.incorrect"), stemmed_text(F.col("s"))).otherwise("").alias("stem"))
