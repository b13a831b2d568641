"""The dictionary's indexes, and look-ups by characters, syllables, target phrases and headwords inside a query.

Entries have entry_id, simp, trad, pinyin (array of text, tone), senses (array of text) and freq. Postings are flat tables,
made inside rows and kept apart from the entries; a look-up finds candidates by relational division over the postings of
the query's parts, and then verifies the candidates' entries. Queries are short strings, parsed on the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.target import query_tokens, tokens
from glossa.functions.text import let
from glossa.operators.ranks import ranked_by

LONGEST_HEAD = 16


def characters(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))


def hanzi_postings(entries: DataFrame) -> DataFrame:
    """hanzi, entry_id, in_simp, in_trad, simp_count, trad_count (distinct characters of either form)."""
    simp, trad = characters(F.col("simp")), characters(F.col("trad"))
    each = entries.select("entry_id", simp.alias("s"), trad.alias("t")).select("entry_id", "s", "t", F.explode(F.array_union("s", "t")).alias("hanzi"))
    return each.select("hanzi", "entry_id", F.array_contains("s", F.col("hanzi")).alias("in_simp"), F.array_contains("t", F.col("hanzi")).alias("in_trad"), F.size("s").alias("simp_count"), F.size("t").alias("trad_count"))


def syllable_postings(entries: DataFrame) -> DataFrame:
    """syllable, tone, entry_id, n (distinct toned syllables of the entry)."""
    known = F.array_distinct(F.filter(F.transform("pinyin", lambda s: F.struct(F.lower(s["text"]).alias("syllable"), s["tone"].alias("tone"))), lambda s: s["tone"] >= 0))
    each = entries.select("entry_id", known.alias("k")).select("entry_id", F.size("k").alias("n"), F.explode("k").alias("s"))
    return each.select("s.syllable", "s.tone", "entry_id", "n")


def special(sense: Column) -> Column:
    """Senses that list measure words stay out of the index."""
    return F.startswith(sense, F.lit("SZ:"))


def _sense_tokens(entries: DataFrame) -> DataFrame:
    each = entries.select("entry_id", F.posexplode("senses").alias("sense_ix", "sense")).where(~special(F.col("sense")))
    return each.select("entry_id", "sense_ix", tokens(F.col("sense")).alias("tokens"))


def word_postings(entries: DataFrame, stops: list[str]) -> DataFrame:
    """word, entry_id, sense_ix: norms of words, and of a compound's halves but for stop words."""
    plain = F.filter("tokens", lambda t: ~t["norm"].isin("NNN", "ZHO"))
    halves = F.filter(F.flatten(F.transform(plain, lambda t: F.array(t["first"], t["second"]))), lambda h: h.isNotNull() & (h != "") & ~h.isin(*stops))
    found = F.array_distinct(F.concat(F.transform(plain, lambda t: t["norm"]), halves))
    return _sense_tokens(entries).select(F.explode(found).alias("word"), "entry_id", "sense_ix")


def prefix_counts(entries: DataFrame, sign: int = 1) -> DataFrame:
    """word, count: surface words with how often senses hold them; of a compound the whole without its pipe and both halves."""
    plain = F.filter("tokens", lambda t: ~t["norm"].isin("NNN", "ZHO"))
    parts = lambda t: F.when(t["cut"].isNull(), F.array(t["surf"])).otherwise(F.array(F.replace(t["surf"], F.lit("|"), F.lit("")), F.replace(F.substring(t["surf"], F.lit(1), t["cut"]), F.lit("|"), F.lit("")), F.substring(t["surf"], t["cut"] + 2, F.length(t["surf"]))))
    return _sense_tokens(entries).select(F.explode(F.flatten(F.transform(plain, parts))).alias("word")).groupBy("word").agg((F.count("*") * sign).alias("count"))


def reindexed(postings: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Postings without those of the removed entries, and with those of the added ones (a posting table of their own)."""
    return postings.join(removed.select("entry_id").distinct(), "entry_id", "left_anti").unionByName(added)


def recounted(counts: DataFrame, *deltas: DataFrame) -> DataFrame:
    """Prefix counts with signed deltas; words that nothing holds any more go."""
    stacked = reduce(DataFrame.unionByName, deltas, counts)
    return stacked.groupBy("word").agg(F.sum("count").cast("long").alias("count")).where("count > 0")


def hanzi_candidates(postings: DataFrame, query: str) -> DataFrame:
    """entry_id: with one character, entries that have it in either form; with more, those that have all in one form."""
    wanted = sorted(set(query))
    found = postings.where(F.col("hanzi").isin(wanted)).groupBy("entry_id").agg(F.sum(F.col("in_simp").cast("int")).alias("s"), F.sum(F.col("in_trad").cast("int")).alias("t"))
    return found.where((F.col("s") == len(wanted)) | (F.col("t") == len(wanted)) | F.lit(len(wanted) == 1)).select("entry_id")


def pinyin_order(pinyin: Column) -> Column:
    """Sort key of a run of syllables: text without case, tone, then case; a prefix comes first."""
    return F.transform(pinyin, lambda s: F.struct(F.lower(s["text"]).alias("a"), s["tone"].alias("b"), s["text"].alias("c")))


def hanzi_lookup(entries: DataFrame, postings: DataFrame, query: str) -> DataFrame:
    """entry_id, start, length, rank: entries that hold the query's characters in a row, in the simplified form or else the traditional one."""
    q = query.upper().replace(" ", "")
    if not q:
        return entries.select("entry_id", F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit(0).alias("rank")).limit(0)
    at = F.coalesce(F.nullif(F.instr("simp", F.lit(q)), F.lit(0)), F.nullif(F.instr("trad", F.lit(q)), F.lit(0)))
    found = entries.join(hanzi_candidates(postings, q), "entry_id").withColumn("start", at - 1).where("start IS NOT NULL")
    keyed = found.select("entry_id", "start", F.lit(len(q)).alias("length"), pinyin_order(F.col("pinyin")).alias("__a"), F.length("simp").alias("__b"))
    return ranked_by(keyed, F.asc("start"), F.asc("__a"), F.asc("__b"), F.asc("entry_id")).drop("__a", "__b")


def pinyin_candidates(postings: DataFrame, query: list[tuple[str, int]]) -> DataFrame:
    """entry_id: entries that have all the query's syllables; one without a tone stands for all its tones."""
    open_ = {s for s, tone in query if tone < 0}
    toned = {(s, tone) for s, tone in query if tone >= 0 and s not in open_}
    key = F.when(F.col("syllable").isin(*open_), F.col("syllable")) if open_ else F.lit(None).cast("string")
    for s, tone in sorted(toned):
        key = F.coalesce(key, F.when((F.col("syllable") == s) & (F.col("tone") == tone), F.lit(f"{s}{tone}")))
    found = postings.withColumn("key", key).where("key IS NOT NULL").groupBy("entry_id").agg(F.count_distinct("key").alias("n"))
    return found.where(F.col("n") == len(open_) + len(toned)).select("entry_id")


def pinyin_lookup(entries: DataFrame, postings: DataFrame, query: list[tuple[str, int]]) -> DataFrame:
    """entry_id, start (of the first run of syllables that fits), n_syllables, rank."""
    from glossa.functions.pinyin import contiguous

    found = entries.join(pinyin_candidates(postings, query), "entry_id").withColumn("start", contiguous(F.col("pinyin"), query)).where("start IS NOT NULL")
    keyed = found.select("entry_id", "start", F.size("pinyin").alias("n_syllables"), pinyin_order(F.col("pinyin")).alias("__a"))
    return ranked_by(keyed, F.asc("n_syllables"), F.asc("start"), F.asc("__a"), F.asc("entry_id")).drop("__a")


def _fits(tokens_: Column, i: Column, query: list[str], stops: list[str]) -> Column:
    ok = i + len(query) <= F.size(tokens_)
    alone = (F.get(tokens_, i + len(query) - 1)["sub"] == 0) & ((i == F.size(tokens_) - 1) | (F.get(tokens_, i + 1)["sub"] == 0))
    for j, norm in enumerate(query):
        t = F.get(tokens_, i + j)
        equal = t["norm"] == norm
        if norm in stops:
            equal = equal & (t["sub"] == 0) & ((i == F.size(tokens_) - 1) | (F.get(tokens_, i + 1)["sub"] == 0))
        halves = norm not in stops or len(query) > 1
        if j == 0 and halves:
            equal = equal | F.coalesce(t["second"] == norm, F.lit(False))
        if j == len(query) - 1 and halves:
            equal = equal | F.coalesce(t["first"] == norm, F.lit(False))
        ok = ok & F.coalesce(equal, F.lit(False))
    return ok


def phrase_match(tokens_: Column, query: list[str], stops: list[str]) -> Column:
    """(start, end) in characters of the first run of tokens that fits the query; null without one.

    The first word may be the second half of a compound, the last word the first half; the highlight is cut there. A stop
    word counts only where it is a whole sub-sense. Tokens and place are computed once a row, wherever a filter on the
    result is pushed to.
    """
    def match(ts):
        first_of = F.get(F.filter(F.transform(ts, lambda t, i: i), lambda i: _fits(ts, i, query, stops)), F.lit(0))

        def cut(at):
            first, last = F.get(ts, at), F.get(ts, at + len(query) - 1)
            start = first["start"] + F.when(F.coalesce(first["second"] == query[0], F.lit(False)), first["cut"]).otherwise(0)
            end = last["start"] + F.when(F.coalesce(last["first"] == query[-1], F.lit(False)), last["cut"]).otherwise(F.length(last["surf"]))
            return F.when(at.isNotNull(), F.struct(start.alias("start"), end.alias("end")))

        return F.when(F.size(ts) >= len(query), let(first_of, cut))

    return let(tokens_, match)


def word_candidates(postings: DataFrame, words: list[str]) -> DataFrame:
    """entry_id, sense_ix: senses that hold all of the words."""
    wanted = sorted(set(words))
    found = postings.where(F.col("word").isin(wanted)).groupBy("entry_id", "sense_ix").agg(F.count_distinct("word").alias("n"))
    return found.where(F.col("n") == len(wanted)).select("entry_id", "sense_ix")


def target_lookup(entries: DataFrame, postings: DataFrame, query: str, stops: list[str]) -> DataFrame:
    """entry_id, sense_ix, start, end, rank: for each entry its first sense that holds the phrase, most frequent entries first."""
    q = query_tokens(query)
    keys = [t for t in q if t not in ("NNN", "ZHO")]
    empty = entries.select("entry_id", *(F.lit(0).alias(c) for c in ("sense_ix", "start", "end", "rank"))).limit(0)
    if not keys:
        return empty
    senses = entries.join(word_candidates(postings, keys), "entry_id").select("entry_id", "freq", "sense_ix", tokens(F.get("senses", F.col("sense_ix"))).alias("tokens"))
    hit = senses.withColumn("at", phrase_match(F.col("tokens"), q, stops)).where("at IS NOT NULL")
    first = hit.groupBy("entry_id").agg(F.first("freq").alias("freq"), F.min(F.struct("sense_ix", "at")).alias("m"))
    return ranked_by(first.select("entry_id", "m.sense_ix", "m.at.start", "m.at.end", "freq"), F.desc("freq"), F.asc("entry_id")).drop("freq")


def annotated(entries: DataFrame, query: str) -> DataFrame:
    """start, length, script, entry_id: at each place of the query the longest headword of either script that reaches further than all before.

    The query's substrings are a small table; they meet the headwords in an equi-join. Of an entry that fits in both scripts
    the simplified form is given.
    """
    spark = entries.sparkSession
    cuts = [(i, n, query[i : i + n]) for i in range(len(query)) for n in range(1, min(LONGEST_HEAD, len(query) - i) + 1)]
    if not cuts:
        return entries.select(F.lit(0).alias("start"), F.lit(0).alias("length"), F.lit("").alias("script"), "entry_id").limit(0)
    table = F.broadcast(spark.createDataFrame(cuts, "start int, length int, head string"))  # bounded by the query's length
    met = reduce(DataFrame.unionByName, (entries.select("entry_id", F.col(c).alias("head"), F.lit(c).alias("script")).join(table, "head") for c in ("simp", "trad")))
    best = met.groupBy("start").agg(F.max("length").alias("length"))
    line = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # a row for each place of the query
    far = best.withColumn("far", F.coalesce(F.max(F.col("start") + F.col("length")).over(line), F.lit(0))).where("start + length > far")
    return met.join(F.broadcast(far.select("start", "length")), ["start", "length"]).groupBy("start", "length", "entry_id").agg(F.min("script").alias("script")).select("start", "length", "script", "entry_id")


def cascade(*found: DataFrame) -> DataFrame:
    """mode, entry_id of the first of several results that has rows."""
    stacked = reduce(DataFrame.unionByName, (df.select(F.lit(i).alias("mode"), "entry_id") for i, df in enumerate(found, 1)))
    return stacked.join(F.broadcast(stacked.agg(F.min("mode").alias("mode"))), "mode")  # one row
