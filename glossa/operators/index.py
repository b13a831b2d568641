"""Inverted indexes: postings, relational division, phrases, prefixes, longest covers, segmentation."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.text import ACCENTED, PLAIN, folded, let, packed_prefix, words
from glossa.operators.lexicon import sent
from glossa.operators.tokens import tokens
from glossa.sources import store


def postings(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """word, key, line_ix: the lines of each text that hold a word, made distinct inside the row."""
    lines = df.select(key, F.posexplode(F.split(F.col(text), "\n")).alias("line_ix", "line"))
    return lines.select(F.explode(F.array_distinct(words(F.col("line")))).alias("word"), key, "line_ix")


def having_all(posts: DataFrame, terms: list[str], key: str = "doc_id") -> DataFrame:
    """Keys that hold every term: relational division."""
    found = posts.where(F.col("word").isin(terms)).groupBy(key).agg(F.count_distinct("word").alias("n"))
    return found.where(F.col("n") == len(set(terms))).select(key)


def padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words(text), " "), F.lit(" "))


def phrase(df: DataFrame, query: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows whose words hold the query's words in a row: key, first_word (from 0), n_words."""
    import re

    q = " " + " ".join(re.findall("[a-zà-ÿ]+", query.lower())) + " "
    # candidates first: rows that can't hold the phrase are dropped by a cheap test on the raw text
    longest = max(q.split(), key=len)
    some = df.where(F.contains(F.lower(text), F.lit(longest))).select(key, padded(F.col(text)).alias("p"))
    hit = some.where(F.contains("p", F.lit(q)))
    before = F.substring_index("p", q, 1)
    return hit.select(key, F.size(F.filter(F.split(before, " "), lambda w: w != "")).alias("first_word"), F.size(F.filter(F.split("p", " "), lambda w: w != "")).alias("n_words"))


def prefix_table(freq: DataFrame, folder: str) -> DataFrame:
    """word, folded, freq, packed of words that occur, saved in the order of the packed prefix, so that its files and row groups hold ranges of it."""
    named = freq.where("freq > 0").select("word", folded(F.col("word")).alias("folded"), "freq", packed_prefix(F.col("word")).alias("packed"))
    return store.saved(named.repartitionByRange("packed", "folded").sortWithinPartitions("packed", "folded"), folder)


def packed_range(prefix: str) -> tuple[int, int] | None:
    """The lowest and the highest packed prefix of texts that start with a folded prefix; none for an empty one."""
    units = [ord(c) for c in prefix[:4]]
    if not units:
        return None
    signed = lambda us: (n := sum(u << (48 - 16 * i) for i, u in enumerate(us))) - (1 << 64 if n >= 1 << 63 else 0)
    return signed(units + [0] * (4 - len(units))), signed(units + [0xFFFF] * (4 - len(units)))


def prefix_hints(words_: DataFrame, prefix: str, most: int) -> DataFrame:
    """Words of a prefix table whose folded form starts with the folded prefix, in order of that form: word, folded, freq.

    The prefix becomes a range of packed numbers, which reaches the scan; each task keeps its first ``most``.
    """
    start = "".join(c for c in unicodedata.normalize("NFD", prefix.lower().translate(str.maketrans(ACCENTED, PLAIN))) if unicodedata.category(c) != "Mn")
    within = packed_range(start)
    some = words_.where(F.col("packed").between(*within)) if within else words_
    return some.where(F.startswith("folded", F.lit(start))).select("word", "folded", "freq").orderBy("folded", "word").limit(most)


def longest_covers(queries: DataFrame, heads: DataFrame, key: str, text: str, longest: int) -> DataFrame:
    """key, start, length, head: headwords that cover a query text, at each start the longest that reaches further.

    Substrings of up to ``longest`` characters are joined with the headwords, which are written down, and broadcast if they are
    few. Of the matches of a text in order of start, longest first, the first at a start stays if it ends beyond all before it;
    so matches are dealt and sorted once, and no map task groups what it made.
    """
    n = F.length(text)
    starts = queries.select(key, text, F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))).alias("start")).where(n > 0)
    cut = starts.select(key, "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start")))).alias("length"), text)
    cut = cut.select(key, "start", "length", F.expr(f"substring({text}, start + 1, length)").alias("head"))
    known = sent(store.saved(heads.select("head").distinct(), store.new_folder(queries.sparkSession, "heads")))
    line = Window.partitionBy(key).orderBy("start", F.desc("length"))
    far = F.coalesce(F.max(F.col("start") + F.col("length")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.coalesce(F.lag("start").over(line) != F.col("start"), F.lit(True))
    best = cut.join(known, "head").select(key, "start", "length", "head").withColumns({"far": far, "first": first})
    return best.where("first AND start + length > far").drop("far", "first")


def segments(df: DataFrame, heads: DataFrame, key: str, text: str) -> DataFrame:
    """key, segments: forward maximum matching against a headword list (head), which travels as a broadcast of checked size.

    Where no headword fits, white space and punctuation are skipped, runs of ASCII letters and digits are one segment, and
    any other character is a segment of its own marked with @. A list of over 64 MB is refused before it is collected.
    """
    size = heads.agg(F.coalesce(F.sum(F.octet_length("head") + 64), F.lit(0))).first()[0]
    if size > 64 << 20:
        raise ValueError("the headword list is too large to send to every task; use longest_covers")
    known = df.sparkSession.sparkContext.broadcast(lengths_of(r["head"] for r in heads.distinct().collect()))

    def split(batches):
        pieces = _Pieces(known.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.of(t) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))], [key, "segments"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(split, f"{key} {kind}, segments array<string>")


def lengths_of(heads) -> dict[str, list[tuple[int, set[str]]]]:
    """Headwords by first character, then by length, longest first."""
    by: dict[str, dict[int, set[str]]] = {}
    for h in heads:
        if h:
            by.setdefault(h[0], {}).setdefault(len(h), set()).add(h)
    return {c: sorted(x.items(), reverse=True) for c, x in by.items()}


#: Pieces of texts whose segments a task keeps, and the longest of them.
KEPT_PIECES, KEPT_LENGTH = 200_000, 64


class _Pieces(dict):
    """Segments of pieces of texts, as they are matched once each; all are forgotten when there are too many.

    A character that no headword has and that is no ASCII letter or digit ends whatever is before it, so texts are cut there.
    """

    def __init__(self, heads: dict[str, list[tuple[int, set[str]]]]):
        self.heads = heads
        inner = {c for sizes in heads.values() for _, known in sizes for h in known for c in h}
        chars = "".join(sorted(re.escape(c) for c in inner if not (c.isascii() and c.isalnum())))
        # white space outside headwords gives no segment
        self.cut = re.compile(f"[A-Za-z0-9{chars}]+|[^A-Za-z0-9{chars}\\s]").findall

    def __missing__(self, piece: str) -> list[str]:
        found = _match(piece, self.heads)
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = found
        return found

    def of(self, text: str | None) -> list[str]:
        return list(chain.from_iterable(map(self.__getitem__, self.cut(text or ""))))


def _match(text: str | None, heads: dict[str, list[tuple[int, set[str]]]]) -> list[str]:
    out: list[str] = []
    i, run = 0, False
    text = text or ""
    while i < len(text):
        c = text[i]
        size = next((n for n, known in heads.get(c, ()) if text[i : i + n] in known), 0)
        if size:
            out.append(text[i : i + size])
            run = False
        elif c.isascii() and c.isalnum():
            if run:
                out[-1] += c
            else:
                out.append(c)
            run = True
        else:
            run = False
            if c.isalnum() or not (c.isspace() or c.isprintable()):
                out.append("@" + c)
        i += size or 1
    return out


def stems(df: DataFrame, dictionary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, pos, word, stem: words with the dictionary's stem, or themselves."""
    return tokens(df, key, text).join(dictionary.select("word", "stem"), "word", "left").select(key, "pos", "word", F.coalesce("stem", "word").alias("stem"))


#: Words of a query's stems that travel with the plan.
MOST_WORDS = 10_000


def stem_runs(df: DataFrame, dictionary: DataFrame, wanted: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, hits: how often the wanted stems stand in a row.

    The words of these stems are a small part of the dictionary; up to MOST_WORDS of them travel with the plan, and texts are
    searched inside their rows, so that no token is shuffled. With more, tokens meet the dictionary in a join.
    """
    few = dictionary.where(F.col("stem").isin(*set(wanted))).select("word", "stem")
    rows = few.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        each = tokens(df, key, text).join(few, "word").select(key, "pos", "stem")
        sides = (each.where(F.col("stem") == s).select(key, (F.col("pos") - i).alias("pos")) for i, s in enumerate(wanted))
        return reduce(lambda a, b: a.join(b, [key, "pos"]), sides).groupBy(key).agg(F.count("*").alias("hits"))
    # a word that the dictionary doesn't have is its own stem
    known = {r["word"] for r in rows}
    forms = {s: [r["word"] for r in rows if r["stem"] == s] + ([s] if s not in known else []) for s in wanted}
    at = lambda w, i: reduce(lambda a, b: a & b, (F.coalesce(F.get(w, i + k).isin(*forms[s]), F.lit(False)) for k, s in enumerate(wanted)))
    hits = let(words(F.col(text)), lambda w: F.size(F.filter(F.transform(w, lambda x, i: at(w, i)), lambda ok: ok)))
    some = df.where(F.lower(text).rlike("|".join(sorted(forms[wanted[0]], key=len)[:1]))) if len(forms[wanted[0]]) == 1 else df
    return some.select(key, hits.cast("long").alias("hits")).where("hits > 0")
