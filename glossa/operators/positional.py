"""Phrase search over a positional index: postings with positions, kept in generations.

A phrase is found from its rarest word on: the starts that this word allows are cut down by the shifted positions of the
others, one join on the key for each, so the postings of frequent words meet a short list of keys. A place of the phrase
can allow several words, for searches by stem. Texts are read when they are filed, never by a search.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions.text import HANZI, let, words
from glossa.operators.generations import Generations
from glossa.operators.neighbours import neighbours, token_blocks

#: Term under which a text's number of words is filed.
LENGTH = "\x00length"
#: What stands between a term and its positions, and between terms, where they are packed.
WITH, NEXT = "\x01", "\x02"
#: Places of a term up to which the texts that hold it are broadcast: some 20 MB.
FEW_PLACES = 1_000_000


def character_terms(text: Column) -> Column:
    """Terms of a one-character index: each hanzi for itself, other letters and digits in runs, lower case, full width as half width."""
    wide = "".join(chr(c) for c in (*range(0xFF10, 0xFF1A), *range(0xFF41, 0xFF5B)))
    half = "0123456789abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(F.lower(text), wide, half), F.lit(rf"{HANZI}|[\p{{L}}\p{{N}}&&[^\x{{3400}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]]+"), 0)


def _packer(buckets: int, least: int):
    """Makes (bucket, key, packed) of (key, terms), about a block of tokens at a time; terms under ``least`` characters only count as places."""

    def bucket_of(terms):
        return np.fromiter((crc32(t.encode()) % buckets for t in terms), np.int64, len(terms))

    def joined(items, cuts, size, mark):
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(cuts, size).astype(np.int32)), items), mark)

    def pack(batches):
        for lists, held in token_blocks(batches, 1):
            terms, ids, sizes, _ = neighbours(lists)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            kept = np.flatnonzero(pc.greater_equal(pc.utf8_length(terms), least).to_numpy(zero_copy_only=False)[ids]) if len(ids) else ids
            # places of a term in a text side by side, in order, by one sort
            kept = kept[np.argsort(row[kept] * len(terms) + ids[kept], kind="stable")]
            both = row[kept] * len(terms) + ids[kept]
            cuts = np.flatnonzero(np.diff(both, prepend=-1))
            first = kept[cuts]
            filed = pc.binary_join_element_wise(terms.take(pa.array(ids[first])), joined(pa.array(at[kept]).cast(pa.string()), cuts, len(kept), ","), WITH)
            lengths = pc.binary_join_element_wise(pa.array([LENGTH] * len(sizes), pa.string()), pa.array(sizes).cast(pa.string()), WITH)
            items, owner = pa.concat_arrays([filed, lengths]), np.concatenate([row[first], np.arange(len(sizes))])
            bucket = np.concatenate([bucket_of(terms.to_pylist())[ids[first]], np.full(len(sizes), bucket_of([LENGTH])[0])])
            # one text for each text and bucket
            order = np.argsort(owner * buckets + bucket, kind="stable")
            cuts = np.flatnonzero(np.diff((owner * buckets + bucket)[order], prepend=-1))
            packed = joined(items.take(pa.array(order)), cuts, len(order), NEXT)
            keys = pa.concat_arrays([b.column(0) for b in held]).take(pa.array(owner[order[cuts]]))
            yield pa.RecordBatch.from_arrays([pa.array(bucket[order[cuts]].astype(np.int32)), keys, packed], ["bucket", "key", "packed"])

    return pack


class PositionalIndex:
    """An index of texts by (term, key, positions) in a folder; ``terms`` cuts a text into its terms."""

    def __init__(self, spark: SparkSession, folder: str, terms=words, buckets: int = 64, least: int = 1, key_type: str = "long"):
        self.terms, self.least = terms, least
        self.table = Generations(spark, folder, f"term string, key {key_type}, positions array<int>", buckets)

    def _packed(self, docs: DataFrame, key: str, text: str) -> DataFrame:
        """bucket, key, packed: a text's terms with their positions, as one text for each bucket that has some."""
        each = docs.select(F.col(key).alias("key"), self.terms(F.coalesce(F.col(text), F.lit(""))).alias("terms"))
        return each.mapInArrow(_packer(self.table.buckets, self.least), f"bucket int, key {each.schema['key'].dataType.simpleString()}, packed string")

    @staticmethod
    def _unpacked(rows: DataFrame) -> DataFrame:
        each = rows.select("key", F.explode(F.split("packed", NEXT)).alias("t"))
        return each.select(F.substring_index("t", WITH, 1).alias("term"), "key", F.split(F.substring_index("t", WITH, -1), ",").cast("array<int>").alias("positions"))

    def add(self, docs: DataFrame, key: str, text: str, fresh: bool = False) -> None:
        """Files texts; keys that are filed already are replaced. With ``fresh``, no key is, so nothing has to be taken out."""
        self.table.add(self._packed(docs, key, text), docs.count(), None if fresh else docs.select(F.col(key).alias("key")), self._unpacked)

    def remove(self, keys: DataFrame, key: str) -> None:
        self.table.remove(keys.select(F.col(key).alias("key")))

    def lengths(self) -> DataFrame:
        """key, n_words of all texts."""
        return self.table.rows([LENGTH]).select("key", F.get("positions", F.lit(0)).alias("n_words"))

    def frequencies(self, terms: list[str]) -> dict[str, tuple[int, int]]:
        """In how many texts each of some terms stands, and at how many places."""
        n = self.table.rows(terms).groupBy("term").agg(F.count("*").alias("texts"), F.sum(F.size("positions")).alias("places"))
        return {r["term"]: (r["texts"], r["places"]) for r in n.collect()}

    def phrase(self, query: list[str] | list[list[str]]) -> DataFrame:
        """key, starts (sorted places of the first term) of the texts that hold the terms in a row.

        A place is a term or a list of terms. Places whose terms are all under ``least`` characters fit any term.
        """
        slots = [(i, sorted({p} if isinstance(p, str) else set(p))) for i, p in enumerate(query)]
        wanted = [(i, t) for i, ts in slots if (t := [x for x in ts if len(x) >= self.least]) or not ts]
        none = self.table.spark.createDataFrame([], f"key {self.table.key_type}, starts array<int>")
        if not wanted or any(not t for _, t in wanted):
            return none
        n = self.frequencies([x for _, t in wanted for x in t])
        places = {i: sum(n.get(x, (0, 0))[1] for x in terms) for i, terms in wanted}
        wanted.sort(key=lambda p: places[p[0]])
        # the starts of the rarest word, and so all that are left of them, are few enough to be sent to every task
        sent = F.broadcast if places[wanted[0][0]] <= FEW_PLACES else lambda df: df
        found = None
        for i, terms in wanted:
            rows = self.table.rows(terms).select("key", F.transform("positions", lambda p: p - i).alias("at"))
            if len(terms) > 1:
                rows = rows.groupBy("key").agg(F.flatten(F.collect_list("at")).alias("at"))
            if found is None:
                found = rows.select("key", F.filter("at", lambda p: p >= 0).alias("starts"))
            else:
                found = sent(found).join(rows, "key").select("key", F.array_intersect("starts", "at").alias("starts"))
            found = found.where(F.size("starts") > 0)
        size = len(query)
        out = found.select("key", F.array_sort("starts").alias("starts"))
        # places that fit any term still have to exist
        if wanted and max(i for i, _ in wanted) < size - 1:
            out = out.join(self.lengths(), "key").select("key", F.filter("starts", lambda s: s + size <= F.col("n_words")).alias("starts")).where(F.size("starts") > 0)
        return out


def concordance(surface: PositionalIndex, query: list[str], forms: list[list[str]], page: int, size: int) -> DataFrame:
    """key, priority, start, length, rank, more: one page of the texts that hold the query (0) or else its stems' forms (1).

    Texts are ordered by priority and key; start is the place of the first hit. ``more`` says whether another page follows.
    """
    both = [surface.phrase(q).select("key", F.lit(i).alias("priority"), F.get("starts", F.lit(0)).alias("start")) for i, q in ((0, query), (1, forms))]
    found = both[0].union(both[1]).groupBy("key").agg(F.min(F.struct("priority", "start")).alias("hit")).select("key", "hit.*")
    cut = found.orderBy("priority", "key").offset(page * size).limit(size + 1)
    # a page and one row
    ranked = cut.withColumn("rank", F.row_number().over(Window.orderBy("priority", "key")))
    most = F.max("rank").over(Window.partitionBy())
    return ranked.withColumn("more", most > size).where(F.col("rank") <= size).select("key", "priority", "start", F.lit(len(query)).alias("length"), (F.col("rank") + page * size).alias("rank"), "more")


def span(text: Column, start: Column, length: Column) -> Column:
    """(from, to) in characters of some words of a text, by the lengths of the stretches that end with each word."""
    stretches = F.regexp_extract_all(F.lower(text), F.lit("[^a-zà-ÿ]*[a-zà-ÿ]+"), 0)
    total = lambda a: F.aggregate(F.transform(a, lambda x: F.length(x)), F.lit(0), lambda s, x: s + x)
    word = lambda s: F.length(F.regexp_extract(F.get(s, start), "[a-zà-ÿ]+$", 0))
    return let(stretches, lambda s: F.struct((total(F.slice(s, 1, start + 1)) - word(s)).alias("from"), total(F.slice(s, 1, start + length)).alias("to")))
