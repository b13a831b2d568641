"""Counts of tokens and of neighbouring tokens, made by Arrow and numpy inside the tasks.

Tokens of a block of texts become numbers, pairs of neighbours are counted as numbers, and what a block counted is packed by
bucket and compressed before it is dealt, so that a row is shuffled once a bucket and not once a pair. The other side adds up whole buckets.
"""

from __future__ import annotations

import unicodedata
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.sources import store

#: Tokens counted at once in a task, and bytes of packed counts added up at once.
BLOCK, MERGE_BYTES = 1 << 21, 1 << 23
BUCKETS = 4096
#: Between the tokens of a pair, between counted items, and before the codes of these three where a token has them.
WITH, NEXT, ESCAPE = "\x01", "\x02", "\x03"
CODES = ((ESCAPE, ESCAPE + "a"), (WITH, ESCAPE + "b"), (NEXT, ESCAPE + "c"))
PAIR, WORD, PAIRS, WORDS = range(4)
#: Places of the bit map of wanted pairs, a prime: 16 MB.
PLACES, SPREAD, PAGE = 134_217_689, 40_503, 32_768


def countable_token(token: str) -> bool:
    return token != "" and (kind := unicodedata.category(token[0]))[0] != "P" and kind != "Nd"


def token_blocks(batches, column: int):
    """(lists of tokens, batches) of about BLOCK tokens."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch.column(column).flatten())
        if size >= BLOCK:
            yield pa.concat_arrays([b.column(column) for b in held]), held
            held, size = [], 0
    if held:
        yield pa.concat_arrays([b.column(column) for b in held]), held


def neighbours(lists: pa.ListArray):
    """Distinct tokens, numbers of all tokens, sizes of the texts, and whether a token has one after it in its text."""
    coded = lists.flatten().fill_null("").dictionary_encode()
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    more = np.ones(len(ids), bool)
    more[np.cumsum(sizes)[sizes > 0] - 1] = False
    return coded.dictionary, ids, sizes, more


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter((crc32(w.encode()) for w in words.to_pylist()), np.int64, len(words))


def _place(a, b):
    """Place of a pair in the bit map, from the checksums of its tokens."""
    return (a * SPREAD + b) % PLACES


def _count(batches):
    for lists, _ in token_blocks(batches, 0):
        words, ids, _, more = neighbours(lists)
        if not len(ids):
            continue
        ok = np.fromiter(map(countable_token, words.to_pylist()), bool, len(words))
        both = more[:-1] & ok[ids[:-1]] & ok[ids[1:]]
        codes, n = np.unique(ids[:-1][both] * len(words) + ids[1:][both], return_counts=True)
        a, b = codes // len(words), codes % len(words)
        own = np.flatnonzero(ok)
        sums = _hashes(words)
        bucket = np.concatenate([_place(sums[a], sums[b]), _place(sums[own], 0)]) % BUCKETS
        for given, code in CODES:
            words = pc.replace_substring(words, given, code)
        items = pa.concat_arrays([pc.binary_join_element_wise(words.take(pa.array(a)), words.take(pa.array(b)), WITH), words.take(pa.array(own))])
        n = np.concatenate([n, np.bincount(ids, minlength=len(words))[own]])
        if not len(n):
            continue
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
        ends = pa.array(np.append(cuts, len(bucket)).astype(np.int32))
        texts = [t.encode() for t in pc.binary_join(pa.ListArray.from_arrays(ends, items.take(pa.array(order))), NEXT).to_pylist()]
        packed, size = pa.array([pa.compress(t, "zstd", asbytes=True) for t in texts], pa.binary()), pa.array(map(len, texts), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts].astype(np.int32)), packed, size, pa.ListArray.from_arrays(ends, pa.array(n[order].astype(np.int32)))], ["bucket", "packed", "size", "counts"])


def _add_up(rows: pa.Table, least: int):
    texts = pa.array([pa.decompress(t, n, "zstd", asbytes=True).decode() for t, n in zip(rows["packed"].to_pylist(), rows["size"].to_pylist())], pa.string())
    coded = pc.split_pattern(texts, NEXT).flatten().dictionary_encode()
    n = np.bincount(coded.indices.to_numpy(zero_copy_only=False), weights=rows["counts"].combine_chunks().flatten().to_numpy(zero_copy_only=False), minlength=len(coded.dictionary)).astype(np.int64)
    pair = pc.greater_equal(pc.find_substring(coded.dictionary, WITH), 0).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(n >= least)
    parts = pc.split_pattern(coded.dictionary.take(pa.array(kept)), WITH)
    a = pc.list_element(parts, 0)
    b = pc.list_element(pc.if_else(pair[kept], parts, pa.array([["", None]], parts.type).take(pa.array(np.zeros(len(kept), np.int64)))), 1)
    for given, code in reversed(CODES):
        a, b = (pc.replace_substring(x, code, given) for x in (a, b))
    kind = np.where(pair[kept], PAIR, WORD)
    none = pa.nulls(2, pa.string())
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.append(kind, [PAIRS, WORDS]).astype(np.int32)), pa.concat_arrays([a, none]), pa.concat_arrays([b, none]), pa.array(np.append(n[kept], [n[pair].sum(), n[~pair].sum()]))], ["kind", "a", "b", "n"]
    )


def _merged(least: int):
    def merge(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= MERGE_BYTES:
                rows = pa.Table.from_batches(held)
                buckets = rows["bucket"].to_numpy()
                # the last bucket may go on in the next batch
                cut = int(np.searchsorted(buckets, buckets[-1]))
                if cut:
                    yield from _add_up(rows.slice(0, cut), least)
                    held = pa.Table.from_batches(held).slice(cut).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if sum(b.num_rows for b in held):
            yield from _add_up(pa.Table.from_batches(held), least)

    return merge


def counted(rows: DataFrame, tokens: str, least: int) -> DataFrame:
    """kind, a, b, n: pairs of neighbouring countable tokens (PAIR) and countable tokens (WORD, in a) found ``least`` times or more.

    Rows of kinds PAIRS and WORDS add up to the number of all pairs and all countable tokens, rare ones as well. Written down.
    """
    packed = rows.select(F.col(tokens).alias("tokens")).mapInArrow(_count, "bucket int, packed binary, size int, counts array<int>")
    dealt = packed.repartition("bucket").sortWithinPartitions("bucket")
    return store.saved(dealt.mapInArrow(_merged(least), "kind int, a string, b string, n long"), store.new_folder(rows.sparkSession, "counts"))


def places(rows: DataFrame, wanted: DataFrame, key: str, tokens: str) -> DataFrame:
    """key, pos, a, b: neighbouring tokens that may be in wanted (a, b): all that are, and few others.

    Wanted pairs are marked in a bit map of fixed size, which is put together by page and broadcast.
    """
    place = F.pmod(F.crc32(F.encode("a", "UTF-8")) * F.lit(SPREAD).cast("long") + F.crc32(F.encode("b", "UTF-8")), F.lit(PLACES).cast("long"))
    marked = wanted.select((place + 1).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("page")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    bits = np.zeros(-(-PLACES // PAGE) * PAGE // 8, np.uint8)
    for r in marked.toLocalIterator():  # at most 4,096 pages of 4 KB
        at = (r["page"] - 1) * PAGE // 8
        bits[at : at + PAGE // 8] = np.frombuffer(r["bits"], np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(bits)

    def find(batches):
        for lists, held in token_blocks(batches, 1):
            words, ids, sizes, more = neighbours(lists)
            sums = _hashes(words)
            at = np.flatnonzero(more[:-1])
            p = _place(sums[ids[at]], sums[ids[at + 1]])
            at = at[(sent.value[p >> 3] >> (p & 7).astype(np.uint8)) & 1 == 1]
            row = np.repeat(np.arange(len(sizes)), sizes)[at]
            starts = np.cumsum(sizes) - sizes
            keys = pa.concat_arrays([b.column(0) for b in held])
            for lo in range(0, len(at), BLOCK // 8):
                i, r = at[lo : lo + BLOCK // 8], row[lo : lo + BLOCK // 8]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(r)), pa.array((i - starts[r]).astype(np.int32)), words.take(pa.array(ids[i])), words.take(pa.array(ids[i + 1]))], [key, "pos", "a", "b"])

    return rows.select(key, tokens).mapInArrow(find, f"{key} {rows.schema[key].dataType.simpleString()}, pos int, a string, b string")
