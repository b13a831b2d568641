"""Benchmark decontamination: SimHash item-sized windows, Hamming blocks, exact weighted-shingle similarity.

Every window of every document gets a 64-bit SimHash of its words, for each size of window that an item has: a step of a
ladder, at most SHARE of the item's words and at least SHARE / LADDER of them. Items have two fingerprints of that size, of
their first and of their last words. Fingerprints at most RADIUS apart are found by an index over four blocks of 16 bits:
one of the blocks differs in at most RADIUS // 4 bits, so each fingerprint is filed in each block under all values that
near, and a look-up of the window's own value finds it. Each found pair of windows aligns the item with a place in the
document; there, and SHIFT words to either side, the weighted Jaccard similarity of five-word shingles decides exactly. A
shingle weighs as many units as its words have characters.

A word that no item has stands in five shingles that no item has, but for the four words at either end of a window. Those of
its first place in a window are five different ones, since the word comes first at another place in each. At a similarity of s
what is not shared weighs at most 1 / s - 1 times the item, so the distinct strange words of a window have at most
(1 / s - 1) / 5 of the item's weight in characters, however often they or their phrases are repeated. Windows and places with
more are passed over before they are fingerprinted or compared.

A match shares shingles that weigh at least SIMILARITY of its item. Found pairs around which shingles of items weigh less are
passed over before they are compared.

The index finds every fingerprint within RADIUS. That a similar passage has one is a matter of chance, if a small one: at a
similarity of 0.8 about one word in 45 differs, which turns 4 of 64 bits on average. Tests measure what is found.

A document with fewer words than a window, but SHORT of them, is a window of its own.

Texts are lower-cased; words are runs of word characters, so case and punctuation don't matter.

Items are taken in blocks of ITEMS rows, each broadcast and held against all documents; nothing is shuffled.

Defined cases: null or wordless texts and items meet nothing; an item of fewer words than a shingle is one shingle; rows that
repeat are rows of their own; an empty table on either side gives no rows; texts are read whole; other columns are ignored
by ``leaks`` and kept by ``clean``.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import bounded, sliced

WIDTH, SIMILARITY = 5, 0.8
SHARE, LADDER, SHORT, RADIUS, SHIFT = 0.95, 1.25, 0.7, 11, 3
ITEMS, CHUNK = 2000, 1 << 15
WORD, NO_WORD = re.compile(r"\w+"), re.compile(r"\W")
BASE, PIECE = 0x9E3779B97F4A7C15, 1 << 18
#: Odd numbers that tell the places of a shingle's words.
MULTIPLIERS = np.array([pow(BASE, 2 * j + 1, 1 << 64) for j in range(WIDTH)], np.uint64)
#: Values of 16 bits with at most RADIUS // 4 of them set.
FLIPS = np.array([m for m in range(1 << 16) if m.bit_count() <= RADIUS // 4], np.uint16)


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


@cache
def word_characters() -> np.ndarray:
    """For each code point whether words have it."""
    out = np.zeros(0x110000, bool)
    for lo, hi in ((0, 0xD800), (0xE000, 0x110000)):
        for m in WORD.finditer("".join(map(chr, range(lo, hi)))):
            out[lo + m.start() : lo + m.end()] = True
    return out


class Texts:
    """Texts in lower case, with a hash and the length of each word and the number of words of each text.

    Words are found by numpy on code points, a piece of PIECE characters at a time, and told apart by a polynomial of their
    characters; each distinct one of a piece is hashed as a string. All words as strings are made for single texts alone.
    """

    def __init__(self, texts: list[str | None]):
        self.low = [(t or "").lower() for t in texts]
        whole = "\n".join([*self.low, ""])
        at, starts, hashes, chars = 0, [], [], []
        while at < len(whole):
            # up to a character that no word has
            end = m.end() if (m := NO_WORD.search(whole, at + PIECE)) else len(whole)
            first, size, same = self._words(np.frombuffer(whole[at:end].encode("utf-32-le", "surrogatepass"), np.uint32))
            first += at
            _, one, which = np.unique(same, return_index=True, return_inverse=True)
            each = (whole[a:b] for a, b in zip(first[one].tolist(), (first + size)[one].tolist(), strict=True))
            starts.append(first)
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, each), np.uint64, len(one))[which])
            chars.append(size)
            at = end
        starts, self.hashes, self.chars = (np.concatenate([np.empty(0, kind), *x]) for x, kind in ((starts, np.int64), (hashes, np.uint64), (chars, np.int64)))
        ends = np.cumsum([len(t) + 1 for t in self.low], dtype=np.int64)
        self.lengths = np.diff(np.searchsorted(starts, ends), prepend=0)

    @staticmethod
    def _words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, lengths and polynomials of the words among code points, the last of which is in none."""
        inside = word_characters()[codes]
        flips = np.flatnonzero(np.diff(inside, prepend=False))
        starts, sizes = flips[::2], flips[1::2] - flips[::2]
        if not len(starts):
            return starts, sizes, np.empty(0, np.uint64)
        first = np.cumsum(sizes) - sizes
        with np.errstate(over="ignore"):
            powers = np.cumprod(np.full(int(sizes.max()), BASE, np.uint64))
            place = np.arange(int(sizes.sum())) - np.repeat(first, sizes)
            return starts, sizes, np.add.reduceat((codes[inside].astype(np.uint64) + np.uint64(1)) * powers[place], first)

    def words(self, i: int) -> list[str]:
        return WORD.findall(self.low[i])


def window_size(n: int) -> int:
    """The largest step of the ladder up to SHARE of n words; at least 1."""
    size, step = max(1, int(n * SHARE)), 1
    while (up := max(step + 1, int(step * LADDER))) <= size:
        step = up
    return step


def planes(h: np.ndarray) -> np.ndarray:
    """The bits of hashes: a row a hash, a column a bit."""
    return np.unpackbits(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8), axis=1)


def running(h: np.ndarray, longest: int) -> np.ndarray:
    """Running sums of each bit, from 0.

    For windows up to 255 words eight sums share a number: what they carry over is the same at both ends of a window, so
    the difference of the numbers is made of the window's own eight sums.
    """
    each = planes(h)
    out = np.zeros((len(h) + 1, 8), np.uint64) if longest < 256 else np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(each.view(np.uint64) if longest < 256 else each, axis=0, dtype=out.dtype, out=out[1:])
    return out


def prints_of(counts: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints from differences of running sums over ``size`` words: a bit is set if most of the words have it."""
    each = counts.view(np.uint8) if counts.dtype == np.uint64 else counts
    return np.packbits(each > size // 2, axis=1).view(np.uint64).ravel()


def simhashes(sums: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` words, from running sums."""
    return prints_of(sums[size:] - sums[:-size], size)


def shingle_hashes(h: np.ndarray) -> np.ndarray:
    """A hash of each WIDTH neighbouring words, from those of the words."""
    n = max(len(h) - WIDTH + 1, 0)
    with np.errstate(over="ignore"):
        return sum((h[j : j + n] * m for j, m in enumerate(MULTIPLIERS)), np.zeros(n, np.uint64))


class Marks:
    """A map of hashes, with some 16 places for each: it holds all of them, and a few others."""

    def __init__(self, hashes: np.ndarray):
        bits = min(22, max(10, (16 * len(hashes)).bit_length()))
        self.shift, self.map = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.map[hashes >> self.shift] = True

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        return self.map[hashes >> self.shift]


class Items:
    """Items ready for search: fingerprints by window size, words and shingles."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.words = [(i, words(t)) for i, t in rows]
        self.words = [(i, w) for i, w in self.words if w]
        self.shingles = [shingles(w) for _, w in self.words]
        self.limits = [(1 / SIMILARITY - 1) / WIDTH * sum(x.values()) + 1e-6 for x in self.shingles]
        self.sets = [set(w) for _, w in self.words]
        each = Texts([t for _, t in rows])
        known = [h for h in np.split(each.hashes, np.cumsum(each.lengths)[:-1]) if len(h)] if rows else []
        by: dict[int, list] = {}
        for k, (_, w) in enumerate(self.words):
            h = known[k]
            size = window_size(len(w))
            prints = simhashes(running(h, size), size)
            by.setdefault(size, []).extend((int(prints[at]), k, at) for at in sorted({0, len(w) - size}))
        self.sizes = {}
        for size, found in by.items():
            prints = np.array([f for f, _, _ in found], np.uint64)
            blocks = prints.view(np.uint16).reshape(-1, 4)
            owners, starts = [], []
            for b in range(4):
                near = (blocks[:, b, None] ^ FLIPS[None, :]).ravel()
                order = np.argsort(near, kind="stable")
                owners.append((order // len(FLIPS)).astype(np.int32))
                # where the fingerprints filed under each value stand
                starts.append(np.searchsorted(near[order], np.arange((1 << 16) + 1)).astype(np.int32))
            filled = [np.diff(x) > 0 for x in starts]
            item = np.array([k for _, k, _ in found])
            self.sizes[size] = (prints, owners, starts, filled, item, np.array([at for _, _, at in found]), max(self.limits[k] for k in item))
        # maps of all items' words and shingles
        self.vocabulary = Marks(np.concatenate([np.empty(0, np.uint64), *known]))
        self.marks = Marks(np.concatenate([np.empty(0, np.uint64), *map(shingle_hashes, known)]))
        self.lengths = np.array([len(w) for _, w in self.words], np.int64)
        # an item shorter than a shingle has one of its own width, which isn't in the map
        self.least = np.array([SIMILARITY * sum(x.values()) - 1e-6 if len(w) >= WIDTH else 0.0 for (_, w), x in zip(self.words, self.shingles, strict=True)])


def shingles(w: list[str]) -> dict[tuple, int]:
    """Distinct shingles with their weights."""
    width = min(WIDTH, len(w))
    found = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    return {s: sum(map(len, s)) for s in found}


def similarity(a: dict[tuple, int], b: dict[tuple, int]) -> float:
    shared = sum(v for s, v in a.items() if s in b)
    total = sum(a.values()) + sum(b.values()) - shared
    return shared / total if total else 0.0


def distances(h: np.ndarray) -> np.ndarray:
    """For each word, how many words back one with the same 16 bits of hash stood last; len(h) + 1 where none did.

    Now and then that is another word, so that a strange word isn't counted and a window is passed on that need not be.
    """
    ids = (h >> np.uint64(48)).astype(np.uint16)
    order = np.argsort(ids, kind="stable")
    back = np.full(len(ids), len(ids) + 1)
    again = np.flatnonzero(ids[order[1:]] == ids[order[:-1]]) + 1
    back[order[again]] = order[again] - order[again - 1]
    return back


def firsts(weights: np.ndarray, back: np.ndarray, size: int) -> np.ndarray:
    """Running sums, from 0, of the weights of words that no window of ``size`` words holds twice before their place."""
    return np.concatenate([[0], np.cumsum(np.where(back >= size, weights, 0))])


def shared_weights(h: np.ndarray, chars: np.ndarray, items: Items) -> np.ndarray:
    """Running sums, from 0, of the weights of the shingles that may be some item's."""
    ends = np.concatenate([[0], np.cumsum(chars)])
    marked = items.marks(shingle_hashes(h))
    return np.concatenate([[0], np.cumsum(np.where(marked, (ends[WIDTH:] - ends[:-WIDTH])[: len(marked)], 0))])


def enough(found: np.ndarray, starts: np.ndarray, lengths: np.ndarray, shared: np.ndarray, items: Items) -> np.ndarray:
    """Whether the places to be tried of (document, item, start) hold shingles of items that weigh as much as a match shares."""
    d, k, start = found
    n = items.lengths[k]
    top = np.maximum(lengths[d] - n, 0)
    first, last = (np.clip(start + shift, 0, top) for shift in (-SHIFT, SHIFT))
    # places of the first shingle and behind the last, which ends in the document
    first = starts[d] + first
    end = np.maximum(starts[d] + np.minimum(last + n, lengths[d]) - WIDTH + 1, first)
    most = len(shared) - 1
    return shared[np.minimum(end, most)] - shared[np.minimum(first, most)] >= items.least[k]


def weight_of(known: set[str], before: list[str], some: list[str]) -> int:
    """Characters of the distinct words of ``some`` that aren't known and don't stand before it."""
    return sum(map(len, set(some) - known - set(before)))


def matches(docs: list[list[str]], items: Items):
    """The same as ``found_in``, of documents given as words."""
    return found_in(Texts([" ".join(d) for d in docs]), items)


def found_in(docs: Texts, items: Items):
    """(document's place, item's place, similarity, first word) of each document and item that match; best place of each."""
    best: dict[tuple[int, int], tuple[float, int]] = {}
    if not items.words:
        return []
    longest, edge = max(items.sizes), WIDTH - 1
    ends = np.cumsum([0, *docs.lengths])
    for lo, hi in _chunks(docs.lengths.tolist()):
        h, chars, lengths = docs.hashes[ends[lo] : ends[hi]], docs.chars[ends[lo] : ends[hi]], docs.lengths[lo:hi]
        weights, back, cut = np.where(items.vocabulary(h), 0, chars), distances(h), {}
        starts = np.cumsum([0, *lengths])
        owner = np.repeat(np.arange(hi - lo), lengths)
        sums, shared = running(h, longest), shared_weights(h, chars, items)
        found: set[tuple[int, int, int]] = set()
        for size, (prints, owners, first, filled, item, offset, limit) in items.sizes.items():
            f, at = np.empty(0, np.uint64), np.empty(0, np.int64)
            if len(h) >= size:
                good = owner[: len(h) - size + 1] == owner[size - 1 :]
                if size > 2 * edge:
                    unknown = firsts(weights, back, size)
                    good &= unknown[size - edge : len(unknown) - edge] - unknown[edge : len(unknown) - size + edge] <= limit
                at = np.flatnonzero(good)
                f = prints_of(sums[at + size] - sums[at], size)
            short = np.flatnonzero((lengths < size) & (lengths >= SHORT * size) & (lengths > 0))
            if len(short):
                f = np.concatenate([f, *(simhashes(sums[starts[d] : starts[d + 1] + 1], int(lengths[d])) for d in short)])
                at = np.concatenate([at, starts[short]])
            values = f.view(np.uint16).reshape(-1, 4)
            for b in range(4):
                some = np.flatnonzero(filled[b][values[:, b]])
                # all pairs of a window and a fingerprint that meet in the block, a slice of windows at a time
                for k in range(0, len(some), 8192):
                    part = some[k : k + 8192]
                    v = values[part, b].astype(np.int64)
                    n = first[b][v + 1] - first[b][v]
                    pos = np.repeat(part, n)
                    q = owners[b][np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - first[b][v], n)]
                    near = np.flatnonzero(np.bitwise_count(f[pos] ^ prints[q]) <= RADIUS)
                    d = owner[at[pos[near]]]
                    each = np.stack([d, item[q[near]], at[pos[near]] - starts[d] - offset[q[near]]])
                    found.update(zip(*each[:, enough(each, starts, lengths, shared, items)].tolist(), strict=True))
        done: set[tuple[int, int, int]] = set()
        for d, k, start in found:
            if d not in cut:
                cut[d] = docs.words(lo + d)
            n, doc, known, limit = len(items.words[k][1]), cut[d], items.sets[k], items.limits[k]
            top = max(0, len(doc) - n)
            first_place, last_place = (max(0, min(start + shift, top)) for shift in (-SHIFT, SHIFT))
            # the words that the middles of all places to be tried have in common, then those of each
            if weight_of(known, doc[first_place : last_place + edge], doc[last_place + edge : min(first_place + n, len(doc)) - edge]) > limit:
                continue
            for s in range(first_place, last_place + 1):
                if (d, k, s) in done:
                    continue
                done.add((d, k, s))
                if weight_of(known, doc[s : s + edge], doc[s + edge : min(s + n, len(doc)) - edge]) > limit:
                    continue
                x = similarity(shingles(doc[s : s + n]), items.shingles[k])
                if x >= SIMILARITY:
                    best[lo + d, k] = max(best.get((lo + d, k), (0.0, 0)), (x, -s))
    return [(d, k, x, -s) for (d, k), (x, s) in sorted(best.items())]


def _chunks(lengths: list[int]):
    """Ranges of documents of about CHUNK words; a longer document is alone."""
    lo = n = 0
    for i, size in enumerate(lengths):
        if n and n + size > CHUNK:
            yield lo, i
            lo, n = i, 0
        n += size
    if n:
        yield lo, len(lengths)


def _blocks(benchmark: DataFrame):
    """Items in blocks of bounded size, collected one at a time, each as a broadcast."""
    rows = benchmark.select("item_id", "text").where("text IS NOT NULL")
    n = -(-rows.count() // ITEMS)
    for k in range(n):
        part = rows if n == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in part.collect()])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity, start_word: each document and item that match, at its best place."""
    schema = "doc_id long, item_id long, similarity double, start_word long"
    out = None
    for rows in _blocks(benchmark):
        found = _leaks(docs, rows, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def _leaks(docs: DataFrame, rows, schema: str) -> DataFrame:
    bounded(docs.sparkSession)

    def search(batches):
        items = Items(rows.value)
        for part in sliced(batches, 1):
            ids = part.column(0).to_pylist()
            hits = found_in(Texts(part.column(1).to_pylist()), items)
            yield pa.RecordBatch.from_arrays(
                [pa.array([ids[h[0]] for h in hits], pa.int64()), pa.array([items.words[h[1]][0] for h in hits], pa.int64()), pa.array([h[2] for h in hits], pa.float64()), pa.array([h[3] for h in hits], pa.int64())],
                ["doc_id", "item_id", "similarity", "start_word"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that match no item; columns as they came."""
    bounded(docs.sparkSession)
    place = docs.columns.index("text")
    for rows in _blocks(benchmark):

        def keep(batches, rows=rows):
            items = Items(rows.value)
            for part in sliced(batches, place):
                bad = {h[0] for h in found_in(Texts(part.column(place).to_pylist()), items)}
                yield part.filter(pa.array([i not in bad for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs
