"""Removal of repeated byte strings by suffix arrays, which are built by Lyndon grouping.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in the same text or in another. The
same is done for words: ``repeated_words`` counts the words that strings of so many words cover.

Anchors bring equal strings together. Every run of ``window`` grams of ``length - window + 1`` units (bytes, or hashes of
words) selects its grams of the smallest hash, which depend on the run's units alone; so equal strings hold equal anchors at
equal places. Anchors whose hash occurs once in all texts are done with. For the others the units around are fetched:
``window - 1`` to either side. A string that holds the anchor is then some of its left side, the anchor, and some of its
right side, ``window`` symbols in all with the anchor as one symbol of its own. Sides that occur twice are repeats in full.
The distinct pairs of sides of an anchor go to one task, which builds the suffix array of their sequence and reads repeated
strings off neighbours that agree in ``window`` symbols.

``suffix_array`` takes linear time: suffixes are grouped by the longest Lyndon word that they start with, groups being
processed in descending order and handing their word on to the suffix that the previous-smaller pointer names; then each
group's order is emitted in one ascending pass along those pointers, without renaming or recursion.

Equal texts are one text with a count in all this, and are removed whole. Counts of texts, anchors and sides are aggregated
in the map tasks and joined back, so that no task need hold all places of one. Anchors with more than MOST distinct pairs of
sides aren't collected: there each string is a group of its own, by a 128-bit hash, which Spark counts; the result is the same.

Texts are compared by 64-bit hash and length, anchors and sides by two 64-bit hashes.

Defined cases: a null text is empty; texts shorter than ``length`` keep all bytes; rows that repeat are copies of each other;
an empty table gives no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, bit_map, hits, sliced, words_of

LENGTH, WINDOW = 400, 65
WORDS, WORD_WINDOW = 50, 25
MOST, BATCH, PART = 8192, 1 << 15, 1 << 20
BASE = 0x9E3779B97F4A7C15


class Bytes:
    """Texts as their bytes in UTF-8."""

    kind = np.uint8

    def __call__(self, text: str) -> np.ndarray:
        return np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)


class Words:
    """Texts as 64-bit hashes of their words, which ASCII white space parts."""

    kind = np.uint64

    def __init__(self):
        self.known = _Hashes()

    def __call__(self, text: str) -> np.ndarray:
        return np.array(list(map(self.known.__getitem__, text.encode("utf-8", "surrogatepass").split())), np.uint64)


class _Hashes(dict):
    """Hashes of words, kept for the next text."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of a sequence of positive integers, in ascending order."""
    t = [*text, 0]
    n = len(t)
    by: dict[int, list[int]] = {}
    for i, c in enumerate(t):
        by.setdefault(c, []).append(i)
    symbols = sorted(by)
    members = [by[c] for c in symbols]
    rank = {c: g for g, c in enumerate(symbols)}
    group = [rank[c] for c in t]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    done = [False] * len(members)
    unknown = -2
    previous = [unknown] * n
    # groups from the highest down: each hands its Lyndon word to the suffixes before its members
    g = len(members) - 1
    while g >= 0:
        done[g] = True
        times: dict[int, int] = {}
        own = [i for i in members[g] if group[i] == g]
        members[g] = own
        for i in own:
            if previous[i] == unknown:
                # of members that stand before i and are in its way, the pointers are found first
                wait = [(i, i - 1)]
                while wait:
                    j, p = wait.pop()
                    while p >= 0 and done[group[p]] and previous[p] != unknown:
                        p = previous[p]
                    if p >= 0 and done[group[p]]:
                        wait += [(j, p), (p, p - 1)]
                    else:
                        previous[j] = p
            p = previous[i]
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        if times:
            # a suffix that takes the word more often ranks above one that takes it less often, and both above the rest
            most = max(times.values())
            often: list[list[int]] = [[] for _ in range(most + 1)]
            for p, c in times.items():
                often[c].append(p)
            for k in range(most, 0, -1):
                new: dict[int, int] = {}
                for p in often[k]:
                    old = group[p]
                    to = new.get(old)
                    if to is None:
                        to = new[old] = len(members)
                        members.append([])
                        done.append(False)
                        below.append(old)
                        up = above[old]
                        above.append(up)
                        above[old] = to
                        below[up] = to
                    group[p] = to
                    members[to].append(p)
        g = below[g]
    # where each group starts
    slot, at, g = [0] * len(members), 0, 0
    while g != -1:
        slot[g] = at
        at += len(members[g])
        g = above[g]
    out, placed = [-1] * n, [False] * (n + 1)
    out[0] = n - 1
    placed[n - 1] = True
    slot[group[n - 1]] += 1
    for k in range(n):
        j = out[k] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            g = group[j]
            out[slot[g]] = j
            slot[g] += 1
            j = previous[j]
    return out[1:]


class Powers:
    """Powers of BASE and of its inverse modulo 2^64."""

    def __init__(self, n: int):
        with np.errstate(over="ignore"):
            self.up = np.cumprod(np.full(n, BASE, np.uint64))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, pow(BASE, -1, 1 << 64), np.uint64)]))


def _extreme(a: np.ndarray, w: int, f) -> np.ndarray:
    """Minimum or maximum of each w neighbours, by doubling spans."""
    span = 1
    while span * 2 <= w:
        a = f(a[:-span], a[span:])
        span *= 2
    return f(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def anchors(units: np.ndarray, length: int, window: int, powers: Powers) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the anchors of a text. Long texts are taken in overlapping parts."""
    gram = length - window + 1
    places, hashes = [], []
    for lo in range(0, max(len(units) - length + 1, 0), PART - length + 1):
        b = units[lo : lo + PART].astype(np.uint64)
        n = len(b)
        with np.errstate(over="ignore"):
            s = np.zeros(n + 1, np.uint64)
            np.cumsum((b + np.uint64(1)) * powers.up[:n], out=s[1:])
            h = (s[gram:] - s[:-gram]) * powers.down[: n - gram + 1]
            h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        low = _extreme(h, window, np.minimum)
        # a gram is the smallest of some run if it equals the largest of the minima of the runs that hold it
        top = np.zeros(window - 1, np.uint64)
        most = _extreme(np.concatenate([top, low, top]), window, np.maximum)
        at = np.flatnonzero(h == most)
        places.append(at + lo)
        hashes.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at, first = np.unique(np.concatenate(places), return_index=True)
    return at, np.concatenate(hashes)[first]


def _anchor_rows(texts: DataFrame, unit, length: int, window: int) -> DataFrame:
    """(key, tkey, n, pos) of each anchor."""

    def build(batches):
        powers, units = Powers(PART), unit()
        for part in sliced(batches, 2):
            keys, owners, sizes, places = [], [], [], []
            for tkey, n, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                at, h = anchors(units(text.as_py()), length, window, powers)
                keys.append(h.view(np.int64))
                places.append(at)
                owners.append(np.full(len(at), tkey, np.int64))
                sizes.append(np.full(len(at), n, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (keys, owners, sizes, places)], ["key", "tkey", "n", "pos"])

    return texts.where(f"n >= {length}").select("tkey", "n", "text").mapInArrow(build, "key long, tkey long, n long, pos long")


SIDES = "key long, check long, left binary, right binary, tkey long, n long, pos long"


def _sides(texts: DataFrame, wanted: DataFrame, unit, length: int, window: int) -> DataFrame:
    """key, check, left, right, tkey, n, pos: the units to either side of the wanted anchors, and a second hash of each."""
    gram = length - window + 1
    lists = wanted.groupBy("tkey", "n").agg(F.collect_list(F.struct("key", "pos")).alias("found"))
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = [x.split()[0] for x in SIDES.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def build(batches):
        units = unit()
        for part in sliced(batches, 2):
            rows = []
            for tkey, n, text, found in zip(*(c.to_pylist() for c in part.columns), strict=True):
                data = units(text)
                width, raw = data.itemsize, data.tobytes()
                for x in found:
                    p = x["pos"]
                    lo, a, b, hi = (width * max(0, v) for v in (p - window + 1, p, p + gram, p + gram + window - 1))
                    rows.append((x["key"], xxhash.xxh64_intdigest(raw[a:b]) - (1 << 63), raw[lo:a], raw[b:hi], tkey, n, p))
                if len(rows) >= 10_000:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)

    own = hits(texts, bit_map(wanted, F.col("tkey")), F.col("tkey"))
    return own.join(lists, ["tkey", "n"]).select("tkey", "n", "text", "found").mapInArrow(build, SIDES)


def repeated_starts(groups: list[list[tuple[np.ndarray, np.ndarray]]], window: int) -> list[list[set[int]]]:
    """For each group of distinct pairs of sides: how many left units the strings take that two of its pairs share.

    Symbols: 1 between pairs, 2 for want of a unit, then those of the units, then one for the anchor of each group.
    """
    side, size = window - 1, 2 * window
    pairs = [p for g in groups for p in g]
    flat = np.concatenate([x for p in pairs for x in p])
    known, flat = np.unique(flat, return_inverse=True)
    symbols = np.full((len(pairs), size), 2, np.int64)
    symbols[:, -1] = 1
    symbols[:, side] = np.repeat(np.arange(len(groups)), [len(g) for g in groups]) + 3 + len(known)
    at = 0
    for row, (left, right) in enumerate(pairs):
        symbols[row, side - len(left) : side] = flat[at : at + len(left)] + 3
        at += len(left)
        symbols[row, side + 1 : side + 1 + len(right)] = flat[at : at + len(right)] + 3
        at += len(right)
    symbols = symbols.ravel()
    array = np.array(suffix_array(symbols.tolist()), np.int64)
    array = array[array % size < window]
    views = np.lib.stride_tricks.sliding_window_view(symbols, window)
    same = np.zeros(len(array) + 1, bool)
    for k in range(0, len(array) - 1, 2048):
        a, b = array[k : k + 2048], array[k + 1 : k + 2049]
        same[k + 1 : k + 1 + len(b)] = (views[a[: len(b)]] == views[b]).all(axis=1)
    twice = np.zeros(len(symbols), bool)
    twice[array[same[1:] | same[:-1]]] = True
    out, at = [], 0
    for group in groups:
        found = []
        for left, right in group:
            valid = {side - i for i in np.flatnonzero(twice[at : at + window]).tolist()}
            found.append({k for k in valid if k <= len(left) and side - k <= len(right)})
            at += size
        out.append(found)
    return out


def _decided(rows: DataFrame, unit, window: int) -> DataFrame:
    """(tkey, n, lo, hi): first and last start of runs of repeated strings, from distinct pairs of sides.

    A settled pair is one that is repeated as a whole and done with; others are still compared with it.
    """
    kind = unit.kind

    def build(batches):
        last, group, queue, weight, out = None, [], [], 0, []

        def flush():
            found = repeated_starts([[x[0] for x in g] for g in queue], window) if queue else []
            for g, sets in zip(queue, found, strict=True):
                for (_, place), takes in zip(g, sets, strict=True):
                    if place:
                        runs(place, sorted(takes))

        def runs(place, starts):
            tkey, n, pos = place
            lo = None
            for i, k in enumerate(starts):
                lo = k if lo is None else lo
                if i + 1 == len(starts) or starts[i + 1] != k + 1:
                    out.append((tkey, n, pos - k, pos - lo))
                    lo = None

        def table():
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["tkey", "n", "lo", "hi"])
            out.clear()
            return batch

        for batch in batches:
            for key, check, left, right, tkey, n, pos, settled in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, check) != last:
                    if len(group) > 1:
                        queue.append(group)
                        weight += 2 * window * len(group)
                    if weight > BATCH:
                        flush()
                        queue, weight = [], 0
                    group, last = [], (key, check)
                group.append(((np.frombuffer(left, kind), np.frombuffer(right, kind)), None if settled else (tkey, n, pos)))
            if len(out) > 20_000:
                yield table()
        if len(group) > 1:
            queue.append(group)
        flush()
        yield table()

    return rows.select("key", "check", "left", "right", "tkey", "n", "pos", "settled").repartition("key").sortWithinPartitions("key", "check").mapInArrow(build, "tkey long, n long, lo long, hi long")


def _counted(rows: DataFrame, unit, window: int) -> DataFrame:
    """The same where every string is a group of its own, by its hash."""
    side, width = window - 1, np.dtype(unit.kind).itemsize
    each = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(side))).alias("take")).where(F.expr(f"take * {width} <= length(left) AND ({side} - take) * {width} <= length(right)"))
    cut = [F.col("key"), F.col("check"), F.col("take"), F.expr(f"substring(left, length(left) - {width} * take + 1, {width} * take)"), F.expr(f"substring(right, 1, {width} * ({side} - take))")]
    each = each.select("tkey", "n", (F.col("pos") - F.col("take")).alias("lo"), "settled", F.xxhash64(*cut).alias("h1"), F.xxhash64(F.lit(7), *cut).alias("h2"))
    twice = each.groupBy("h1", "h2").agg(F.count("*").alias("times")).where("times > 1").select("h1", "h2")
    return each.where("NOT settled").join(twice, ["h1", "h2"], "left_semi").select("tkey", "n", "lo", F.col("lo").alias("hi"))


def _named(sides: DataFrame, unit) -> DataFrame:
    """Sides with two hashes of them, a name for their place, and how many units they have."""
    width = np.dtype(unit.kind).itemsize
    return sides.select(
        "*", F.xxhash64("left", "right").alias("h1"), F.xxhash64("right", F.lit(7), "left").alias("h2"), F.xxhash64("tkey", "n", "pos").alias("place"),
        F.expr(f"length(left) div {width}").cast("int").alias("nl"), F.expr(f"length(right) div {width}").cast("int").alias("nr"),
    )


def _runs_of(scratch: Scratch, sides: DataFrame, unit, window: int) -> DataFrame:
    """(tkey, n, lo, hi) of all sides, as _named gives them. The bytes of sides are fetched for one place of each distinct pair alone."""
    same = ["key", "check", "h1", "h2"]
    counts = scratch.save(sides.select(*same, "place").groupBy(*same).agg(F.count("*").alias("times"), F.min("place").alias("one")), "pairs")
    # every string of equal pairs is repeated
    twice = counts.where("times > 1").select(*same)
    light = sides.select(*same, "tkey", "n", (F.col("pos") - F.col("nl")).alias("lo"), (F.col("pos") - F.greatest(F.lit(0), window - 1 - F.col("nr"))).alias("hi"))
    met = hits(light, bit_map(twice, F.xxhash64(*same)), F.xxhash64(*same)).join(twice, same, "left_semi")
    whole = met.where("lo <= hi").select("tkey", "n", "lo", "hi")
    groups = counts.groupBy("key", "check").agg(F.count("*").alias("pairs")).where("pairs > 1")
    reps = scratch.save(counts.join(groups, ["key", "check"]).select(F.col("one").alias("place"), "pairs", (F.col("times") > 1).alias("settled")), "reps")
    one = hits(sides, bit_map(reps, F.col("place")), F.col("place")).join(reps, "place")
    few, many = one.where(F.col("pairs") <= MOST), one.where(F.col("pairs") > MOST)
    return whole.union(_decided(few, unit, window)).union(_counted(many, unit, window))


class Texts:
    """The distinct texts of a table, keyed by hash and length, and the copies among them."""

    def __init__(self, docs: DataFrame):
        self.scratch = Scratch(docs.sparkSession)
        text = F.coalesce("text", F.lit(""))
        self.keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("tkey"), F.octet_length(text).cast("long").alias("n"))
        self.copies = self.scratch.save(self.keyed.groupBy("tkey", "n").agg(F.count("*").alias("copies")).where("copies > 1"), "copies")
        map_ = bit_map(self.copies, F.col("tkey"))
        light = self.keyed.select("tkey", "n", "text")
        once = self.scratch.save(hits(light, map_, F.col("tkey")).dropDuplicates(["tkey", "n"]), "once")
        self.distinct = hits(light, map_, F.col("tkey"), wanted=False).unionByName(once)

    def repeats(self, unit, length: int, window: int) -> DataFrame:
        """(tkey, n, found): runs of starts of repeated strings in each distinct text that has any."""
        scratch = Scratch(self.distinct.sparkSession)
        rows = scratch.save(_anchor_rows(self.distinct, unit, length, window), "all")
        held = scratch.save(rows.groupBy("key").agg(F.count("*").alias("held")).where("held > 1").select("key"), "held")
        wanted = scratch.save(hits(rows, bit_map(held, F.col("key")), F.col("key")).join(held, "key", "left_semi"), "anchors")
        scratch.drop("all")
        sides = scratch.save(_named(_sides(self.distinct, wanted, unit, length, window), unit), "sides")
        found = _runs_of(scratch, sides, unit, window)
        found = self.scratch.save(found.groupBy("tkey", "n").agg(F.collect_list(F.struct("lo", "hi")).alias("found")), f"found-{unit.__name__}")
        for name in ("held", "anchors", "sides", "pairs", "reps"):
            scratch.drop(name)
        return found


def _covered(n: int, found, length: int) -> np.ndarray:
    """Which of n units are covered by strings with such runs of starts."""
    edge = np.zeros(n + 1, np.int64)
    for lo, hi in found:
        edge[lo] += 1
        edge[hi + length] -= 1
    return np.cumsum(edge[:-1]) > 0


def _cut(data: bytes, found, length: int) -> tuple[int, int, bytes]:
    """Bytes removed, runs removed, bytes left."""
    gone = _covered(len(data), found, length)
    runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
    return int(gone.sum()), runs, np.frombuffer(data, np.uint8)[~gone].tobytes()


def _removed(texts: Texts, length: int, window: int) -> DataFrame:
    """tkey, n, gone, spans, kept of the distinct texts that lose bytes."""
    found = texts.repeats(Bytes, length, window)

    def build(batches):
        for part in sliced(batches, 2):
            out = []
            for tkey, n, text, runs in zip(*(c.to_pylist() for c in part.columns), strict=True):
                gone, spans, rest = _cut(text.encode("utf-8", "surrogatepass"), [(x["lo"], x["hi"]) for x in runs], length)
                out.append((tkey, n, gone, spans, hashlib.sha256(rest).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["tkey", "n", "gone", "spans", "kept"])

    own = hits(texts.distinct, bit_map(found, F.col("tkey")), F.col("tkey"))
    return own.join(found, ["tkey", "n"]).select("tkey", "n", "text", "found").mapInArrow(build, "tkey long, n long, gone long, spans long, kept string")


def _repeated(texts: Texts, length: int, window: int) -> DataFrame:
    """tkey, n, words: how many words repeated strings of words cover, for distinct texts that have any."""
    found = texts.repeats(Words, length, window)
    ordered = F.array_sort("found")
    step = F.aggregate(
        ordered, F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("total")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["hi"] + length).alias("end"), (acc["total"] + F.greatest(F.lit(0).cast("long"), x["hi"] + length - F.greatest(acc["end"], x["lo"]))).alias("total")),
    )
    return found.select("tkey", "n", step["total"].alias("words"))


def dedup(docs: DataFrame, length: int = LENGTH, window: int = WINDOW, words: int | None = None, word_window: int = WORD_WINDOW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    With ``words``, n_repeated_words too: the words of a document that strings of so many words cover which start anywhere
    else too. It counts what shorter passages share, and removes nothing.
    """
    texts = Texts(docs)
    cut = _removed(texts, length, window)
    base = texts.keyed.select("doc_id", "tkey", "n", F.sha2("text", 256).alias("whole"), _count(F.col("text")).alias("size"))
    out = base.join(texts.copies, ["tkey", "n"], "left").join(cut, ["tkey", "n"], "left")
    twin = F.col("copies").isNotNull() & (F.col("n") >= length)
    columns = [
        F.col("doc_id"), F.col("n").alias("n_bytes"),
        F.when(twin, F.col("n")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"),
        F.when(twin, 1).otherwise(F.coalesce("spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(twin, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept", "whole")).alias("kept_sha256"),
    ]
    if words:
        out = out.join(_repeated(texts, words, word_window), ["tkey", "n"], "left")
        whole = F.col("copies").isNotNull() & (F.col("size") >= words)
        columns.append(F.when(whole, F.col("size")).otherwise(F.coalesce("words", F.lit(0))).cast("long").alias("n_repeated_words"))
    return out.select(*columns)


def _count(text):
    return F.size(words_of(text)).cast("long")
