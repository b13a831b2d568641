"""Mixing sources to target weights by Pfair scheduling.

Documents of a source are cut into blocks of ``block`` documents, in the order of a hash of their doc_id. A source of
weight w (its share of the sum) may have its j-th block, counted from 0, run no earlier than slot floor(j / w) and must
have it run before slot ceil((j + 1) / w); of the blocks released, the one with the earliest deadline takes the slot.
So after any number of slots each source is less than one block away from its share.

Sources of equal weight take turns at the slots of a group that has the sum of their weights; a slot that lies in the window
of the group's block lies in the window of the source's block too, so the bound holds for each. Weights are whole numbers,
so the schedule repeats: one period, the sum of the groups' weights over their greatest common divisor, is all that is
computed ahead. Any number of sources of few distinct weights has a short period; one of over MAX_PERIOD slots is refused,
before anything runs, as weights that share no divisor can't be told from their rounding there.

A block's slot follows from its number alone, and its place in the mixture from counts a source, without sorting or passing the
corpus through one task. A source that is used up leaves its slots empty; what remains keeps its order, and ``exact`` tells
the slots before the first source ends, within which the bound holds. No row is dropped or repeated.

Ranks inside a source come from ranks inside (source, hash bucket) and running counts of the buckets, so a hot source is
spread over BUCKETS tasks.

Defined cases: a source without a weight, null included, has weight ``default``; weights of 0 or less are refused; a null
doc_id comes first in its source; rows that repeat a doc_id are rows of their own, ordered by all their columns; an empty
table gives no rows; columns of docs pass through whatever their names, and an added column whose name docs has takes that
name with an underscore before it.
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from math import gcd

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import all_of, quoted, unused

MAX_PERIOD, BUCKETS = 1_000_000, 256
ADDED = ("weight", "block", "release_slot", "deadline_slot", "slot", "position", "exact")


def groups_of(weights: list[int]) -> tuple[list[int], list[tuple[int, int, int]]]:
    """The weights of groups of equal weights, over their common divisor, and for each weight its (group, turn, turns)."""
    many = Counter(weights)
    order = sorted(many, reverse=True)
    sums = [w * many[w] for w in order]
    seen: Counter = Counter()
    places = []
    for w in weights:
        places.append((order.index(w), seen[w], many[w]))
        seen[w] += 1
    divisor = reduce(gcd, sums)
    return [x // divisor for x in sums], places


def pfair_period(weights: list[int]) -> list[tuple[int, int]]:
    """(source, its block) of each slot of one period, by earliest deadline among released blocks; ties to the first source."""
    total = sum(weights)
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    if total > MAX_PERIOD:
        raise ValueError(f"weights must sum to {MAX_PERIOD} at most, not {total}")
    done, out = [0] * len(weights), []
    for slot in range(total):
        ready = [(-(-(done[s] + 1) * total // w), s) for s, w in enumerate(weights) if done[s] < w and done[s] * total // w <= slot]
        # at the sum of shares of one, some block is always released
        _, s = min(ready)
        out.append((s, done[s]))
        done[s] += 1
    return out


def mix(docs: DataFrame, weights: dict[str, int], block: int = 64, default: int = 1) -> DataFrame:
    """docs with the columns ADDED; ``position`` numbers the rows of the mixture from 0."""
    spark = docs.sparkSession
    added = unused(docs, *ADDED)
    if docs.isEmpty():
        return docs.select(*all_of(docs), *(F.lit(None).cast("boolean" if k == "exact" else "long").alias(c) for k, c in zip(ADDED, added))).limit(0)
    bucket, rank, own, blk, turn, group, kth, at, had = unused(docs, "bucket", "rank", "own", "blk", "turn", "group", "kth", "at", "had")
    # the order inside a source: by a hash of the id, then by the id and the rest of the row
    plain = [F.col(quoted(f.name)) for f in docs.schema if "map<" not in f.dataType.simpleString()]
    keys = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64(*plain)]
    bucketed = docs.withColumn(bucket, F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)))
    sizes = docs.select("source", F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS)).alias("b")).groupBy("source", "b").agg(F.count("*").alias("n"))
    before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "b", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    totals = {r["source"]: r["n"] for r in sizes.groupBy("source").agg(F.sum("n").alias("n")).limit(MAX_PERIOD + 1).collect()}
    if len(totals) > MAX_PERIOD:
        raise ValueError(f"more than {MAX_PERIOD} sources: none is left out in silence")
    sources = sorted(totals, key=lambda s: (s is None, s or ""))
    share = [weights.get(s, default) for s in sources]
    if min(share) <= 0:
        raise ValueError("weights must be positive")
    groups, places = groups_of(share)
    period = pfair_period(groups)
    cycle, total = len(period), sum(share)

    # slots of the period: the group and its block that take it, and how many blocks each group has had by then
    counts = [0] * len(groups)
    table = []
    for slot, (g, k) in enumerate(period):
        table.append((g, k, slot, list(counts)))
        counts[g] += 1
    plan = spark.createDataFrame(table, f"`{group}` long, {kth} long, {at} long, {had} array<long>")
    info = spark.createDataFrame([(s, share[i], *places[i], groups[places[i][0]]) for i, s in enumerate(sources)], "source string, w long, g long, turn long, turns long, gw long")

    # all three tables have a bounded size: a row for each source and bucket, each source, each slot of the period
    local = F.row_number().over(Window.partitionBy("source", bucket).orderBy(*keys)) - 1
    ranked = bucketed.withColumn(rank, local)
    ranked = ranked.join(F.broadcast(sizes), ranked["source"].eqNullSafe(sizes["source"]) & (ranked[bucket] == sizes["b"]), "left").select(*(ranked[quoted(c)] for c in docs.columns), (ranked[rank] + sizes["before"]).alias(rank))
    known = info.select("source", F.struct("w", "g", "turn", "turns", "gw").alias(own))
    ranked = ranked.join(F.broadcast(known), ranked["source"].eqNullSafe(known["source"])).drop(known["source"])
    ranked = ranked.withColumn(blk, F.expr(f"{rank} div {block}")).withColumn(turn, F.expr(f"{blk} * {own}.turns + {own}.turn"))
    placed = ranked.join(F.broadcast(plan), (F.col(f"{own}.g") == F.col(quoted(group))) & (F.expr(f"pmod({turn}, {own}.gw)") == F.col(kth)))

    # rows of every source in earlier slots: the blocks it has had, as far as it has rows
    every = F.array(*(F.struct(F.lit(totals[s]).cast("long").alias("n"), F.lit(g).alias("g"), F.lit(i).cast("long").alias("turn"), F.lit(k).cast("long").alias("turns"), F.lit(groups[g]).cast("long").alias("gw")) for s, (g, i, k) in zip(sources, places)))
    done = lambda x: F.floor((F.get(had, x["g"]) + F.expr(f"{turn} div {own}.gw") * x["gw"] - x["turn"] + x["turns"] - 1) / x["turns"]).cast("long")
    earlier = F.aggregate(every, F.lit(0).cast("long"), lambda acc, x: acc + F.least(F.greatest(done(x), F.lit(0)) * block, x["n"]))
    first_end = min(_end(period, places[i], totals[s] // block, groups) for i, s in enumerate(sources))
    slot = F.expr(f"({turn} div {own}.gw) * {cycle} + {at}")
    values = [
        F.col(f"{own}.w"), F.col(blk), F.expr(f"{blk} * {total} div {own}.w"), F.expr(f"(({blk} + 1) * {total} + {own}.w - 1) div {own}.w"),
        slot, earlier + F.pmod(F.col(rank), F.lit(block)).cast("long"), slot < F.lit(first_end),
    ]
    return placed.select(*all_of(docs), *(v.alias(c) for v, c in zip(values, added, strict=True)))


def _end(period: list[tuple[int, int]], place: tuple[int, int, int], blocks: int, groups: list[int]) -> int:
    """The slot in which a source would run the block after its last full one."""
    g, turn, turns = place
    block = blocks * turns + turn
    at = {k: slot for slot, (s, k) in enumerate(period) if s == g}
    return (block // groups[g]) * len(period) + at[block % groups[g]]


def in_order(mixed: DataFrame) -> DataFrame:
    """The mixture's rows in range partitions by position, each sorted, for a reader that takes files in turn."""
    return mixed.repartitionByRange("position").sortWithinPartitions("position")
