"""A Merkle manifest of a table: leaves, a tree for each group, a tree over the groups' roots, and every row's proof.

Rows are sorted by (group, order) over range partitions; a row's place in its group is its place in the partition and the rows
of the group in partitions before, so that a group with most of the rows is spread like any other. Leaves are then gathered in
ordered arrays of ``fanout ** depth`` places, and each array is collapsed inside its row, level by level, by sequence,
transform, slice and aggregate. The roots of the arrays are the leaves of the next round, a thousandth of the rows. Paths go the
other way: an array's path is appended to those of its leaves. No Python code touches a row.

A run of ``fanout`` consecutive nodes becomes the hash of its concatenated digests as hex text, and so does a last run of
fewer, even of one, while a tree has more than one node; a lone leaf is its group's root. Groups are ordered by name, null
first, and their roots make the root in the same way.

A null value is ``-`` in a leaf; a null group is a group of its own; a null in the order is first. Rows of equal order are
ordered by their leaves, so repeated rows have equal leaves and each its own proof. Texts of any length are hashed whole.
An empty table has no rows, so no root. Other columns are of no concern, so none of their names can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, let, quoted

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes of a run, and levels that an array of leaves is collapsed by: 1,024 leaves, about 150 kB a row.
FANOUT, DEPTH = 2, 10


def field(value: Column) -> Column:
    """A value as it enters a leaf."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_of(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _height(total: Column, fanout: int) -> Column:
    """Levels from that many leaves to one node."""
    powers = [fanout**i for i in range(63) if fanout**i < 1 << 62]
    return F.size(F.filter(F.array(*(F.lit(p).cast("long") for p in powers)), lambda p: p < total))


def _levels(leaves: Column, height: Column, fanout: int, depth: int) -> Column:
    """The leaves and the levels above them, as arrays."""
    runs = lambda a: F.sequence(F.lit(0), F.floor((F.size(a) - 1) / fanout).cast("int"))
    up = lambda a: F.transform(runs(a), lambda i: F.sha2(F.array_join(F.slice(a, i * fanout + 1, fanout), ""), 256))
    steps = F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), height)
    return F.aggregate(steps, F.array(leaves), lambda held, _: F.concat(held, F.array(up(F.element_at(held, -1)))))


def _path(levels: Column, i: Column, height: Column, fanout: int, depth: int) -> Column:
    """For leaf i of an array: the digests before and after its own in each run on its way up."""

    def step(level):
        own = F.floor(i / F.element_at(F.array(*(F.lit(fanout**k) for k in range(depth))), level + 1)).cast("int")
        run, place, nodes = F.floor(own / fanout).cast("int"), F.pmod(own, F.lit(fanout)), F.element_at(levels, level + 1)
        before = F.array_join(F.slice(nodes, run * fanout + 1, place), "")
        after = F.array_join(F.slice(nodes, run * fanout + place + 2, F.lit(fanout - 1) - place), "")
        return F.struct(before.alias("before"), after.alias("after"))

    return F.transform(F.slice(F.sequence(F.lit(0), F.lit(depth - 1)), F.lit(1), height), step)


def placed(scratch: Scratch, nodes: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows of (g, *order, ...) with at, their place in group g from 0, and total, the group's size."""
    keys = [F.asc_nulls_first(c) for c in ["g", *order]]
    # the saved numbers hold partition and place, so that what follows doesn't depend on a second sort
    rows = scratch.save(nodes.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("row", F.monotonically_increasing_id()), name)
    part = F.shiftright("row", 33)
    counts = rows.groupBy("g", part.alias("part")).agg(F.count("*").alias("n"), F.min("row").alias("first"))
    # one row for each partition that a group meets
    line = Window.partitionBy("g").orderBy("part")
    counts = counts.select(
        F.col("g").alias("h"), "part", "first",
        F.coalesce(F.sum("n").over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy("g")).alias("total"),
    )
    met = rows.join(counts, rows.g.eqNullSafe(counts.h) & (part == counts.part))
    return met.withColumn("at", F.col("row") - F.col("first") + F.col("before")).drop("h", "part", "first", "before", "row")


def climb(scratch: Scratch, nodes: DataFrame, name: str, fanout: int = FANOUT, depth: int = DEPTH) -> list[DataFrame]:
    """Rounds of arrays, saved: g, block, total, rows (at, node, item), root. nodes: g, at, total, node, item."""
    size, rounds = fanout**depth, []
    while True:
        block = F.floor(F.col("at") / size).cast("long")
        held = nodes.groupBy("g", block.alias("block"), "total").agg(F.sort_array(F.collect_list(F.struct("at", "node", "item"))).alias("rows"))
        height = F.least(_height(F.col("total"), fanout), F.lit(depth))
        root = let(_levels(F.transform("rows", lambda r: r["node"]), height, fanout, depth), lambda v: F.element_at(F.element_at(v, -1), 1))
        rounds.append(scratch.save(held.withColumn("root", root), f"{name}-{len(rounds)}"))
        left = rounds[-1].where(F.col("total") > size)
        if left.isEmpty():
            return rounds
        nodes = left.select("g", F.col("block").alias("at"), F.ceil(F.col("total") / size).cast("long").alias("total"), F.col("root").alias("node"), F.lit(0).alias("item"))


def roots(rounds: list[DataFrame], size: int) -> DataFrame:
    """g, root of every group: of the one array in which it ends."""
    ends = [r.where(F.col("total") <= size).select("g", "root") for r in rounds]
    out = ends[0]
    for e in ends[1:]:
        out = out.union(e)
    return out


def descend(rounds: list[DataFrame], tops: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """g, at, node, item, path, info of every leaf. tops (g, path, info) hold what comes above the groups' roots."""
    size, above = fanout**depth, None
    for rows in reversed(rounds):
        ends = rows.where(F.col("total") <= size).select(F.col("g").alias("e"))
        # a group ends in one array, so a hot group is one row here
        over = tops.join(ends, F.col("g").eqNullSafe(F.col("e"))).select(F.col("g").alias("h"), F.lit(0).cast("long").alias("at"), "path", "info")
        if above is not None:
            over = over.union(above.select(F.col("g").alias("h"), "at", "path", "info"))
        met = rows.join(over, rows.g.eqNullSafe(over.h) & (rows.block == over.at))
        height = F.least(_height(F.col("total"), fanout), F.lit(depth))
        each = let(
            _levels(F.transform("rows", lambda r: r["node"]), height, fanout, depth),
            lambda levels: F.transform("rows", lambda r, i: F.struct(r["at"].alias("at"), r["node"].alias("node"), r["item"].alias("item"), F.concat(_path(levels, i, height, fanout, depth), F.col("path")).alias("path"))),
        )
        above = met.select("g", "info", F.explode(each).alias("x")).select("g", "x.*", "info")
    return above


def manifest(docs: DataFrame, columns=COLUMNS, group: str = "lang", order: str = "doc_id", carry: dict[str, Column] | None = None, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """One row a document: id, g (its group), leaf, path (before, after: from leaf to root), subroot, root, and carried expressions."""
    scratch, size = Scratch(docs.sparkSession), fanout**depth
    item = F.struct(F.col(quoted(order)).alias("id"), *(c.alias(k) for k, c in (carry or {}).items()))
    leaves = docs.select(F.col(quoted(group)).alias("g"), F.col(quoted(order)).alias("o"), leaf_of(*(F.col(quoted(c)) for c in columns)).alias("node"), item.alias("item"))
    rounds = climb(scratch, placed(scratch, leaves, ["o", "node"], "leaves").drop("o"), "groups", fanout, depth)
    subroots = roots(rounds, size).select(F.lit(0).alias("g"), F.col("g").alias("item"), F.col("root").alias("node"))
    over = climb(scratch, placed(scratch, subroots, ["item"], "subroots"), "top", fanout, depth)
    none = F.array().cast("array<struct<before:string,after:string>>")
    top = descend(over, roots(over, size).select("g", none.alias("path"), F.col("root").alias("info")), fanout, depth)
    tops = scratch.save(top.select(F.col("item").alias("g"), "path", F.struct(F.col("node").alias("subroot"), F.col("info").alias("root")).alias("info")), "tops")
    return descend(rounds, tops, fanout, depth).select("item.*", "g", F.col("node").alias("leaf"), "path", "info.subroot", "info.root")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path give."""
    return F.aggregate(path, leaf, lambda node, x: F.sha2(F.concat(x["before"], node, x["after"]), 256))


def proof_digest(path: Column) -> Column:
    """Hash of a path's digests in order."""
    return F.sha2(F.array_join(F.transform(path, lambda x: F.concat(x["before"], x["after"])), ""), 256)


def audit(docs: DataFrame, fanout: int = FANOUT, depth: int = DEPTH) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, where every seventh document by crc32 is tampered with.

    Tampering adds 1 to n_chars: the leaf is computed from the changed row and folded along the row's own path.
    """
    hit = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 0
    changed = F.when(hit, leaf_of(*(F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS)))
    proofs = manifest(docs, carry={"changed": changed}, fanout=fanout, depth=depth)
    out = proofs.select(F.col("id").alias("doc_id"), "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), folded(F.coalesce("changed", "leaf"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
