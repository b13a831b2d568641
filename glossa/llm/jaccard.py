"""N-gram Jaccard join with filters under several global token orders.

A document's set holds its distinct shingles as 64-bit hashes. Two documents link when their Jaccard similarity reaches
``percent`` / 100. Linked sets share a token among the first n - ceil(t n) + 1 of each under *every* global order, so a
pair is a candidate only if it passes that test under each of ORDERS orders; then whole sets are compared.

Each order sorts by a frequency class first and by a hash of its own second. The class is the magnitude of a counter in
a sketch of fixed size that counts every shingle of every document, so shingles that many documents share come last in
all orders. Any order gives the same links: the sketch only decides how much work they take.

Candidates come from the first order, in two rounds, so that no group is expanded into all its pairs. Round one compares
each member of a token's group with the group's smallest document. Links found there join components; a group that lies in
one component is done. Round two compares members of different components whose sizes fit: in groups of up to SMALL
members all pairs but those whose known distances to the group's smallest document differ by more than 1 - t, as the
Jaccard distance obeys the triangle inequality; in larger groups those that a prefix filter on the differences from the
smallest document leaves. Documents with equal sets are one member throughout.

A pair counts in a group only where the token's places in both sets leave room for enough shared tokens after it. Under the
other orders prefixes are twice as long, and the tokens that two of them share must be so many that the rest could make up
what is wanting. Before prefixes are fetched, maps of 1,024 bits of the whole sets are held against each other, as bits that
only one side has stand for tokens that it doesn't share. These bounds hold for every linked pair, and cut pairs before whole
sets are fetched.

Prefixes are grouped in PARTS ranges of tokens, one after the other, as most of their tokens are held by one document and end
there. Prefixes and whole sets are fetched for PAIRS pairs at a time, or a quarter of the documents if that is more, and maps for
MAPS times as many. So what is on disk at a time grows with the documents, whatever the number of pairs.

Tokens that the sketch shows to be rare are grouped by a window. Those it can't show to be so are counted with map-side
aggregation and joined with their counts, so that no task need hold all rows of a frequent token.

Sets are compared by hash: two documents of n shingles meet a false match with a probability near n^2 / 2^64.

Defined cases: null and empty texts have no shingles and no links; texts with fewer words than a shingle are one shingle;
rows that repeat a doc_id with an equal text are one document, and those with another text are documents of their own; a
null doc_id has its n_shingles, no links and a null component; an empty table gives no rows; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, all_of, bit_map, components, hits, sliced, unused

SLOTS, SIDE, ORDERS = 1 << 19, 16, 3
BITS = tuple(f"b{i}" for i in range(16))
#: Tokens whose slot counts fewer than 2^RARE documents are grouped by a window.
RARE = 16
#: Ranges of tokens that are grouped one after the other; pairs that are verified at a time, unless the documents are many; times as many meet by maps.
PARTS, PAIRS, MAPS = 4, 50_000, 8
#: Groups of up to so many members are compared pair by pair; larger ones by differences from their smallest document.
SMALL = 8


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """Distinct shingles of a text as sorted 64-bit hashes. Words are split at ASCII white space; A-Z count as a-z."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known: dict[bytes, int] = {}
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter((known[w] for w in words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        width = min(width, len(h))
        out = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            out = _mix(out + h[k : k + len(out)] + np.uint64(k + 1))
    return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def needed(n: int, percent: int) -> int:
    """Tokens that a set of n shares at least with any set it links to."""
    return -(-percent * n // 100)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """block, c0, c1, …: how many documents' shingles fall into each of SLOTS slots, SIDE of them side by side in a row."""

    def count(batches):
        counts = np.zeros(SLOTS, np.int64)
        for part in sliced(batches, 0):
            sets = [shingle_hashes(t.as_py(), width) for t in part.column(0)]
            counts += np.bincount((np.concatenate(sets) & np.uint64(SLOTS - 1)).astype(np.int64), minlength=SLOTS)
        blocks = counts.reshape(-1, SIDE)
        full = np.flatnonzero(blocks.any(axis=1))
        for k in range(0, len(full), 8192):
            at = full[k : k + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *(pa.array(blocks[at, i]) for i in range(SIDE))], names)

    names = ["block", *(f"c{i}" for i in range(SIDE))]
    found = docs.select("text").mapInArrow(count, "block int, " + ", ".join(f"c{i} long" for i in range(SIDE)))
    return found.groupBy("block").agg(*(F.sum(c).alias(c) for c in names[1:]))


def classes(spark: SparkSession, counts: DataFrame):
    """The magnitude of each slot's count, as a broadcast of SLOTS bytes."""
    rows = counts.select("block", *(F.floor(F.log2(F.greatest(F.col(f"c{i}"), F.lit(1)))).cast("byte").alias(f"c{i}") for i in range(SIDE))).toArrow()
    out = np.zeros((SLOTS // SIDE, SIDE), np.uint8)
    for i in range(SIDE):
        out[rows["block"].to_numpy(), i] = rows[f"c{i}"].to_numpy()
    return spark.sparkContext.broadcast(out.ravel())


def profiles(docs: DataFrame, width: int, percent: int, ranks) -> DataFrame:
    """doc_id, n, set_id (128-bit fingerprint), the prefix under each order, and how many tokens of the first are rare.

    The first prefix is in order. The others are twice as long, and sets of 32-bit values.
    """

    def build(batches):
        for part in sliced(batches, 1):
            counts, names, rare, kept, bits = [], [], [], [[] for _ in range(ORDERS)], []
            for text in part.column(1):
                h = shingle_hashes(text.as_py(), width)
                n = len(h)
                counts.append(n)
                names.append(xxhash.xxh3_128_digest(h.tobytes()))
                rank = ranks.value[(h & np.uint64(SLOTS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(58)
                size = n and n - needed(n, percent) + 1
                for k in range(ORDERS):
                    keys = rank | (_mix(h ^ np.uint64(k + 1)) >> np.uint64(6))
                    if k == 0:
                        first = np.argsort(keys)[:size]
                        rare.append(int((rank[first] < (np.uint64(RARE) << np.uint64(58))).sum()))
                        kept[0].append(h[first])
                    else:
                        some = longer(n, percent)
                        first = np.argpartition(keys, some - 1)[:some] if some < n else slice(None)
                        kept[k].append(np.unique(h[first] >> np.uint64(32)))
                marks = np.zeros(64 * len(BITS), bool)
                marks[(h & np.uint64(64 * len(BITS) - 1)).astype(np.int64)] = True
                bits.append(np.packbits(marks).view(np.int64))
            lists = [*(pa.array(c) for c in np.array(bits).T), _lists(kept[0], np.int64), *(_lists(kept[k], np.int32) for k in range(1, ORDERS))]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(rare, pa.int32()), *lists], ["doc_id", "n", "set_id", "rare", *BITS, *(f"p{k}" for k in range(ORDERS))])

    kinds = ", ".join([*(f"{b} long" for b in BITS), "p0 array<long>", *(f"p{k} array<int>" for k in range(1, ORDERS))])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(build, f"doc_id long, n long, set_id binary, rare int, {kinds}")


def longer(n: int, percent: int) -> int:
    """Tokens of a prefix under the orders after the first."""
    return min(n, 2 * (n - needed(n, percent) + 1))


def _lists(arrays: list[np.ndarray], kind) -> pa.ListArray:
    """A list column; values of another width are cut to their low bits."""
    sizes = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    flat = np.concatenate([*arrays, np.empty(0, np.uint64)])
    return pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.view(np.int64).astype(kind)))


def _sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(doc_id, tokens) of the wanted documents. A bit map of fixed size tells tasks which texts to skip."""

    def build(batches):
        for part in sliced(batches, 1):
            yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingle_hashes(t.as_py(), width) for t in part.column(1)], np.int64)], ["doc_id", "tokens"])

    named = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    built = hits(named, bit_map(wanted, F.col("doc_id")), F.col("doc_id")).mapInArrow(build, "doc_id long, tokens array<long>")
    return built.join(wanted, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def _both(a: str, b: str, percent: int) -> Column:
    """Whether sets of these sizes can link."""
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def _least(x: str, y: str, percent: int) -> Column:
    """Tokens that linked sets of sizes x and y share at least."""
    return F.expr(f"({percent} * ({x} + {y}) + {100 + percent} - 1) div {100 + percent}")


def _room(nx: str, ax: str, ny: str, ay: str, percent: int) -> Column:
    """Whether sets that first meet at places ax and ay (from 0) of the order can share enough."""
    return F.least(F.col(nx) - F.col(ax), F.col(ny) - F.col(ay)) >= _least(nx, ny, percent)


def _most(table: DataFrame) -> int:
    """Pairs that are verified at a time."""
    return max(PAIRS, table.count() // 4)


def _slices(pairs: DataFrame, most: int):
    """The saved pairs (x, y), at most about so many at a time."""
    many = max(1, -(-pairs.count() // most))
    for i in range(many):
        yield pairs if many == 1 else pairs.where(F.pmod(F.xxhash64("x", "y"), F.lit(many)) == i)


def _ends(pairs: DataFrame) -> DataFrame:
    """Map of the documents of pairs."""
    return bit_map(pairs.select(F.col("x").alias("doc_id")).union(pairs.select("y")), F.col("doc_id"))


def _side(table: DataFrame, known: DataFrame, k: str, *columns: str) -> DataFrame:
    """Columns of the documents of pairs, named for one side."""
    some = hits(table.select("doc_id", *columns), known, F.col("doc_id"))
    return some.select(F.col("doc_id").alias(k), *(F.col(c).alias(f"n{k}" if c == "n" else f"{k}_{c}") for c in columns))


def _mapped(table: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """x, y, nx, ny, large of the pairs (x, y, large) that the maps of their sets leave."""
    some = _ends(pairs)
    mapped = pairs.join(_side(table, some, "x", "n", *BITS), "x").join(_side(table, some, "y", "n", *BITS), "y")
    only = lambda a, b: sum((F.bit_count(F.col(f"{a}_{c}").bitwiseAND(F.bitwise_not(f"{b}_{c}"))) for c in BITS), F.lit(0))
    mapped = mapped.where((only("x", "y") <= F.col("nx") - _least("nx", "ny", percent)) & (only("y", "x") <= F.col("ny") - _least("nx", "ny", percent)))
    return mapped.select("x", "y", "nx", "ny", "large")


def _passed(table: DataFrame, mapped: DataFrame, percent: int) -> DataFrame:
    """x, y, large of the mapped pairs that pass the filter of every further order."""
    other = [f"p{k}" for k in range(1, ORDERS)]
    size = lambda n: f"least({n}, 2 * ({n} - ({percent} * {n} + 99) div 100 + 1))"
    outside = F.greatest(F.expr(f"nx - {size('nx')}"), F.expr(f"ny - {size('ny')}"))
    need = _least("nx", "ny", percent) - outside
    few = _ends(mapped)
    passed = mapped.join(_side(table, few, "x", *other), "x").join(_side(table, few, "y", *other), "y")
    for c in other:
        both = F.size(F.array_intersect(f"x_{c}", f"y_{c}"))
        merged = F.expr(size("nx")) - F.size(f"x_{c}")
        passed = passed.where((both > 0) & (both + merged >= need))
    return passed.select("x", "y", "large")


def _verified(scratch: Scratch, docs: DataFrame, table: DataFrame, pairs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """x, y, nx, ny, shared for the saved pairs (x, y, large) that pass the filter of every further order; delta for the large ones.

    delta holds the tokens that are in one of the two sets only. What two prefixes share is all that they can share but for
    the tokens outside one of them. Prefixes are sets of 32-bit values: what that merges is granted to the pair. They are
    fetched for what the maps leave, as most pairs end there.
    """
    most = _most(table)
    mapped = scratch.parts(f"{name}-mapped", [scratch.save(_mapped(table, some, percent), f"{name}-mapped/{i}") for i, some in enumerate(_slices(pairs, MAPS * most))])
    met = []
    for i, some in enumerate(_slices(mapped, most)):
        passed = scratch.save(_passed(table, some, percent), f"{name}-passed")
        wanted = scratch.save(passed.select(F.col("x").alias("doc_id")).union(passed.select("y")).distinct(), f"{name}-wanted")
        sets = scratch.save(_sets(docs, wanted, width), f"{name}-sets")
        both = passed.join(sets.select(F.col("doc_id").alias("x"), F.col("tokens").alias("a")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("tokens").alias("b")), "y")
        delta = F.when(F.col("large"), F.concat(F.array_except("a", "b"), F.array_except("b", "a")))
        both = both.select("x", "y", F.size("a").cast("long").alias("nx"), F.size("b").cast("long").alias("ny"), F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), delta.alias("delta"))
        met.append(scratch.save(both, f"{name}-met/{i}"))
        for part in ("sets", "wanted", "passed"):
            scratch.drop(f"{name}-{part}")
    scratch.drop(f"{name}-mapped")
    return scratch.parts(f"{name}-met", met)


def _sides(mixed: DataFrame) -> tuple[DataFrame, DataFrame]:
    return tuple(mixed.select("token", F.col("doc_id").alias(d), *(F.col(c).alias(f"{k}{d}") for c, k in (("n", "n"), ("at", "a"), ("component", "c"), ("far", "f")))) for d in "xy")


def _small_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs within groups of at most SMALL members that lie in different components and that no bound rules out."""
    a, b = _sides(mixed)
    near = F.coalesce(F.abs(F.col("fx") - F.col("fy")) <= 1 - percent / 100 + 1e-9, F.lit(True))
    return a.join(b, "token").where("x < y AND cx <> cy").where(_both("nx", "ny", percent)).where(_room("nx", "ax", "ny", "ay", percent)).where(near).select("x", "y").distinct()


def _unplaced_pairs(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs within larger groups of which one has not been compared with the group's smallest document."""
    a, b = _sides(mixed)
    pairs = a.where("fx IS NULL").join(b, "token").where("cx <> cy AND (fy IS NOT NULL OR x < y)").where(_both("nx", "ny", percent)).where(_room("nx", "ax", "ny", "ay", percent))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _delta_pairs(met: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs of documents that were compared with the same smallest document of a larger group, by how they differ from it.

    Two sets link when the tokens that only one of them has are at most B = nx + ny - 2 s, s being the least overlap of
    sets that link. Their differences from a third set, of sizes dx and dy, must then share c = (dx + dy - B) / 2 tokens.
    c is at least 1 unless both link with the third set. So a prefix filter applies to the differences: with the rarest
    tokens first, a shared token must stand among the first dx - c + 1 of the one and dy - c + 1 of the other.
    """
    linked = 100 * F.col("shared") >= percent * (F.col("nx") + F.col("ny") - F.col("shared"))
    star = met.where("delta IS NOT NULL").select(F.col("x").alias("hub"), F.col("y").alias("doc_id"), F.col("ny").alias("n"), linked.alias("linked"), F.size("delta").cast("long").alias("d"), "delta")
    star = star.join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    each = star.select("hub", "doc_id", "n", "linked", "d", "component", F.explode("delta").alias("token"))
    each = each.withColumn("held", F.expr("count(*) OVER (PARTITION BY hub, token)"))
    each = each.withColumn("at", F.expr("row_number() OVER (PARTITION BY hub, doc_id ORDER BY held, token)").cast("long")).where("held > 1")
    a, b = (each.select("hub", "token", F.col("doc_id").alias(k), F.col("n").alias(f"n{k}"), F.col("linked").alias(f"l{k}"), F.col("d").alias(f"d{k}"), F.col("component").alias(f"c{k}"), F.col("at").alias(f"a{k}")) for k in "xy")
    need = F.ceil((F.col("dx") + F.col("dy") - (F.col("nx") + F.col("ny") - 2 * _least("nx", "ny", percent))) / 2)
    pairs = a.where("NOT lx").join(b, ["hub", "token"]).where("x <> y AND cx <> cy AND (ly OR x < y)").where((F.col("ax") <= F.col("dx") - need + 1) & (F.col("ay") <= F.col("dy") - need + 1))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def _linked(met: DataFrame, percent: int) -> DataFrame:
    return met.where(100 * F.col("shared") >= percent * (F.col("nx") + F.col("ny") - F.col("shared"))).select("x", "y")


def _grouped(tokens: DataFrame) -> DataFrame:
    """token, doc_id, n, at, held, hub, hub_n, hub_at of tokens that several documents hold."""
    group, hub = "OVER (PARTITION BY token)", "struct(doc_id, n, at)"
    few = tokens.where("rare").select("token", "doc_id", "n", "at", F.expr(f"count(*) {group}").alias("held"), F.expr(f"min({hub}) {group}").alias("hub")).where("held > 1")
    many = tokens.where("NOT rare").select("token", "doc_id", "n", "at")
    counts = many.groupBy("token").agg(F.count("*").alias("held"), F.expr(f"min({hub})").alias("hub")).where("held > 1")
    both = few.unionByName(many.join(counts, "token"))
    return both.select("token", "doc_id", "n", "at", "held", F.col("hub.doc_id").alias("hub"), F.col("hub.n").alias("hub_n"), F.col("hub.at").alias("hub_at"))


def _components(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """jaccard_components of (doc_id, text) in which no doc_id repeats, saved."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    ranks = classes(spark, scratch.save(sketch(docs, width), "sketch"))
    table = scratch.save(profiles(docs, width, percent, ranks), "profiles")
    small = table.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "set_id")
    members = scratch.save(small.join(small.groupBy("n", "set_id").agg(F.min("doc_id").alias("member")), ["n", "set_id"]).select("doc_id", "member"), "members")
    # of equal sets one goes on; a prefix is shuffled only where the map of the others' keys doesn't show that it stays
    copies = members.where("doc_id <> member").select("doc_id")
    known, prefixes = bit_map(copies, F.col("doc_id")), table.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "rare", "p0")
    tokens = hits(prefixes, known, F.col("doc_id"), wanted=False).union(hits(prefixes, known, F.col("doc_id")).join(copies, "doc_id", "left_anti"))
    tokens = tokens.select("doc_id", "n", F.posexplode("p0").alias("at", "token"), "rare").select("token", "doc_id", "n", "at", (F.col("at") < F.col("rare")).alias("rare"))
    some = [scratch.save(_grouped(tokens.where(F.pmod("token", F.lit(PARTS)) == i)), f"tokens/{i}") for i in range(PARTS)]
    tokens = scratch.parts("tokens", some)

    # the pair is wanted if any of its tokens leaves room; it is large if any of its groups is
    first = tokens.where("doc_id <> hub").where(_both("n", "hub_n", percent)).withColumn("room", _room("n", "at", "hub_n", "hub_at", percent))
    first = first.groupBy(F.col("hub").alias("x"), F.col("doc_id").alias("y")).agg(F.max(F.col("held") > SMALL).alias("large"), F.max("room").alias("room")).where("room").drop("room")
    first = scratch.save(first, "first")
    met = _verified(scratch, docs, table, first, width, percent, "one")
    links = _linked(met, percent)
    found = components(scratch, links, "x", "y", "one")
    parts = found.withColumnRenamed("node", "doc_id")

    far = met.select(F.col("x").alias("hub"), F.col("y").alias("doc_id"), (1 - F.col("shared") / (F.col("nx") + F.col("ny") - F.col("shared"))).alias("far"))
    # pairs of groups of two have been compared
    placed = tokens.where("held > 2").join(parts, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id")).join(far, ["hub", "doc_id"], "left")
    placed = placed.withColumn("far", F.when(F.col("doc_id") == F.col("hub"), F.lit(0.0)).otherwise(F.col("far"))).select("token", "doc_id", "n", "at", "component", "far", (F.col("held") > SMALL).alias("large"))
    placed = scratch.save(placed, "placed")
    scratch.drop("tokens")
    mixed = scratch.save(placed.join(placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token"), "token"), "mixed")
    scratch.drop("placed")
    second = _small_pairs(mixed.where("NOT large"), percent).union(_unplaced_pairs(mixed.where("large"), percent)).union(_delta_pairs(met, parts, percent)).distinct()
    second = scratch.save(second.join(met.select("x", "y"), ["x", "y"], "left_anti").withColumn("large", F.lit(False)), "second")
    scratch.drop("mixed")
    more = _linked(_verified(scratch, docs, table, second, width, percent, "two"), percent)
    found = components(scratch, links.union(more), "x", "y", "all")

    placed = members.join(found.withColumnRenamed("node", "member"), "member", "left").select("doc_id", F.coalesce("component", "member").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    every = table.select("doc_id", F.col("n").alias("n_shingles")).join(placed, "doc_id", "left").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return scratch.last(every, "components")


def _repeats(docs: DataFrame) -> bool:
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def _keyed(docs: DataFrame, name: str = "__key") -> DataFrame:
    """docs with a 64-bit name of doc_id and text; null where doc_id is."""
    return docs.withColumn(name, F.when(F.col("doc_id").isNotNull(), F.xxhash64(F.col("doc_id").cast("long"), F.md5("text"))))


def _texts(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """__key, doc_id, n_shingles, lead for each distinct doc_id and text, and each null doc_id; lead is the first (doc_id, __key) of its component."""
    scratch = Scratch(docs.sparkSession)
    keyed = _keyed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    once = scratch.save(keyed.where("__key IS NOT NULL").dropDuplicates(["__key"]).union(keyed.where("__key IS NULL")), "texts")
    found = scratch.save(_components(once.select(F.col("__key").alias("doc_id"), "text"), width, percent), "found")
    owned = found.where("doc_id IS NOT NULL").withColumnRenamed("doc_id", "__key").join(once.where("__key IS NOT NULL").select("__key", "doc_id"), "__key")
    leads = owned.groupBy("component_id").agg(F.min(F.struct("doc_id", "__key")).alias("lead"))
    named = owned.join(leads, "component_id").select("__key", "doc_id", "n_shingles", "lead")
    none = found.where("doc_id IS NULL").select(F.col("doc_id").alias("__key"), "doc_id", "n_shingles", F.lit(None).cast(named.schema["lead"].dataType).alias("lead"))
    return scratch.last(named.union(none), "leads")


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id: the smallest doc_id reachable by links, itself included.

    One row for each row of docs. component_id of a document without shingles is its own doc_id.
    """
    docs = docs.select("doc_id", "text")
    if not _repeats(docs):
        return _components(docs, width, percent)
    texts = _texts(docs, width, percent)
    each = _keyed(docs).where("__key IS NOT NULL").select("__key").join(texts, "__key")
    return each.union(texts.where("__key IS NULL")).select("doc_id", "n_shingles", F.col("lead.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents of which doc_id is the smallest of its component, and those without a doc_id; columns as they came."""
    name, keep = unused(docs, "key", "keep")
    if _repeats(docs):
        kept = _texts(docs, width, percent).where("__key = lead.__key").select(F.col("__key").alias(keep))
        found = _keyed(docs, name).join(kept, F.col(name) == F.col(keep), "left_semi").dropDuplicates([name]).select(*all_of(docs))
    else:
        gone = _components(docs.select("doc_id", "text"), width, percent).where("component_id <> doc_id").select(F.col("doc_id").alias(keep))
        # most documents stay: texts are shuffled only where the map of those that go doesn't show it
        ident = F.col("doc_id").cast("long")
        known, named = bit_map(gone, F.col(keep)), docs.where("doc_id IS NOT NULL")
        found = hits(named, known, ident, wanted=False).unionByName(hits(named, known, ident).join(gone, ident == F.col(keep), "left_anti"))
    return found.unionByName(docs.where("doc_id IS NULL"))
