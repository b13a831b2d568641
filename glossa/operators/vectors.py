"""Vector search: a stated query set against all rows, in blocks.

A block of queries has a bounded size and travels as a broadcast; each batch of rows meets it in matrix products of at most
CELLS similarities, of which a task's best of each query, or those over a threshold, go on. So nothing of the size of the table
is shuffled or crossed, and a task's memory doesn't depend on the number of queries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources import store

#: Queries of a block; rows of a batch and similarities that a task holds at a time.
BLOCK, ROWS, CELLS = 8192, 8192, 1 << 20


def cosine(a: Column, b: Column, dims: Column | None = None) -> Column:
    """Cosine of two arrays, of the dimensions where dims (an array of 0 and 1) is 1."""
    a, b = a.cast("array<double>"), b.cast("array<double>")
    if dims is not None:
        mask = dims.cast("array<double>")
        a, b = F.zip_with(a, mask, lambda x, m: x * m), F.zip_with(b, mask, lambda x, m: x * m)
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _unit(lists: pa.Array) -> np.ndarray:
    flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(lists), -1)
    return flat / np.maximum(np.linalg.norm(flat, axis=1, keepdims=True), 1e-300)


def _blocks(queries: DataFrame):
    """Blocks of at most BLOCK or so queries, each as a broadcast (ids, unit vectors); the driver holds one at a time."""
    n = queries.count()
    many = max(1, -(-n // BLOCK))
    for k in range(many):
        part = queries if many == 1 else queries.where(F.pmod(F.xxhash64("id"), F.lit(many)) == k)
        t = part.toArrow()
        if t.num_rows:
            v = t["v"].combine_chunks()
            yield queries.sparkSession.sparkContext.broadcast((t["id"].to_numpy(), _unit(v.chunk(0) if isinstance(v, pa.ChunkedArray) else v)))


def _tile(ids: np.ndarray, units: np.ndarray, own: np.ndarray, theirs: np.ndarray, k: int | None, least: float | None):
    """Places of queries and of rows that go on, with their similarity: each query's k best rows, or those of at least a similarity.

    A product's last bits depend on a row's place in the matrix, so the best rows are chosen by sums made for each pair
    alone: equal vectors tie, and the smaller id goes first.
    """
    sims = units @ theirs.T
    sims[ids[:, None] == own[None, :]] = -2.0
    if k is None or k >= len(own):
        q, r = np.nonzero(sims > -2.0 if least is None else sims >= least)
        return q, r, _each(units, theirs, q, r) if least is None else sims[q, r]
    edge = sims.max(axis=1, keepdims=True) if k == 1 else -np.partition(-sims, k - 1, axis=1)[:, k - 1, None]
    q, r = np.nonzero(sims >= np.maximum(edge - 1e-9, -1.9))
    exact = _each(units, theirs, q, r)
    order = np.lexsort((own[r], -exact, q))
    q, r, exact = q[order], r[order], exact[order]
    best = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[best], r[best], exact[best]


def _each(units: np.ndarray, theirs: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The similarity of each pair, summed in one order, a bounded number of pairs at a time."""
    step = max(1, CELLS // max(1, units.shape[1]))
    return np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", units[q[i : i + step]], theirs[r[i : i + step]]) for i in range(0, len(q), step))])


def _search(ids: np.ndarray, units: np.ndarray, batches, k: int | None, least: float | None):
    """query_id, id, sim of the queries of a block and the rows of batches, tile by tile; each query's k best come once, at the end."""
    best = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            own, theirs = part.column(0).to_numpy(), _unit(part.column(1))
            step = max(1, CELLS // len(own))
            found = [best]
            for at in range(0, len(ids), step):
                q, r, sims = _tile(ids[at : at + step], units[at : at + step], own, theirs, k, least)
                if k is None:
                    yield _found(ids, at + q, own[r], sims)
                else:
                    found.append((at + q, own[r], sims))
            if k is not None:
                q, r, sims = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((r, -sims, q))
                q, r, sims = q[order], r[order], sims[order]
                first = np.arange(len(q)) - np.searchsorted(q, q) < k
                best = q[first], r[first], sims[first]
    if k is not None:
        yield _found(ids, *best)


def _found(ids: np.ndarray, q: np.ndarray, own: np.ndarray, sims: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids[q].astype(np.int64)), pa.array(own.astype(np.int64)), pa.array(sims)], ["query_id", "id", "sim"])


def matches(queries: DataFrame, rows: DataFrame, k: int | None = None, least: float | None = None) -> DataFrame:
    """query_id, id, sim: of each query (id, v) the k best rows (id, v) or those of at least a similarity; not itself."""
    schema, out = "query_id long, id long, sim double", None
    for block in _blocks(queries):

        search = lambda batches, block=block: _search(*block.value, batches, k, least)
        found = rows.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(search, schema)
        out = found if out is None else out.union(found)
    if out is None:
        return queries.sparkSession.createDataFrame([], schema)
    if k is None:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("sim"), "id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def inverse_rank(targets: DataFrame, sources: DataFrame, k: int) -> DataFrame:
    """source_id, place, target_id, given, sim: each target ranks its k nearest sources (given, from 0); the targets of a
    source are ordered by the rank that they give it, k of them at most."""
    near = matches(targets, sources, k=k).select(F.col("query_id").alias("target_id"), F.col("id").alias("source_id"), (F.col("rank") - 1).alias("given"), "sim")
    place = F.row_number().over(Window.partitionBy("source_id").orderBy("given", F.desc("sim"), "target_id"))
    return near.withColumn("place", place - 1).where(F.col("place") < k)


def _products(pairs: DataFrame) -> DataFrame:
    """good, ab, aa, bb: products by dimension of each pair (a, b, good), saved; sums over any dimensions follow from them."""
    a, b = F.col("a").cast("array<double>"), F.col("b").cast("array<double>")
    by = lambda x, y: F.zip_with(x, y, lambda p, q: p * q)
    return store.saved(pairs.where("good IS NOT NULL").select(F.col("good").cast("boolean").alias("good"), by(a, b).alias("ab"), by(a, a).alias("aa"), by(b, b).alias("bb")), store.new_folder(pairs.sparkSession, "products"))


def _gaps(products: DataFrame, size: int, dropped: list[int]) -> np.ndarray:
    """The gap between the mean cosines of good and bad pairs without each dimension, and last without the dropped ones alone.

    One narrow pass: a task keeps two rows of sums, whatever number of pairs it reads. Pairs without a cosine don't count.
    """
    kept = np.array([i not in set(dropped) for i in range(size)])

    def sums(batches):
        total, count = np.zeros((2, size + 1)), np.zeros((2, size + 1))
        for batch in batches:
            good = batch.column(0).to_numpy(zero_copy_only=False)
            ab, aa, bb = (np.asarray(batch.column(c).flatten()).reshape(len(good), size) * kept for c in (1, 2, 3))
            less = lambda x: np.concatenate([x.sum(axis=1, keepdims=True) - x, x.sum(axis=1, keepdims=True)], axis=1)
            with np.errstate(divide="ignore", invalid="ignore"):
                cosines = less(ab) / np.sqrt(np.maximum(less(aa) * less(bb), 0.0))
            fine = np.isfinite(cosines)
            for side in (0, 1):
                mine = good == bool(side)
                total[side] += np.where(fine, cosines, 0.0)[mine].sum(axis=0)
                count[side] += fine[mine].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1]), pa.array(list(total)), pa.array(list(count))], ["side", "total", "count"])

    rows = products.mapInArrow(sums, "side long, total array<double>, count array<double>").select("side", F.posexplode(F.arrays_zip("total", "count")).alias("i", "x"))
    means = np.zeros((2, size + 1))
    for r in rows.groupBy("side", "i").agg(F.sum("x.total").alias("t"), F.sum("x.count").alias("n")).collect():  # two rows a dimension
        means[r["side"], r["i"]] = r["t"] / r["n"] if r["n"] else 0.0
    return means[1] - means[0]


def reduce_dimensions(pairs: DataFrame, size: int, rounds: int, restore_every: int = 3, only_gains: bool = False) -> list[int]:
    """Dimensions dropped, in order, to widen the gap between good and bad pairs (a, b, good).

    Each round drops the dimension without which the gap is widest, of equal ones the first; each ``restore_every``-th round
    the one dropped earliest comes back before that. With ``only_gains`` it ends once no drop widens the gap. Products by dimension
    are saved once, and a round is one narrow pass over them.
    """
    products, dropped = _products(pairs), []
    for n in range(1, rounds + 1):
        if n % restore_every == 0 and dropped:
            dropped.pop(0)
        if len(dropped) == size - 1:
            break
        gaps = _gaps(products, size, dropped)
        best = min((i for i in range(size) if i not in dropped), key=lambda i: (-round(gaps[i], 12), i))
        if only_gains and gaps[best] <= gaps[size]:
            break
        dropped.append(best)
    return dropped


def negative_pairs(rows: DataFrame, seed: int = 1) -> DataFrame:
    """a_id, b_id, a, b: each row (id, v) with another one that a hash of its id and a seed picks."""
    from glossa.operators.tokens import ranked

    numbered = ranked(rows, "id")
    n = F.broadcast(rows.agg(F.count("*").alias("n")))  # one row
    step = F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.col("n") - 1, F.lit(1))) + 1
    wanted = numbered.join(n).select(F.col("id").alias("a_id"), F.col("v").alias("a"), (F.pmod(F.col("rank") - 1 + step, F.col("n")) + 1).alias("rank"))
    return wanted.join(numbered.select("rank", F.col("id").alias("b_id"), F.col("v").alias("b")), "rank").where("a_id <> b_id").select("a_id", "b_id", "a", "b")


def trained(docs: DataFrame, words: str, size: int = 300, window: int = 65, least: int = 5, seed: int = 1) -> DataFrame:
    """word, vector of Spark ML's skip-gram model over arrays of words."""
    from pyspark.ml.feature import Word2Vec
    from pyspark.ml.functions import vector_to_array

    model = Word2Vec(vectorSize=size, windowSize=window, minCount=least, seed=seed, inputCol=words, outputCol="__v", maxSentenceLength=10_000).fit(docs)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def nearest_words(vectors: DataFrame, word: str, k: int = 20) -> DataFrame:
    """word, sim of the k words whose vectors are nearest to one word's."""
    own = F.broadcast(vectors.where(F.col("word") == word).select(F.col("vector").alias("own")).limit(1))  # one row
    return vectors.where(F.col("word") != word).join(own).select("word", cosine(F.col("vector"), F.col("own")).alias("sim")).orderBy(F.desc("sim"), "word").limit(k)
