"""Exact deduplication: the index against a plain dictionary, batches, restarts, defined cases."""

import hashlib
import random

from pyspark.sql import functions as F

from glossa.llm import exact

SCHEMA = "doc_id long, text string, source string"


def plain(rows):
    size, keep = {}, {}
    for i, t, *_ in rows:
        t = t or ""
        size[t] = size.get(t, 0) + 1
        keep[t] = max(keep.get(t, (False, 0)), (i is not None, i or 0))
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    return sorted(((i is not None, i or 0), keep[t or ""], size[t or ""], sha(t)) for i, t, *_ in rows)


def got(df):
    some = lambda v: (v is not None, v or 0)
    return sorted((some(r.doc_id), some(r.keep_id), r.group_size, r.text_sha256) for r in df.collect())


def test_against_a_dictionary(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice(["a", "b ", "b", "", None, "x" * rng.randint(1, 40)]) if rng.random() < 0.8 else "hot", "s") for i in rng.sample(range(-500, 5000), 900)]
    for batches in (1, 2, 5):
        out = exact.dedup(spark.createDataFrame(rows, SCHEMA), batches=batches)
        assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
        assert got(out) == plain(rows)
        assert all((r.doc_id == r.keep_id) == r.kept for r in out.collect())


def test_defined_cases(spark):
    rows = [(1, "a", "s"), (1, "a", "s"), (2, None, "s"), (3, "", "s"), (None, "a", "s"), (None, "z", None), (4, "y" * 3_000_000, "s"), (5, "y" * 3_000_000, "s")]
    out = exact.dedup(spark.createDataFrame(rows, SCHEMA))
    assert got(out) == plain(rows)
    assert sum(r.kept for r in out.collect()) == 4  # one row for each text, though a row repeats
    assert exact.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
    clash = spark.createDataFrame([(1, "a", 1, 2), (2, "a", 3, 4)], "doc_id long, text string, digest long, row long")
    assert got(exact.dedup(clash)) == plain([(1, "a"), (2, "a")])


def test_index_outlives_its_session_and_takes_batches(spark, tmp_path):
    folder = str(tmp_path / "index")
    first = spark.createDataFrame([(1, "a", "s"), (2, "a", "s"), (3, "b", "s"), (3, "b", "s")], SCHEMA)
    kept = exact.keep_one(first, exact.DigestIndex(spark, folder, 4))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(2, "a"), (3, "b")]
    again = exact.DigestIndex(spark, folder, 4)  # opened anew
    assert exact.keep_one(first, again).count() == 0 and again.table().count() == 2
    second = spark.createDataFrame([(9, "a", "s"), (8, "c", "s"), (7, None, None)], SCHEMA)
    assert sorted(r.doc_id for r in exact.keep_one(second, again).collect()) == [7, 8]
    whole = again.compact()
    assert sorted(map(tuple, whole.table().select("keep_id").collect())) == [(2,), (3,), (7,), (8,)]
    assert exact.keep_one(second, whole).count() == 0
    clash = spark.createDataFrame([(20, "new", 1, 2, 3), (21, "new", 4, 5, 6)], "doc_id long, text string, digest int, keep int, batch int")
    assert [tuple(r) for r in exact.keep_one(clash, whole).collect()] == [(21, "new", 4, 5, 6)]


def test_normalised_texts(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "n"), 4, normal=lambda t: F.lower(F.trim(t)))
    assert exact.keep_one(spark.createDataFrame([(1, " A", "s"), (2, "a", "s")], SCHEMA), index).count() == 1


def test_index_is_not_shuffled(spark, tmp_path):
    index = exact.DigestIndex(spark, str(tmp_path / "p"), 4)
    docs = spark.createDataFrame([(i, str(i), "s") for i in range(50)], SCHEMA)
    index.add(index.digests(docs))
    new = index.digests(docs).groupBy("digest").agg(F.max("id")).repartition(index.buckets, "digest")
    plan = new.join(index.table().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    right = plan[plan.index("== Physical Plan ==") :].split("SortMergeJoin", 1)[1].split("\n")
    scan = next(i for i, line in enumerate(right) if "Bucketed: true" in line)
    assert not any("Exchange" in line for line in right[scan - 4 : scan])
