"""Positional indexes against scans, generations against an index built anew."""

import random
import re

import pytest

from pyspark.sql import functions as F

from glossa.operators import positional as P
from glossa.operators.generations import Generations

SCHEMA = "doc_id long, text string"


def plain(rows, query, least=1):
    """(key, starts): a place fits when its term is one of the query's there, or when all of those are too short to be indexed."""
    out = []
    for key, text in rows:
        w = re.findall("[a-zà-ÿ]+", (text or "").lower())
        fits = lambda i: all(not [x for x in q if len(x) >= least] or w[i + k] in q for k, q in enumerate(query))
        starts = [i for i in range(len(w) - len(query) + 1) if fits(i)]
        if starts:
            out.append((key, starts))
    return sorted(out)


def texts(n, seed, words="a b c d aa bb cc é the"):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choices(words.split(), k=rng.randint(0, 40))) if rng.random() < 0.95 else None) for i in range(n)]


def found(index, query):
    return sorted((r.key, r.starts) for r in index.phrase(query).collect())


def test_phrases_equal_a_scan(spark, tmp_path):
    rows = texts(150, 5)
    index = P.PositionalIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", fresh=True)
    for q in (["a"], ["a", "b"], ["a", "a"], ["the", "a", "the"], [["a", "aa"], ["b", "bb"]], ["a", "missing"], ["é", "a"]):
        assert found(index, q) == plain(rows, [[x] if isinstance(x, str) else x for x in q]), q
    assert found(index, []) == []
    assert sorted(map(tuple, index.lengths().collect())) == [(k, len(re.findall("[a-zà-ÿ]+", t or ""))) for k, t in rows]


def test_long_starts_meet_frequent_words_without_a_broadcast(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(P, "FEW_PLACES", 0)
    rows = texts(60, 6)
    index = P.PositionalIndex(spark, str(tmp_path / "i"), buckets=2)
    index.add(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", fresh=True)
    assert found(index, ["a", "b", "the"]) == plain(rows, [["a"], ["b"], ["the"]])


def test_short_terms_are_places_only(spark, tmp_path):
    rows = texts(120, 8)
    index = P.PositionalIndex(spark, str(tmp_path / "i"), buckets=4, least=2)
    index.add(spark.createDataFrame(rows, SCHEMA), "doc_id", "text", fresh=True)
    for q in (["aa", "x"], ["x", "aa"], ["aa", "x", "bb"], ["the", "y", "z"]):
        assert found(index, q) == plain(rows, [[x] for x in q], 2), q
    assert index.table.rows(["a"]).count() == 0


def live(table):
    return sorted(tuple(r) for r in table.rows().select("term", "key", "positions").collect())


def test_three_batches_equal_an_index_built_anew(spark, tmp_path):
    state, index = {}, P.PositionalIndex(spark, str(tmp_path / "i"), buckets=8)
    for step in range(3):
        batch = dict((k + 20 * step, t) for k, t in texts(40, step))
        index.add(spark.createDataFrame(list(batch.items()), SCHEMA), "doc_id", "text")
        gone = [k for k in list(state)[:5]]
        state |= batch
        if gone:
            index.remove(spark.createDataFrame([(k,) for k in gone], "doc_id long"), "doc_id")
            for k in gone:
                state.pop(k)
    anew = P.PositionalIndex(spark, str(tmp_path / "anew"), buckets=8)
    anew.add(spark.createDataFrame(sorted(state.items()), SCHEMA), "doc_id", "text", fresh=True)
    assert live(index.table) == live(anew.table)
    assert found(index, ["a", "b"]) == found(anew, ["a", "b"]) == plain(sorted(state.items()), [["a"], ["b"]])
    index.table.compact(1)
    index.table.vacuum()
    assert live(index.table) == live(anew.table)
    assert len([r for r in index.table.version() if r["kind"] == "gone"]) <= 1
    again = P.PositionalIndex(spark, str(tmp_path / "i"), buckets=8)  # opened by another session
    assert live(again.table) == live(anew.table)


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    table = Generations(spark, str(tmp_path / "g"), "term string, key long, positions array<int>", 8)
    row = lambda terms, k: spark.createDataFrame([(t, k, [0]) for t in terms], "term string, key long, positions array<int>")
    alphabet = [chr(c) for c in range(97, 123)]
    table.add(row(alphabet, 1), 1)
    for k in (2, 3):
        table.add(row(["a"], k), 1)
    before = {r["bucket"]: r["folder"] for r in table.version() if r["gen"] == 1}
    touched = table.compact(2)
    after = {r["bucket"]: r["folder"] for r in table.version()}
    assert len(touched) == 1 and len(after) == len(table.version())
    assert all(after[b] == before[b] for b in before if b not in touched) and all(after[b] != before[b] for b in touched)
    assert sorted(r.key for r in table.rows(["a"]).collect()) == [1, 2, 3]
    assert table.compact(2) == set()


def test_look_ups_open_the_buckets_of_their_terms(spark, tmp_path):
    index = P.PositionalIndex(spark, str(tmp_path / "i"), buckets=16)
    index.add(spark.createDataFrame(texts(50, 1), SCHEMA), "doc_id", "text", fresh=True)
    files = index.table.rows(["a"]).inputFiles()
    bucket = spark.createDataFrame([("a",)], "t string").select(index.table.bucket_of(F.col("t"))).first()[0]
    assert files and all(f"/bucket={bucket}/" in f for f in files)
    plan = index.table.rows(["a"])._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,a)" in plan or "In(term" in plan


def test_a_broken_batch_leaves_the_index_as_it_was(spark, tmp_path):
    index = P.PositionalIndex(spark, str(tmp_path / "i"), buckets=4)
    index.add(spark.createDataFrame([(1, "a b")], SCHEMA), "doc_id", "text")
    held = live(index.table)
    bad = spark.createDataFrame([(2, "c")], SCHEMA).withColumn("text", F.raise_error("lost").cast("string"))
    with pytest.raises(Exception):
        index.add(bad, "doc_id", "text")
    assert live(index.table) == held
    index.add(spark.createDataFrame([(2, "c")], SCHEMA), "doc_id", "text")
    assert len(live(index.table)) == len(held) + 2


def test_empty_tables_and_repeats(spark, tmp_path):
    index = P.PositionalIndex(spark, str(tmp_path / "i"), buckets=4)
    assert index.phrase(["a"]).count() == 0 and index.table.rows().count() == 0
    index.add(spark.createDataFrame([], SCHEMA), "doc_id", "text")
    index.remove(spark.createDataFrame([(1,)], "doc_id long"), "doc_id")
    assert index.table.compact() == set() and index.phrase(["a"]).count() == 0


def test_character_terms(spark):
    terms = lambda t: spark.createDataFrame([(t,)], "t string").select(P.character_terms(F.col("t"))).first()[0]
    assert terms("我ＡＢ１ has七brand#13。") == ["我", "ab1", "has", "七", "brand", "13"]
    assert terms("") == []


def test_spans_of_words(spark):
    rows = [("  The of; ther!", 1, 2), ("of the", 0, 2)]
    df = spark.createDataFrame(rows, "t string, s int, n int").select("t", P.span(F.col("t"), F.col("s"), F.col("n")).alias("x"))
    assert [r.t[r.x["from"] : r.x["to"]] for r in df.collect()] == ["of; ther", "of the"]


def test_postings_are_packed_outside_the_row(spark, tmp_path):
    """Postings of odd texts against a plain version; they are packed a block of texts at a time, not by sorts inside each row."""
    from glossa.operators.positional import LENGTH, PositionalIndex

    texts = {"a": "b aa b cc aa", "b": "", "c": None, "d": "x", "e": "zz " * 300, "f": "éé aa"}
    index = PositionalIndex(spark, str(tmp_path / "packed"), buckets=7, least=2, key_type="string")
    docs = spark.createDataFrame(list(texts.items()), "key string, text string")
    assert "sort_array" not in index._packed(docs, "key", "text")._jdf.queryExecution().optimizedPlan().toString()
    index.add(docs, "key", "text", fresh=True)
    want = set()
    for k, t in texts.items():
        w = (t or "").split()
        want |= {(x, k, tuple(i for i, y in enumerate(w) if y == x)) for x in w if len(x) >= 2} | {(LENGTH, k, (len(w),))}
    assert {(r["term"], r["key"], tuple(r["positions"])) for r in index.table.rows().collect()} == want
    assert {r["key"] for r in index.phrase(["aa", "b"]).collect()} == {"a"}
