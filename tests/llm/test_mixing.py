from collections import Counter

import pytest

from glossa.llm.mixing import groups_of, mix, pfair_period

WEIGHTS = {"a": 5, "b": 3, "c": 1}


def test_period_deviates_by_less_than_a_block():
    for weights in ([5, 3, 1], [1], [7, 7, 2, 1], [1] * 9, [50, 1, 1]):
        total, had = sum(weights), Counter()
        for t, (s, k) in enumerate(pfair_period(weights), 1):
            assert k == had[s]
            had[s] += 1
            assert all(abs(had[i] * total - w * t) < total for i, w in enumerate(weights))
    with pytest.raises(ValueError):
        pfair_period([1, 0])


def test_mix_equals_a_simulation(spark):
    rows = [(i, "abc"[min(i % 7, 2)] if i % 11 else None, f"t{i}") for i in range(400)] + [(1, "b", "t1")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, __other string")
    out = mix(docs, WEIGHTS, block=4).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((a, b) for a, b, _ in rows)
    assert sorted(r["position"] for r in out) == list(range(len(rows)))
    by = sorted(out, key=lambda r: r["position"])
    assert [r["slot"] for r in by] == sorted(r["slot"] for r in by)
    total = sum(WEIGHTS.values()) + 1
    slots = sorted({(r["slot"], r["source"]) for r in out if r["exact"]}, key=lambda x: x[0])
    assert [s for s, _ in slots] == list(range(len(slots))) and len(slots) > 5
    had = Counter()
    for t, (_, s) in enumerate(slots, 1):
        had[s] += 1
        assert all(abs(had[k] * total - WEIGHTS.get(k, 1) * t) < total for k in ("a", "b", "c", None))
    assert all(r["release_slot"] <= r["slot"] < r["deadline_slot"] for r in out)


def test_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, source string")
    assert mix(empty, WEIGHTS).count() == 0
    with pytest.raises(ValueError):
        mix(spark.createDataFrame([(1, "a")], "doc_id long, source string"), {"a": 0})


def test_names_that_clash(spark):
    names = ["position", "weight", "block", "slot", "exact", "bucket", "rank", "own", "at", "had", "turn", "blk", "g", "k", "n", "b", "w", "a.b", "__bucket", "__rank"]
    docs = spark.createDataFrame([(i, "ab"[i % 2], *[7] * len(names)) for i in range(200)], ["doc_id", "source", *names])
    out = mix(docs, {"a": 2}, block=8)
    assert out.columns[: len(docs.columns)] == docs.columns and "_position" in out.columns
    assert sorted(r["_position"] for r in out.collect()) == list(range(200)) and {r["position"] for r in out.collect()} == {7}


def test_many_sources_of_one_weight(spark):
    groups, places = groups_of([1] * 10_001)
    assert groups == [1] and places[7] == (0, 7, 10_001)
    rows = [(i, f"s{i % 37}", "x" * (100_000 if i == 3 else 1)) for i in range(37 * 6)] + [(None, "s0", None)]
    out = mix(spark.createDataFrame(rows, "doc_id long, source string, text string"), {"s0": 3, "s1": 3}, block=2).collect()
    assert sorted(r["position"] for r in out) == list(range(len(rows)))
    assert all(r["release_slot"] <= r["slot"] < r["deadline_slot"] for r in out)
    by = {}
    for r in sorted(out, key=lambda r: r["position"]):
        by.setdefault(r["slot"], set()).add(r["source"])
    assert all(len(x) == 1 for x in by.values())
