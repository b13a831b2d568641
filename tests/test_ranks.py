"""Places in an order, as-of look-ups and substring joins, against plain Python; plans without one task for all rows."""

import bisect
import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import lexicon as L
from glossa.operators import ranges as R
from glossa.operators import ranks as K
from glossa.plans import registry

DIR = "/root/testdata/sf0.001"


def test_ranks_equal_a_sort(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, 1, 2, 2, 2, 3]), rng.choice("xyz")) for i in range(500)]
    df = spark.createDataFrame(rows, "i int, a int, b string").repartition(5)
    got = {r.i: r.rank for r in K.ranked_by(df, F.desc_nulls_last("a"), F.asc("b"), F.asc("i")).collect()}
    order = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[2], r[0]))
    assert got == {r[0]: k for k, r in enumerate(order, 1)}
    assert K.ranked_by(df.limit(0), F.asc("i")).count() == 0


def test_pages_are_cut_in_the_tasks(spark):
    df = spark.range(1000)
    assert [r.id for r in K.page(df, 990, 20, F.asc("id")).collect()] == list(range(990, 1000))
    assert "TakeOrderedAndProject" in K.page(df, 10, 5, F.desc("id"))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["hanzi_lookup", "pinyin_lookup", "target_lookup", "prefix_ranks", "range_lookup", "stem_file"])
def test_no_task_for_all_rows(spark, name):
    assert "SinglePartition" not in registry.queries()[name](spark, DIR)._jdf.queryExecution().executedPlan().toString()


def plain_lookup(values, ranges):
    ordered = sorted((r for r in ranges if r[0] is not None and r[1] is not None), key=lambda r: (r[0], r[1], r[2]))
    starts = [r[0] for r in ordered]
    out = []
    for k, v in values:
        at = -1 if v is None else bisect.bisect_right(starts, v) - 1
        out.append((k, v, ordered[at][2] if at >= 0 and ordered[at][1] >= v else "none"))
    return sorted(out, key=str)


def lookup(spark, values, ranges):
    v, r = spark.createDataFrame(values, "k long, v long"), spark.createDataFrame(ranges, "lo long, hi long, label string")
    return sorted(map(tuple, R.lookup(v, r, "v", "label", "none").collect()), key=str)


def test_as_of_ranges(spark):
    rng = random.Random(4)
    ranges = [(x, x + rng.randint(0, 30), f"r{i % 7}") for i, x in enumerate(rng.sample(range(0, 5000), 150))] + [(None, 3, "n"), (3, None, "n")]
    values = [(i, rng.randint(-50, 6000)) for i in range(400)] + [(1000 + i, 77) for i in range(300)] + [(2000, None)]
    assert lookup(spark, values, ranges) == plain_lookup(values, ranges)
    assert lookup(spark, values, []) == plain_lookup(values, []) and lookup(spark, [], ranges) == []


def test_one_range_of_everything_and_many_of_one(spark):
    many = spark.range(200_000).select((F.col("id") * 20_000).alias("lo"), (F.col("id") * 20_000).alias("hi"), F.lit("one").alias("label"))
    ranges = many.union(spark.createDataFrame([(-1, 2**32, "all")], "lo long, hi long, label string"))
    values = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 20_000 * 200 - 1 + F.col("id") % 2).alias("v"))
    # a range inside another hides it from its start on
    got = R.lookup(values, ranges, "v", "label", "none").groupBy("label").count().collect()
    want = {"one": sum((i * 4_000_000 - 1 + i % 2) % 20_000 == 0 for i in range(1000)), "all": 1}
    want["none"] = 1000 - want["one"] - want["all"]
    assert {r["label"]: r["count"] for r in got} == want


def test_substrings_both_ways(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abé", k=rng.randint(0, 7)))
    texts, patterns = [word() for _ in range(120)] + [None], [word() for _ in range(120)] + [None, "zzzz"]
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    want = sorted({(t, p) for t in texts if t for p in patterns if p and p in t})
    for size in (2, 3, 5):
        assert sorted(map(tuple, L.contained(df(texts, "t"), df(patterns, "p"), "t", "p", size).collect())) == want


def test_rows_before_verification_grow_with_the_text(spark):
    n = lambda k: spark.createDataFrame([("ab" * k,)], "t string").select(F.explode(L.grams(F.col("t"), 3))).count()
    assert n(5000) == 2  # distinct runs
    text = "".join(chr(0x4E00 + i) for i in range(3000))
    assert spark.createDataFrame([(text,)], "t string").select(F.explode(L.grams(F.col("t"), 3))).count() == 2998


def plain_scope(seeds, heads):
    """Seeds in order; each lists itself, then heads inside it, then heads around it, none that was listed before."""
    seen, out = set(), []
    for number, seed in sorted(seeds):
        seen.add(seed)
        out.append((number, 0, seed))
        for kind, holds in ((1, lambda h: h in seed), (2, lambda h: seed in h)):
            for h in heads:
                if h != seed and h not in seen and holds(h):
                    seen.add(h)
                    out.append((number, kind, h))
    return sorted(out)


def test_scope_in_the_order_of_seeds(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("ab", k=rng.randint(1, 6)))
    seeds, heads = list(dict.fromkeys(word() for _ in range(30))), list(dict.fromkeys(word() for _ in range(60)))
    numbered = list(enumerate(seeds, 1))
    s, h = spark.createDataFrame(numbered, "number long, seed string"), spark.createDataFrame([(x,) for x in heads], "head string")
    scoped = L.scope(s, h)
    assert sorted(map(tuple, scoped.collect())) == plain_scope(numbered, heads)
    counts = L.scope_counts(scoped, s, h).first()
    want = plain_scope(numbered, heads)
    assert (counts.seeds, counts.parts, counts.longer, counts.heads) == (len(seeds), sum(k == 1 for _, k, _ in want), sum(k == 2 for _, k, _ in want), len({x for *_, x in want}))
    assert counts.parts_elsewhere == sum(x != y and y in x for x in seeds for y in heads)
