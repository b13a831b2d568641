import random
from pathlib import Path

from glossa.llm import jaccard as j


def brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    ids = sorted(sets)
    low = {i: i for i in ids}

    def find(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                s = len(sets[a] & sets[b])
                if 100 * s >= percent * (len(sets[a]) + len(sets[b]) - s):
                    x, y = sorted((find(a), find(b)))
                    low[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def data(copies):
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6))) for _ in range(800)]
    rows = []
    base = [rng.choice(vocabulary) for _ in range(150)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for i in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    for i in range(copies, copies + 120):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if i % 2:
            w[3:3] = passage
        rows.append((i, " ".join(w)))
        if i % 4 == 0:
            rows.append((1000 + i, " ".join(w).upper()))
    return rows + [(3000, None), (3001, ""), (3002, "one"), (3003, "ONE two"), (3004, "one TWO"), (3005, "É x y z"), (3006, "é x y z")]


def test_components_equal_brute_force(spark):
    long = " ".join(f"w{i * i % 9973}x{i % 7}" for i in range(30_000))
    for copies, width, percent in ((120, 3, 90), (60, 5, 80)):
        rows = data(copies) + [(4000, long), (4001, long + " and a tail"), (4002, long[:9000])]
        docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, member string")
        out = j.jaccard_components(docs, width, percent).collect()
        assert len(out) == len(rows)
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute(rows, width, percent)


def test_repeated_and_null_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (2, "a b c d")], "doc_id long, text string")
    out = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_components(docs, 3, 90).collect()), key=str)
    assert out == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (None, 2, None)]
    assert {r["doc_id"] for r in j.keep_one(docs, 3, 90).collect()} == {1, None}


def test_repeats_in_a_large_group(spark):
    rng = random.Random(9)
    core, pool = [f"c{i}" for i in range(35)], [f"p{i}" for i in range(60)]
    rows = [(0, core + pool[:10])]
    for i in range(1, 41, 2):
        own = rng.sample(pool[10:], 15)
        rows += [(i, core + own[:10]), (i + 1, core + own[5:])]  # 40 of 50 words shared: exactly 0.8
    # the pool's words are common elsewhere, so the core's words are all that prefixes hold
    rows += [(100 + i, pool + [f"u{i}x{k}" for k in range(200)]) for i in range(120)]
    rows = [(i, " ".join(w)) for i, w in rows]
    docs = spark.createDataFrame(rows + [rows[0]] * 2 + rows[3:9], "doc_id long, text string")
    out = j.jaccard_components(docs, 1, 80).collect()
    want = brute(rows, 1, 80)
    assert len(out) == docs.count() and {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == want
    assert sorted(r["doc_id"] for r in j.keep_one(docs, 1, 80).collect()) == sorted(i for i, (_, c) in want.items() if i == c)


def test_repeated_ids_of_other_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (2, "e f g h"), (2, "e f g h"), (3, "E f g h"), (4, None), (4, "i j k")], "doc_id long, text string")
    out = [(r["doc_id"], r["n_shingles"], r["component_id"]) for r in j.jaccard_components(docs, 3, 90).collect()]
    assert sorted(out) == [(1, 2, 1), (2, 2, 1), (2, 2, 2), (2, 2, 2), (3, 2, 2), (4, 0, 4), (4, 1, 4)]
    assert sorted(map(str, map(tuple, j.keep_one(docs, 3, 90).collect()))) == sorted(map(str, [(1, "a b c d"), (2, "e f g h"), (4, None), (4, "i j k")]))


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert j.jaccard_components(docs).count() == 0 and j.keep_one(docs).count() == 0


def test_pairs_and_tokens_in_parts_give_the_same(spark, monkeypatch):
    # prefixes are fetched for a few pairs at a time, and no range of tokens is saved with all others
    base, names = [f"w{i}" for i in range(80)], []
    rows = [(i, " ".join([*base[: 5 * i], f"x{i}", *base[5 * i + 1 :]])) for i in range(12)] + [(20, "a b c d e f g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(j, "_most", lambda table: 4)
    monkeypatch.setattr(j, "MAPS", 2)
    monkeypatch.setattr(j.Scratch, "save", lambda self, df, name, save=j.Scratch.save: (names.append(name), save(self, df, name))[1])
    out = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in j.jaccard_components(docs, 5, 80).collect()}
    assert out == brute(rows, 5, 80)
    assert {*(f"tokens/{i}" for i in range(j.PARTS)), "one-mapped/1", "one-met/1"} <= {*names}


def test_scratch_tables_go_and_texts_that_stay_are_not_shuffled(spark):
    docs = spark.createDataFrame([(i, f"word{i} " * 3 + " ".join(f"w{i}x{k}" for k in range(30))) for i in range(40)] + [(40, None), (None, "a")], "doc_id long, text string")
    docs = docs.union(docs.where("doc_id < 3").withColumn("doc_id", docs["doc_id"] + 100))
    found = j.keep_one(docs)
    root = Path(found.inputFiles()[0].removeprefix("file:")).parent.parent if found.inputFiles() else None
    assert root is None or {p.name for p in root.iterdir() if p.is_dir() and any(p.rglob("*.parquet"))} == {"components"}
    assert sorted(r["doc_id"] for r in found.where("doc_id IS NOT NULL").collect()) == list(range(41)) and found.where("doc_id IS NULL").count() == 1
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LeftAnti") == 1 and "LeftSemi" not in plan  # the one join of texts reads what the map can't rule out
