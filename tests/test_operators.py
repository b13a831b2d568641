"""Operators that SQL can't express, against plain versions, and edge cases."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glossa.functions import pinyin, text
from glossa.operators import index, pairs, tokens, vectors
from glossa.sources import entries, files


def test_segments():
    heads = index.lengths_of({"ab", "abc", "c", "苹果", "苹"})
    assert index._match("abcab xy1苹果果, c", heads) == ["abc", "ab", "xy1", "苹果", "@果", "c"]
    assert index._match(None, heads) == []


def test_segments_of_a_table(spark):
    df = spark.createDataFrame([(1, "the thing"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["segments"] for r in index.segments(df, spark.createDataFrame([("the",), ("ing",)], "head string"), "doc_id", "text").collect()}
    assert got == {1: ["the", "th", "ing"], 2: []}


def test_merge_pass(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c", "a", "b"]), (2, ["x"]), (3, [])], "doc_id long, tokens array<string>")
    merges = spark.createDataFrame([("a", "b", 2.0), ("b", "c", 3.0)], "a string, b string, mi double")
    got = {r["doc_id"]: r["tokens"] for r in tokens.merge_pass(df, merges, "doc_id").collect()}
    assert got == {1: ["a", "bc", "ab"], 2: ["x"], 3: []}


def test_ranked_and_sampled(spark):
    ids = random.Random(1).sample(range(100_000), 500)
    df = spark.createDataFrame([(i,) for i in ids], "k long")
    got = {r["k"]: r["rank"] for r in tokens.ranked(df, "k", span=1000).collect()}
    assert got == {k: n for n, k in enumerate(sorted(ids), 1)}
    assert sorted(r["rank"] for r in tokens.sampled(df, "k", 50, 3).collect()) == [50, 100, 150]


def test_zip_join_reports_a_mismatch(spark):
    a = spark.createDataFrame([(0, "x"), (1, "y")], "line long, text string")
    assert pairs.zipped(a, a).count() == 2
    with pytest.raises(Exception, match="line counts differ"):
        pairs.zipped(a, a.where("line = 0")).collect()


def test_vector_matches_equal_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.normal(size=(90, 8))
    df = spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], "id long, v array<float>").repartition(5)
    u = v.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    for block in (8192, 4):
        monkeypatch.setattr(vectors, "BLOCK", block)
        got = {(r["query_id"], r["rank"]): r["id"] for r in vectors.matches(df.where("id < 10"), df, k=3).collect()}
        for q in range(10):
            order = sorted((j for j in range(90) if j != q), key=lambda j: (-s[q, j], j))[:3]
            assert [got[q, k] for k in (1, 2, 3)] == order
    assert vectors.matches(df.limit(0), df, k=3).count() == 0


def test_vector_search_holds_a_bounded_number_of_similarities():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(4)
    v = rng.normal(size=(10_000, 8))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(10_000)), pa.array(list(v))], ["id", "v"])
    ids, units = np.arange(4000), v[:4000] / np.linalg.norm(v[:4000], axis=1, keepdims=True)
    tracemalloc.start()
    found = sum(b.num_rows for b in vectors._search(ids, units, [batch], 3, None))
    assert tracemalloc.get_traced_memory()[1] < 100 << 20  # all at once are 320 MB
    tracemalloc.stop()
    assert 3 * 4000 <= found <= 2 * 3 * 4000


def test_equal_vectors_tie_wherever_they_stand(spark):
    v = [[float(x) for x in row] for row in ([0.1, 0.7, 0.3, 0.9, 0.2], [0.3, 0.3, 0.8, 0.1, 0.6], [0.5, 0.2, 0.4, 0.4, 0.9])]
    df = spark.createDataFrame([(i, v[i % 3]) for i in range(301)], "id long, v array<float>").repartition(3)
    got = {}
    for r in vectors.matches(df.where("id < 30"), df, k=5).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["id"]
    for q in range(30):
        assert [got[q][k] for k in range(1, 6)] == [i for i in range(301) if i % 3 == q % 3 and i != q][:5]


def test_entry_lines(spark):
    lines = ["# comment", "", "蘋果 苹果 [ping2 guo3] /(növ.) alma (gyümölcs (ehető))/SZ:個|个[ge4]/", "女 女 [nu:3] /nő/", "A咖 A咖 [A ka1] /menő/", "苹果 苹 [ping2 guo3] /x/", "苹果 苹果 [ping2] /x/", "bad line", "苹果 苹果 [ping2 guo3] /x", "𠀀 𠀀 [he1] /x/", "你 你 [ni5] /(csak (mély))/"]
    out = entries.parse_lines(spark.createDataFrame(list(enumerate(lines)), "n int, text string")).collect()
    got = {r["n"]: r for r in out}
    assert set(got) == set(range(2, 11))
    e = got[2]["entry"]
    assert (e["trad"], e["simp"], e["hz2py"]) == ("蘋果", "苹果", [0, 1])
    assert [tuple(s) for s in e["pinyin"]] == [("ping", 2), ("guo", 3)]
    assert tuple(e["senses"][0]) == ("(növ.) ", "alma", " (gyümölcs (ehető))")
    assert got[3]["entry"]["pinyin"][0]["text"] == "nv" and got[4]["entry"]["hz2py"] == [-1, 1]
    assert tuple(got[10]["entry"]["senses"][0]) == ("(csak (mély))", "", "") and got[10]["entry"]["pinyin"][0]["tone"] == 0
    assert all(got[i]["error"] and got[i]["entry"] is None for i in range(5, 10))


def test_blocks(spark, tmp_path):
    body = "# ID-a00aa0b\n# Ver 2017-05-02T22:41:05Z anna Stat-New 001>first import\n# 蘋果 苹果 [ping2 guo3] /alma/\n# Ver 2017-06-01T10:00:00Z bela Stat-Verif >checked\\nand \\\\n\n蘋果 苹果 [ping2 guo3] /új/\n\n# ID-b00aa0c\n# Ver 2018-01-01T00:00:00Z c Stat-Flagged 000>x\n女 女 [nu:3] /nő/\n"
    (tmp_path / "b.txt").write_text("prologue\n\n" + body, encoding="utf-8")
    got = sorted(entries.versions(entries.read_blocks(spark, str(tmp_path / "b.txt"))).collect(), key=lambda r: (r["code"], r["version"]))
    assert [(r["code"], r["version"], r["user"], r["status"], r["bulk_ref"]) for r in got] == [("a00aa0b", 0, "anna", 0, 1), ("a00aa0b", 1, "bela", 1, -1), ("b00aa0c", 0, "c", 2, -1)]
    assert got[0]["line"].endswith("/alma/") and got[1]["line"].endswith("/új/") and got[1]["comment"] == "checked\nand \\n"


def test_pinyin(spark):
    syllabary = [("a", True), ("ping", False), ("guo", False), ("xian", False), ("xi", False), ("an", True), ("nv", False), ("na", False)]
    assert pinyin.parse_query("ping2guo3", syllabary) == [("ping", 2), ("guo", 3)]
    assert pinyin.parse_query("xian", syllabary) == [("xian", -1)]
    assert pinyin.parse_query("xi'an nü3 nar5 zzz", syllabary) == [("xi", -1), ("an", -1), ("nv", 3), ("na", 0), ("r", 0), ("zzz", -1)]
    assert pinyin.parse_query("", syllabary) == []
    rows = [("hao", 3), ("gou", 3), ("nv", 3), ("liu", 2), ("ma", 0), ("gui", 4)]
    shown = [r[0] for r in spark.createDataFrame(rows, "t string, n int").select(pinyin.display(F.col("t"), F.col("n"))).collect()]
    assert shown == ["hǎo", "gǒu", "nǚ", "liú", "ma", "guì"]
    df = spark.createDataFrame([([("Ping", 2), ("guo", 3), ("shu", 4)],), ([("guo", 1)],)], "p array<struct<text:string,tone:int>>")
    assert [r[0] for r in df.select(pinyin.contiguous(F.col("p"), [("guo", -1)])).collect()] == [1, 0]
    assert [r[0] for r in df.select(pinyin.contiguous(F.col("p"), [("ping", -1), ("guo", 3)])).collect()] == [0, None]


def test_text_functions(spark):
    df = spark.createDataFrame([("Straße|x",), ("12:30",), ("苹果",), (None,)], "s string")
    assert [r[0] for r in df.select(text.normal_token(F.col("s"))).collect()] == ["strassex", "NNN", "ZHO", None]
    p = spark.createDataFrame([("abcd", "a" * 10), ("abcd", "a" * 40), ("ab.,", "a" * 12), ("x" * 41, "a" * 100), ("", "a")], "a string, b string")
    assert [r[0] for r in p.select(text.good_pair(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, False]
    m = spark.createDataFrame([("A B c 1 2 . 5 szó",)], "s string")
    assert m.select(text.merged_alnum(F.col("s"))).first()[0] == "ABc 12.5 szó"


def test_files(spark, tmp_path):
    (tmp_path / "l.txt").write_text("a\n@TOSIMP@\nb\n@TOSIMP@\n", encoding="utf-8")
    (tmp_path / "m.txt").write_text("x\ny\n", encoding="utf-8")
    a, b = files.numbered_lines(spark, str(tmp_path / "l.txt")), files.numbered_lines(spark, str(tmp_path / "m.txt"))
    assert [r["text"] for r in files.merged_lines(a, b).orderBy("line").collect()] == ["a", "x", "b", "y"]
    (tmp_path / "f.tsv").write_text("alma\t5\nbad\nx\ty\tz\nnem\tnum\n", encoding="utf-8")
    assert [tuple(r) for r in files.word_frequencies(spark, str(tmp_path / "f.tsv")).collect()] == [("alma", 5)]
    (tmp_path / "v.txt").write_text("2 3\nzh_苹 1 2 3\nhu_alma 0.5 1 2 \n", encoding="utf-8")
    got = {r["word"]: (list(r["vec"]), r["chinese"]) for r in files.word_vectors(spark, str(tmp_path / "v.txt")).collect()}
    assert got == {"苹": ([1.0, 2.0, 3.0], True), "alma": ([0.5, 1.0, 2.0], False)}
    (tmp_path / "u.txt").write_text("U+82F9\tkMandarin\tpíng\nU+20000\tkMandarin\thē\n# x\n", encoding="utf-8")
    assert [(r["hanzi"], r["kMandarin"]) for r in files.readings(spark, str(tmp_path / "u.txt")).collect()] == [("苹", ["píng"])]
    (tmp_path / "ip.csv").write_text('# c\n"16777216","16777471","apnic","1","AU","AUS"\n', encoding="utf-8")
    assert [tuple(r) for r in files.address_ranges(spark, str(tmp_path / "ip.csv")).collect()] == [(16777216, 16777471, "AUS")]
    (tmp_path / "en.json").write_text('{"g": {"a": "A", "b": "B"}}', encoding="utf-8")
    (tmp_path / "hu.json").write_text('{"g": {"a": "Á"}}', encoding="utf-8")
    strings = files.catalog(spark, str(tmp_path / "en.json"), "en").union(files.catalog(spark, str(tmp_path / "hu.json"), "hu"))
    keys = spark.createDataFrame([("g.a",), ("g.b",), ("g.c",)], "key string")
    assert {r["key"]: r["value"] for r in files.translated(keys, strings, "hu").collect()} == {"g.a": "Á", "g.b": "B", "g.c": "g.c"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.html").write_text("<!-- lang: en --><!-- rel: about --><p>Hi</p>", encoding="utf-8")
    found = files.pages(spark, str(tmp_path / "p"))
    assert files.page_for(found, "hu", "about").first()["body"] == "<p>Hi</p>"
    files.write_lines(a, str(tmp_path / "out"), "line", "text")
    assert sorted(r[0] for r in spark.read.text(str(tmp_path / "out")).collect())[0] == "0\ta"


def test_streaming(spark, tmp_path):
    from glossa.streaming import querylog as q

    (tmp_path / "in").mkdir()
    rec = '{{"time": "2024-01-01T00:0{m}:00Z", "country": "HU", "device": "d", "lang": "hu", "script": "b", "mode": "ZHO", "total_ms": 1234, "lookup_ms": 5, "n_results": {n}, "query": "q{m}"}}'
    (tmp_path / "in" / "1.json").write_text("\n".join(rec.format(m=m, n=m % 2) for m in (1, 2, 1)), encoding="utf-8")
    q.append_log(q.read_log(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    lines = sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).select("value").collect())
    assert len(lines) == 3 and lines[0] == "2024-01-01!00:01:00\tHU-DHB\tZHO\t1.234\t0.005\t1\tq1"
    for name, df in (("w", q.per_window(q.read_log(spark, str(tmp_path / "in")))), ("s", q.user_sessions(q.read_log(spark, str(tmp_path / "in")))), ("d", q.distinct_queries(q.read_log(spark, str(tmp_path / "in"))))):
        mode = "append" if name == "d" else "complete"
        stream = df.writeStream.format("memory").queryName(f"t_{name}").outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / f"ck_{name}")).start()
        stream.awaitTermination(120)
    assert spark.table("t_w").first()["n"] == 3 and spark.table("t_s").first()["n"] == 3 and spark.table("t_d").count() == 2


def test_neighbours_are_counted_whole(spark, monkeypatch):
    from collections import Counter

    from glossa.operators import neighbours

    rng = random.Random(5)
    words = ["a", "b", "c\x01d", "\x02", "\x03b", ",x", "1", "", "é"]
    texts = [[rng.choice(words) for _ in range(rng.randrange(12))] for _ in range(300)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, w array<string>").repartition(3)
    ok = lambda w: w not in (",x", "1", "")
    pairs = Counter(p for t in texts if t for p in zip(t, t[1:]) if all(map(ok, p)))
    single = Counter(w for t in texts if t for w in t if ok(w))
    for block, size in ((neighbours.BLOCK, neighbours.MERGE_BYTES), (40, 1)):
        monkeypatch.setattr(neighbours, "BLOCK", block)
        monkeypatch.setattr(neighbours, "MERGE_BYTES", size)
        p, w, sums = tokens.counted(df, "w", 20)
        assert {(r["a"], r["b"]): r["n"] for r in p.collect()} == {k: n for k, n in pairs.items() if n >= 20}
        assert {r["word"]: r["freq"] for r in w.collect()} == {k: n for k, n in single.items() if n >= 20}
        assert tuple(sums.first()) == (sum(pairs.values()), sum(single.values()))


def test_neighbours_are_dealt_as_packed_buckets(spark):
    # one row a bucket is shuffled, not one a pair, and texts go to their merges as one text each
    from glossa.operators import neighbours

    df = spark.createDataFrame([(i, [f"w{j}" for j in range(i, i + 40)]) for i in range(200)], "k long, w array<string>")
    plan = tokens.merge_pass(df, spark.createDataFrame([("w1", "w2", 1.0)], "a string, b string, mi double"), "k", "w")
    assert plan.where("array_contains(w, 'w1w2')").count() == 2
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "posexplode" not in text
    packed = df.select("w").coalesce(1).mapInArrow(neighbours._count, "bucket int, packed binary, size int, counts array<int>")
    assert packed.select("bucket").distinct().count() == packed.count() < sum(len(r["counts"]) for r in packed.select("counts").collect())


def test_merge_pass_keeps_odd_tokens(spark):
    rows = [(1, ["a", "b", "x\x02y", "a", "b"]), (2, ["", ""]), (3, [""]), (4, []), (5, ["a", None, "b"]), (6, None)]
    df = spark.createDataFrame(rows, "doc_id long, tokens array<string>")
    merges = spark.createDataFrame([("a", "b", 2.0)], "a string, b string, mi double")
    got = {r["doc_id"]: r["tokens"] for r in tokens.merge_pass(df, merges, "doc_id").collect()}
    assert got == {1: ["ab", "x\x02y", "ab"], 2: ["", ""], 3: [""], 4: [], 5: ["a", None, "b"], 6: None}


def test_pieces_match_as_whole_texts(monkeypatch):
    rng = random.Random(9)
    for heads in ({"ab", "abc", "c", "苹果", "苹"}, {"a b", "b-]", "^", "é1", " c"}, set()):
        by = index.lengths_of(heads)
        for keep in (3, 200_000):
            monkeypatch.setattr(index, "KEPT_PIECES", keep)
            pieces = index._Pieces(by)
            for _ in range(300):
                text = "".join(rng.choice("abc1 \n\t,-]^é苹果ű\x00 ") for _ in range(rng.randrange(30)))
                assert pieces.of(text) == index._match(text, by), text
            assert pieces.of(None) == [] and len(pieces) <= keep


def test_covers_are_not_grouped_in_map_tasks(spark):
    texts = spark.createDataFrame([(1, "abcabcd"), (2, "xx"), (3, ""), (4, None)], "k long, t string")
    got = index.longest_covers(texts, spark.createDataFrame([("ab",), ("abc",), ("bcd",), ("c",), ("ab",)], "head string"), "k", "t", 3)
    assert sorted(tuple(r) for r in got.collect()) == [(1, 0, 3, "abc"), (1, 3, 3, "abc"), (1, 4, 3, "bcd")]
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_scores_stay_compiled(spark):
    """The JVM compiles no method of over 8,000 bytes; scores of such a method took eight times as long."""
    counts = spark.createDataFrame([("a", "b", 4, 5, 6), ("a", "c", 5, 5, 5)], "src string, trg string, n long, src_freq long, trg_freq long")
    each = spark.createDataFrame([(1,)] * 50, "x int")
    got = pairs.scored(each, counts, 0.0, 0.0)
    rows = {r["trg"]: (r["ll"], r["mi"]) for r in got.collect()}
    assert rows["b"][0] is not None and rows["c"] == (None, 2.3026)  # a cell of 0 has no logarithm
    parts = got._jdf.queryExecution().debug().codegenToSeq()
    sizes = [parts.apply(i)._3().maxMethodCodeSize() for i in range(parts.size())]
    assert sizes and max(sizes) < 8000


def test_collocations_are_counted_once(spark):
    """The sort of scores reads a table, not the join and the counts, which it would run twice."""
    from glossa.plans.registry import queries

    plan = queries()["colloc_ll_mi"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Sort" in plan and "Join" not in plan and "HashAggregate" not in plan


def test_pairs_are_dealt_by_the_number_of_words(spark, monkeypatch):
    rows = spark.createDataFrame([(f"a b c{i}", "x y") for i in range(40)], "src string, trg string")
    want = sorted(map(tuple, pairs.counted(rows, 5, 3).collect()))
    monkeypatch.setattr(pairs, "TASK_WORDS", 20, raising=True)
    got = pairs.counted(rows, 5, 3)
    assert "RepartitionByExpression [row" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want == [(a, b, 40, 40, 40) for a in "abc" for b in "xy"]
