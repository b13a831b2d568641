"""Sources, edits, vectors and exports that no table query covers, against plain versions."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from glossa.functions import corpus, ids, target
from glossa.operators import aligned, edits, lookup, tokens, vectors, wordlists
from glossa.plans import registry
from glossa.sources import entries, files


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def plain_tokens(text):
    """A scan of characters, kept apart from the pattern that the expression uses."""
    out, word, start, sub = [], "", 0, 0
    han = lambda c: "㐀" <= c <= "鿿" or "豈" <= c <= "﫿"
    for i, c in enumerate(text + " "):
        cut = c.isspace() or c in target.SEPARATORS
        if word and (cut or han(c) != han(word[-1])):
            out.append((word, start, 0 if han(word[0]) else sub))
            sub = 0 if c == ";" else sub + 1
            word = ""
        if not cut:
            start = i if not word else start
            word += c
    return out


def test_tokens_equal_a_plain_scan(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["ab", "ß", "x|y", "苹", "果果", " ", ";", ", ", "-", "12", "3rd", "(", "é"]) for _ in range(rng.randrange(12))) for _ in range(300)] + ["", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", target.tokens(F.col("t")).alias("k")).collect()
    for r in rows:
        assert [(k["surf"], k["start"], k["sub"]) for k in r["k"]] == plain_tokens(texts[r["i"]] or ""), texts[r["i"]]
    one = {k["surf"]: k for r in rows for k in r["k"]}
    assert one["12"]["norm"] == "NNN" and one["苹"]["norm"] == "ZHO"
    assert all(k["first"] + k["second"] == k["norm"] for k in one.values() if k["cut"] is not None)


def test_phrases_with_compounds_and_stop_words(spark):
    senses = ["home|town", "a town hall", "hall; town", "the town"]
    df = spark.createDataFrame([(i, [s], 1) for i, s in enumerate(senses)], "entry_id int, senses array<string>, freq int")
    def found(q, stops):
        posts = lookup.word_postings(df, stops)
        return {r["entry_id"]: (r["start"], r["end"]) for r in lookup.target_lookup(df, posts, q, stops).collect()}

    assert found("town", ["town"]) == {2: (6, 10)} and found("town hall", ["town"]) == {}
    assert found("town", ["the"]) == {0: (4, 9), 1: (2, 6), 2: (6, 10), 3: (4, 8)}
    assert found("home", []) == {0: (0, 4)} and found("town hall", []) == {1: (2, 11)} and found("7", []) == {}


def test_token_maps(spark):
    df = spark.createDataFrame([("az alma. piros", "az alma￭ . piros", "1/az#az 2/al#alma 2/ma#alma 1/piros#piros"), ("x", "y", "")], "s string, b string, t string")
    a, b = df.select(corpus.bpe_map(F.col("s"), F.col("b")).alias("b"), corpus.stem_map(F.col("s"), F.col("t")).alias("t")).collect()
    assert [tuple(x) for x in a["b"]] == [("az", 0, 2), ("alma", 3, 4), ("piros", 9, 5)] and b["b"] is None
    assert [tuple(x) for x in a["t"]] == [("az", 0, 2), ("al", 3, 2), ("ma", 5, 2), ("piros", 9, 5)] and b["t"] is None


def test_sources(spark, tmp_path):
    lines = files.numbered_lines(spark, write(tmp_path, "v.txt", "alma\talma[N]\nalma\tal[N]\n\nxyz\txyz?\n\nvas\tvas[N]\n"))
    groups = {r["surf"]: r["analyses"] for r in files.analysis_groups(lines).collect()}
    assert groups == {"alma": ["alma[N]", "al[N]"], "xyz": ["xyz?"], "vas": ["vas[N]"]}
    assert {r["word"]: r["is_word"] for r in files.vocabulary(files.analysis_groups(lines)).collect()} == {"alma": True, "xyz": False, "vas": True}
    moe = files.numbered_lines(spark, write(tmp_path, "m.txt", "id\thead\n1\ta{[4E00]}b{[4E01]}\n"))
    assert [r["text"] for r in files.escaped_heads(moe).collect()] == ["a一b丁"]
    s, t = (files.numbered_lines(spark, write(tmp_path, n, x)) for n, x in (("s.txt", "一\n二\n"), ("t.txt", "壹\n")))
    assert [r["text"] for r in files.zipped_heads(s, t).collect()] == ["壹 一 [pin yin] /sense/"]
    path = write(tmp_path, "u.txt", "U+4E00\tkTraditionalVariant\tU+4E01 U+4E03\nU+4E09\tkSimplifiedVariant\tU+4E00\nU+4E00\tkOther\tU+4E01\n")
    known = spark.createDataFrame([("一",)], "hanzi string")
    assert sorted((r["hanzi"], r["variant"]) for r in files.variants(spark, path, known).collect()) == [("一", "丁"), ("一", "七")]
    path = write(tmp_path, "r.csv", "a,1\nb,2\na,3\n")
    assert {r["word"]: r["rank"] for r in files.rank_list(spark, path).collect()} == {"a": 0, "b": 1}
    heads = files.numbered_lines(spark, write(tmp_path, "d.u8", "# c\nT1 s [x] /a/\nT2 s [y] /b/\n"))
    assert [(r["simp"], r["entries"]) for r in files.heads_of(heads).collect()] == [("s", "T1 s [x] /a/ @@ T2 s [y] /b/")]
    path = write(tmp_path, "sess.tsv", "tok\t7\t636292185610000000\tanna\t12\t1\nbad\n")
    assert [(r["user_id"], str(r["expires"])) for r in files.sessions(spark, path).collect()] == [(7, "2017-05-01 06:56:01")]
    path = write(tmp_path, "q.txt", "# Script SelX\n# @id INT\nSELECT *\nFROM t WHERE id=@id\n# End\n# Script Two\nSELECT 1\n# End\n")
    got = {r["name"]: (r["sql"], [(p["name"], p["kind"]) for p in r["params"]]) for r in files.statements(spark, path).collect()}
    assert got == {"SelX": ("SELECT * FROM t WHERE id=:id", [("id", "INT")]), "Two": ("SELECT 1", [])}
    vec = spark.createDataFrame([("a", [1.0]), ("z", [2.0])], "word string, vec array<float>")
    assert files.kept_vectors(vec, spark.createDataFrame([("a",), ("a",)], "word string")).count() == 1


def test_merged_lines_keep_their_order(spark):
    first = spark.createDataFrame([(i, "@TOSIMP@" if i % 3 == 0 else f"l{i}") for i in range(20)], "line long, text string")
    second = spark.createDataFrame([(i, f"new{i}") for i in range(7)], "line long, text string")
    got = {r["line"]: r["text"] for r in files.merged_lines(first, second).collect()}
    assert got == {i: f"new{i // 3}" if i % 3 == 0 else f"l{i}" for i in range(20)}


def test_running_sums_at_every_depth(spark):
    rng = random.Random(2)
    keys = rng.sample(range(100_000), 300)
    df = spark.createDataFrame([(k, k % 7) for k in keys], "k long, v long")
    for span, depth in ((10, 3), (1000, 1), (5, 0)):
        got = {r["k"]: r["before"] for r in tokens.running(df, "k", F.col("v"), span=span, depth=depth).collect()}
        assert got == {k: sum(x % 7 for x in keys if x < k) for k in keys}
    named = spark.createDataFrame([(w,) for w in ["b", "ab", "aa", "abc", "c"]], "w string")
    assert {r["w"]: r["number"] for r in tokens.numbered(named, "w").collect()} == {"aa": 1, "ab": 2, "abc": 3, "b": 4, "c": 5}


def test_greedy_dimensions_equal_a_plain_run(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    rows = [([float(x) for x in rng.normal(size=5)], [float(x) for x in rng.normal(size=5)], bool(i % 2)) for i in range(40)]
    got = vectors.reduce_dimensions(spark.createDataFrame(rows, "a array<double>, b array<double>, good boolean"), 5, 4)

    def gap(dims):
        sims = {True: [], False: []}
        for a, b, good in rows:
            x, y = np.array(a)[dims], np.array(b)[dims]
            sims[good].append(x @ y / np.linalg.norm(x) / np.linalg.norm(y))
        return np.mean(sims[True]) - np.mean(sims[False])

    dropped = []
    for n in range(1, 5):
        if n % 3 == 0:
            dropped.pop(0)
        left = [i for i in range(5) if i not in dropped]
        dropped.append(max(left, key=lambda i: gap([x for x in left if x != i])))
    assert got == dropped


def test_dropped_dimensions_come_of_all_rows(spark, tmp_path):
    import numpy as np

    from glossa.plans import registry

    rng = np.random.default_rng(8)
    v = rng.normal(size=(38, 6)).astype(np.float32)
    ids = [i for i in range(1, 41) if i % 20]  # none that a search would take for a query
    df = spark.createDataFrame([(i, [float(x) for x in r], 0) for i, r in zip(ids, v, strict=True)], "vec_id long, embedding array<float>, label int")
    df.repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = [r["dimension"] for r in registry.queries()["dropped_dimensions"](spark, str(tmp_path)).orderBy("place").collect()]

    u = v.astype(float)
    near = u @ u.T / np.linalg.norm(u, axis=1)[:, None] / np.linalg.norm(u, axis=1)
    np.fill_diagonal(near, -2)
    at = {x: i for i, x in enumerate(ids)}
    other = [(at[r["a_id"]], at[r["b_id"]]) for r in vectors.negative_pairs(df.selectExpr("vec_id AS id", "embedding AS v")).collect()]
    assert len(other) == len(ids)

    def gap(dims):
        x = u[:, dims] / np.linalg.norm(u[:, dims], axis=1)[:, None]
        mean = lambda pairs: np.mean([x[a] @ x[b] for a, b in pairs])
        return mean([*enumerate(near.argmax(axis=1))]) - mean(other)

    dropped = []
    for n in range(1, 9):
        if n % 3 == 0 and dropped:
            dropped.pop(0)
        left = [i for i in range(6) if i not in dropped]
        if len(left) == 1:
            break
        best = max(left, key=lambda i: gap([x for x in left if x != i]))
        if gap([x for x in left if x != best]) <= gap(left):
            break
        dropped.append(best)
    assert got == dropped


def test_negative_pairs_and_trained_vectors(spark):
    df = spark.createDataFrame([(i * 3, [float(i)]) for i in range(50)], "id long, v array<double>")
    pairs = vectors.negative_pairs(df).collect()
    assert len(pairs) == 50 and all(r["a_id"] != r["b_id"] for r in pairs) and len({r["b_id"] for r in pairs}) > 20
    docs = spark.createDataFrame([(["a", "b", "c", "d"] * 5,)] * 20, "w array<string>")
    got = vectors.trained(docs, "w", size=8, window=3)
    assert {r["word"] for r in got.collect()} == set("abcd") and vectors.nearest_words(got, "a", 2).count() == 2


def test_stored_refuses_taken_ids(spark):
    e = spark.createDataFrame([(1, "h", "t", 0)], "entry_id long, head string, target string, status int")
    assert edits.stored(e, e.withColumn("entry_id", F.lit(2).cast("long"))).count() == 2
    with pytest.raises(Exception, match="taken: 1"):
        edits.stored(e, e).collect()


def test_prepared_and_cleansed_versions(spark):
    lines = spark.createDataFrame([("蘋果 苹果 [PING2 guo3] /alma/(u.E.) egy/",), ("# note",), ("bad",), ("X X [x1] /ok/",)], "text string")
    first = edits.prepared(lines, "2017-05-02T22:41:05Z", "anna", "first", lower_pinyin=True)
    got = {r["line"]: r["status"] for r in first.collect()}
    assert got == {"蘋果 苹果 [ping2 guo3] /alma/(u.E.) egy/": 0}
    after = edits.cleansed_versions(first, "2018-01-01T00:00:00Z", "robot", 2, "clean").orderBy("version").collect()
    assert [(r["version"], r["line"]) for r in after] == [(0, "蘋果 苹果 [ping2 guo3] /alma/(u.E.) egy/"), (1, "蘋果 苹果 [ping2 guo3] /alma/egy/")]
    assert entries.block_text(first).count() == 1


def test_corpus_tables(spark):
    span = [{"a": 0, "b": 1}]
    seg = spark.createDataFrame([(1, "甲", "Alma", span, span, [{"ix1": 0, "ix2": 0, "score": 0.5}], [], ["甲"], ["Alma"])], "segment_id long, src string, trg string, src_map array<struct<a:int,b:int>>, trg_map array<struct<a:int,b:int>>, align array<struct<ix1:int,ix2:int,score:double>>, back array<struct<ix1:int,ix2:int,score:double>>, src_tokens array<string>, stems array<string>")
    made = wordlists.corpus_files(seg)
    assert made["hulo"].first()["text"] == "alma" and made["hustem"].first()["text"] == "alma" and made["zh"].first()["id"] == 1
    assert tuple(wordlists.ten_columns(seg).first()) == (1, "甲", "Alma", "0/1", "0/1", "甲", "Alma", "0-0!0.5", "", 1)
    assert wordlists.exported(seg, 5, 6) is None and wordlists.exported(seg, 5, None) is seg


def test_lone_stop_words_stay_dark(spark):
    seg = spark.createDataFrame([(1, "甲乙", "az alma a", [{"a": 0, "b": 1}, {"a": 1, "b": 1}], [{"a": 0, "b": 2}, {"a": 3, "b": 4}, {"a": 8, "b": 1}], [{"ix1": 0, "ix2": 0, "score": 0.1}, {"ix1": 0, "ix2": 2, "score": 0.2}, {"ix1": 1, "ix2": 2, "score": 0.3}])], "segment_id long, src string, trg string, src_map array<struct<a:int,b:int>>, trg_map array<struct<a:int,b:int>>, align array<struct<ix1:int,ix2:int,score:double>>")
    assert aligned.lit_tokens(seg, "甲").count() == 0
    assert sorted((r["ix"], r["score"]) for r in aligned.lit_tokens(seg, "甲乙", prune=False).collect()) == [(0, 0.1), (2, 0.3)]


def test_codes_that_come_again_have_their_turn(spark):
    numbers = [0, 51, ids.CODES - 1, ids.CODES, ids.CODES + 7, 9_000_000 * 7919 + 1]
    n = F.col("n")
    df = spark.createDataFrame([(x,) for x in numbers], "n long").select("n", ids.code_of(n).alias("code"), ids.turn_of(n).alias("turn"))
    got = df.select("n", "code", ids.number_of(F.col("code"), F.col("turn")).alias("back"), ids.number_of(F.col("code")).alias("first")).collect()
    assert [r["back"] for r in got] == [r["n"] for r in got] and [r["first"] for r in got] == [r["n"] % ids.CODES for r in got]
    assert got[3]["code"] == got[0]["code"] == "a00aa0a"


def test_id_codec_of_large_keys_gives_its_sql(spark, tmp_path):
    keys = [1, 923_301, 923_302, 36_000_000]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    sql = registry.oracle_sql()["id_codec"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = registry.queries()["id_codec"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(duckdb.sql(sql).fetchall())


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_filters_on_a_phrase_do_not_make_its_tokens_again(spark):
    senses = spark.createDataFrame([("the cold; widget",), ("widget x",)], "s string").select(target.tokens(F.col("s")).alias("tokens"))
    hit = senses.withColumn("at", lookup.phrase_match(F.col("tokens"), ["widget"], ["widget"])).where("at IS NOT NULL")
    assert [tuple(r["at"]) for r in hit.collect()] == [(10, 16)]
    assert _plan(hit).count("regexp_extract_all") <= 2


def test_bpe_map_looks_for_a_token_once(spark):
    df = spark.createDataFrame([("One two, two", "One two￭, two"), ("a b", "a c"), ("", "")], "s string, t string")
    got = df.select(corpus.bpe_map(F.col("s"), F.col("t")).alias("m"))
    assert [r["m"] and [tuple(x) for x in r["m"]] for r in got.collect()] == [[("One", 0, 3), ("two", 4, 3), ("two", 9, 3)], None, None]
    one = df.select(corpus.bpe_map(F.replace("s", F.lit("x"), F.lit("y")), F.col("t")).alias("m"))
    assert _plan(one).count("locate(") == 1 and _plan(one).count("replace(s") == 1


def test_cascade_reads_postings_that_were_written(spark, monkeypatch):
    from glossa.plans import dictionary

    given, own = [], lookup.target_lookup
    monkeypatch.setattr(lookup, "target_lookup", lambda known, posts, *rest: given.append(_plan(posts)) or own(known, posts, *rest))
    dictionary.lookup_cascade(spark, "/root/testdata/sf0.001")
    assert len(given) == 4 and not any("regexp_extract_all" in p for p in given)
