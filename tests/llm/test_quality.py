from glossa.llm import quality as q


def words(n, tag):
    return " ".join(chr(97 + i % 26) * (1 + i // 26) + tag.translate(str.maketrans("0123456789", "abcdefghij")) for i in range(n))


def test_repeated_words(spark):
    from pyspark.sql import functions as F

    cases = [[], ["a"] * 2, ["a"] * 3, ["a"] * 4, "a b c a b c".split(), "a b c x a b c y".split(), "a b a b a b".split(), words(30, "w").split()]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cases], "w array<string>").select(q.repeated_words(F.col("w"))).collect()]

    def brute(w):
        grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)})

    assert got == [brute(c) for c in cases]


def test_repeated_words_with_clashing_hashes_and_many_windows(spark, monkeypatch):
    """With 3 bits of hash left in packed windows nearly all clash; with 2 bits of place texts are over the limit."""
    from pyspark.sql import functions as F

    w = (words(200, "w").split() + "a b c".split()) * 2 + words(50, "v").split()
    df = spark.createDataFrame([(w,)], "w array<string>")
    for bits in (20, 61, 2):
        monkeypatch.setattr(q, "PLACE_BITS", bits)
        assert df.select(q.repeated_words(F.col("w"))).first()[0] == 406


def test_lines_go_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    out = q.quality(docs)
    lost = out.where("n_left_words < n_words").count()
    assert lost > 1000 and out.where("NOT kept AND NOT base_failed").count() > 0


def test_columns_of_any_name(spark):
    row = ("k", 1, 2, 3, 4, 5.5, 6)
    docs = spark.createDataFrame([(1, words(60, "d"), *row)], "doc_id long, text string, source string, __id int, __of int, __at int, __gone int, `a.b` double, id int")
    assert [tuple(r)[2:] for r in q.clean(docs).collect()] == [row]


def test_lines_of_many_documents_go(spark):
    rows = [(i, words(60, f"d{i}_") + "\nAll Rights  reserved 2019", "h") for i in range(30)]
    rows += [(100 + i, "\n".join(["All rights reserved 2024"] * 3 + [words(48, f"e{i}_")]), "h") for i in range(3)]
    rows += [(200, words(60, "z") + "\nAll rights reserved 1", "other"), (201, None, None), (202, words(49, "y"), "h"), (203, " ".join(["a b c d"] * 30), "h"), (204, "", "h")]
    rows += [rows[0]]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, source string, n_chars int, removed string")
    out = q.quality(docs).collect()
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows)
    assert all(got[i]["kept"] and got[i]["n_left_words"] == 60 for i in range(30))
    assert all(not got[100 + i]["base_failed"] and not got[100 + i]["kept"] for i in range(3))
    assert got[200]["kept"] and got[200]["n_left_words"] == 64
    assert [got[i]["base_failed"] for i in (201, 202, 203, 204)] == [True] * 4
    kept = q.clean(docs)
    assert kept.columns == docs.columns
    texts = {r["doc_id"]: r for r in kept.collect()}
    assert kept.count() == 32 and texts[3]["text"] == words(60, "d3_") and texts[3]["n_chars"] == len(texts[3]["text"]) and "reserved" in texts[200]["text"] and texts[200]["n_chars"] == 1


def test_lines_of_a_small_share_of_a_large_host_go(spark):
    shares = {"Kept by 19 documents": 19, "Seen on 20 pages": 20, "Subscribe to the letter": 100, "Cookies are used here": 200}
    passage = words(60, "p")
    rows = [(i, "\n".join([words(60, f"d{i}_"), *(line for line, n in shares.items() if i < n)]), "h") for i in range(2000)]
    # a passage of over 50 words in 25 documents that hold little else
    rows += [(3000 + i, passage + "\n" + words(10, f"e{i}_"), "h") for i in range(25)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    got = {r["doc_id"]: r for r in q.quality(docs).collect()}
    gone = lambda i: sum(len(line.split()) for line, n in shares.items() if 20 <= n and i < n)
    assert all(got[i]["kept"] and got[i]["n_words"] - got[i]["n_left_words"] == gone(i) for i in range(2000))
    assert not any(got[3000 + i]["kept"] for i in range(25))
    texts = {r["doc_id"]: r["text"] for r in q.clean(docs).collect()}
    assert set(texts) == set(range(2000))
    assert texts[0] == words(60, "d0_") + "\nKept by 19 documents" and texts[150] == words(60, "d150_")


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert q.quality(docs).count() == 0 and q.clean(docs).count() == 0
