import hashlib
import random

from glossa.llm import suffixes as sx


def test_suffix_array_equals_a_sort():
    rng = random.Random(2)
    for trial in range(400):
        n = rng.randint(0, 60)
        t = [rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(n)]
        if trial % 3 == 0:
            t = t[: n // 3] * 3
        assert sx.suffix_array(t) == sorted(range(len(t)), key=lambda i: t[i:]), t


def test_suffix_array_takes_linear_time():
    import time

    def seconds(n):
        best = 9.0
        for _ in range(2):
            t = time.process_time()
            sx.suffix_array([1, 2] * (n // 2) + [3] * n)
            best = min(best, time.process_time() - t)
        return best

    assert seconds(160_000) < 40 * seconds(10_000)  # sixteenfold input


def brute_words(texts, length):
    places = {}
    data = [(t or "").encode().split() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            places.setdefault(tuple(b[i : i + length]), []).append((d, i))
    gone = [[False] * len(b) for b in data]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = [True] * length
    return [sum(g) for g in gone]


def brute(texts, length):
    places = {}
    data = [(t or "").encode() for t in texts]
    for d, b in enumerate(data):
        for i in range(len(b) - length + 1):
            places.setdefault(b[i : i + length], []).append((d, i))
    gone = [[False] * len(b) for b in data]
    for at in places.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = [True] * length
    out = []
    for b, g in zip(data, gone):
        rest = bytes(x for x, y in zip(b, g) if not y)
        out.append((len(b), sum(g), sum(g[i] and (i == 0 or not g[i - 1]) for i in range(len(g))), hashlib.sha256(rest).hexdigest()))
    return out


def texts():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(rng.randint(5, 60)) for _ in range(8)]
    out = [None, "", "short", "a" * 300, "ab" * 200, "x" * 39, "x" * 40 + "y" * 41]
    for _ in range(80):
        parts = [text(rng.randint(0, 30)) for _ in range(4)]
        parts.insert(rng.randint(0, 4), rng.choice(shared))
        parts.insert(rng.randint(0, 4), rng.choice(shared)[: rng.randint(20, 200)])
        out.append(" ".join(parts))
    return out + out[10:14] + out[10:11]


def test_dedup_equals_brute_force(spark, monkeypatch):
    rows = texts()
    want = brute(rows, 40)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(rows)], "doc_id long, text string, tkey string")
    words = brute_words(rows, 8)
    for most in (8192, 2):
        monkeypatch.setattr(sx, "MOST", most)
        got = {r["doc_id"]: tuple(r)[1:] for r in sx.dedup(docs, length=40, window=9, words=8, word_window=3).collect()}
        assert [got[i][:4] for i in range(len(rows))] == want
        assert [got[i][4] for i in range(len(rows))] == words and sum(words) > 1000


def test_production_length(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    long = " ".join(word() for _ in range(300))
    rows = [long, long[:700] + word() + long[720:], "q" + long[100:499], "q" + long[100:500] + "q", " ".join(word() for _ in range(500))]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in sx.dedup(docs).collect()}
    assert [got[i] for i in range(len(rows))] == brute(rows, 400)


def test_empty(spark):
    assert sx.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
