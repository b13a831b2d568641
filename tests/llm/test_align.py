"""Alignment of tokenizers against nested loops over all pairs of tokens."""

import hashlib
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from glossa.llm import align

SCHEMA = "doc_id long, text string"
TEXTS = [
    "The quick brown fox", "the  fox\n\njumps", "", None, "naïve café — “quotes” \U0001f600\U0001f600", "<|endoftext|> <s> </s> <unk> <0x41> ▁x", " leading", "\ttabs\r\n", "123456 3.14",
    "日本語のテキスト ελληνικά", "a", " ", " 　", "é ‍ zero", "\x00null", "ſ ﬁ ½", "the the the the",
]


def tokens(text):
    """Bytes and ids of both sides by the tokenizers' own decoders of single ids."""
    a, b, *_ = align.vocabularies(align.FOLDER)
    back = align._byte_of()
    left = [(i, bytes(back[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        p = b.id_to_piece(i)
        right.append((i, bytes.fromhex(p[3:5]) if p.startswith("<0x") and b.is_byte(i) else p.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    ok = text and b"".join(x for _, x in left) == whole == b"".join(x for _, x in right)
    return (left, right) if ok else ([], [])


def spans(side):
    out, at = [], 0
    for i, x in side:
        out.append((i, at, at + len(x)))
        at += len(x)
    return out


def plain(rows):
    links, groups, sizes = [], [], []
    for _, t in rows:
        a, b = map(spans, tokens(t or ""))
        links.append([(i, j) for i, s, e in a for j, u, v in b if s < v and u < e])
        ends, text, lo = sorted({e for *_, e in a} & {e for *_, e in b}), [], 0
        for hi in ends:
            text.append(",".join(str(i) for i, s, e in a if lo < e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo < e <= hi))
            lo = hi
        groups.append(text)
        sizes.append((len(a), len(b)))
    n = Counter(p for x in links for p in x)
    best = Counter()
    for (_, j), k in n.items():
        best[j] = max(best[j], k)
    return sorted(
        (i, *s, len(g), len(x), sum(n[p] == best[p[1]] for p in x), sum(n[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
        for (i, _), s, g, x in zip(rows, sizes, groups, links)
    )


def got(df):
    return sorted(map(tuple, df.collect()))


def test_against_nested_loops(spark):
    rng = random.Random(3)
    words = "the of naïve tokenization 12 … 雪 coöperate\n\n  \U0001f600 x".split(" ")
    rows = list(enumerate(TEXTS)) + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)]
    assert got(align.summary(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


@pytest.mark.parametrize("hot", [1, 10**9])
def test_pairs_by_shuffle_and_by_broadcast_agree(spark, monkeypatch, hot):
    monkeypatch.setattr(align, "HOT_PAIRS", hot)
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    assert got(align.summary(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in docs.where("length(text) < 600").collect()][:60]
    assert got(align.summary(spark.createDataFrame(rows, SCHEMA))) == plain(rows)


def test_defined_cases(spark):
    assert align.summary(spark.createDataFrame([], SCHEMA)).count() == 0
    long = "lorem ipsum dolor sit amet " * 60_000
    out = align.summary(spark.createDataFrame([(1, long), (1, "x"), (1, "x")], SCHEMA)).collect()
    assert len(out) == 3 and sorted(r.n_a for r in out)[2] > 300_000
    clash = spark.createDataFrame([(1, "ab c", 5, 6, 7)], SCHEMA + ", id int, row int, pairs int")
    assert got(align.summary(clash)) == plain([(1, "ab c")])


def test_pair_table(spark):
    rows = spark.createDataFrame([(1, "the the the"), (2, "the thing")], SCHEMA)
    saved = align.aligned(rows).cache()
    table = align.with_best(align.pair_table(saved)).collect()
    assert sum(r.n for r in table) == sum(r.n_links for r in saved.collect())
    for side in "ab":
        for r in table:
            assert r[f"best_of_{side}"] == (r.n == max(x.n for x in table if x[side] == r[side]))


def test_merge_is_the_two_pointer_merge():
    rng = np.random.default_rng(1)
    for _ in range(200):
        top = int(rng.integers(1, 60))
        a, b = (np.unique(np.append(rng.integers(1, top + 1, rng.integers(0, 20)), top)) for _ in "ab")
        i = j = 0
        want = []
        while i < len(a):
            both = a[i] == b[j]
            want.append((i, j, bool(both)))
            i, j = i + (a[i] <= b[j]), j + (b[j] <= a[i])
        at_a, at_b, both, _ = align.merged(a, b)
        assert list(zip(at_a.tolist(), at_b.tolist(), both.tolist())) == want


def test_both_readers_of_a_agree():
    """Where the ranks read a text, they give the ids of A's own file."""
    a, *_ = align.vocabularies(align.FOLDER)
    rng = random.Random(12)
    alphabet = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xC0, 0x17F))] + [" ", " ", "\n", "'s", "'ll", "  ", "12", "the ", "<|endoftext|>", "word", "ß"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 60))) for _ in range(20_000)] + ["a" * 5000, " " * 3000 + "x", "\n" * 999]
    clear = [t for t in texts if align.CLEAR.fullmatch(t)]
    assert len(clear) > 5000
    want = [e.ids for e in a.encode_batch([" " + t for t in clear], add_special_tokens=False)]
    assert align.ids_of_a(clear, align.FOLDER) == want
    docs = duckdb.sql("SELECT text FROM '/root/testdata/sf0.01/documents.parquet'").fetchall()
    texts = [t for (t,) in docs if align.CLEAR.fullmatch(t)]
    assert len(texts) > 500 and align.ids_of_a(texts, align.FOLDER) == [e.ids for e in a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
