import random

import xxhash

from glossa.llm import decontaminate as d


def data():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, text(rng.choice([3, 7, 14, 20, 37, 59, 80]))) for i in range(40)]
    docs = []
    for k in range(300):
        words = text(rng.randint(0, 400))
        if k % 3 == 0:
            i, item = rng.choice(items)
            item = list(item)
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                at = rng.choice([0, len(item) - 1, rng.randrange(len(item))])
                item[at] = rng.choice(vocabulary)
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs.append((k, " ".join(w.upper() + "!" if k % 5 == 0 else w for w in words)))
    return docs, [(i, " ".join(w)) for i, w in items]


def brute(docs, items):
    out = set()
    for k, text in docs:
        words = d.words(text)
        for i, item in items:
            w = d.words(item)
            s = d.shingles(w)
            if w and any(d.similarity(d.shingles(words[a : a + len(w)]), s) >= d.SIMILARITY for a in range(max(1, len(words) - len(w) + 1))):
                out.add((k, i))
    return out


def test_leaks_equal_brute_force(spark):
    docs, items = data()
    docs += [(900, None), (901, ""), (902, docs[0][1])]
    items += [(900, None), (901, "")]
    a = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(a, b).collect()}
    assert got == brute(docs, items) and len(got) > 50
    kept = d.clean(a.withColumn("item_id", a["doc_id"] * 2), b)
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert {r["doc_id"] for r in kept.collect()} == {k for k, _ in docs} - {k for k, _ in got}


def test_edges(spark):
    a = spark.createDataFrame([(1, "x y z")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.leaks(a, none).count() == 0 and d.clean(a, none).count() == 1
    assert d.leaks(a.limit(0), spark.createDataFrame([(1, "x y z")], none.schema)).count() == 0
    long = spark.createDataFrame([(1, "w " * 100_000 + "the quick brown fox jumps over lazy dogs today now")], "doc_id long, text string")
    assert d.leaks(long, spark.createDataFrame([(1, "the quick brown fox jumps over lazy dogs today now")], none.schema)).count() == 1


def test_windows_agree_with_a_plain_simhash():
    import numpy as np

    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 63, 700, dtype=np.uint64)
    for size in (1, 2, 3, 5, 7, 200, 300):
        got = d.simhashes(d.running(h, size), size)
        for i in range(len(h) - size + 1):
            bits = d.planes(h[i : i + size]).sum(axis=0) > size // 2
            assert np.packbits(bits).view(np.uint64)[0] == got[i]


def test_index_finds_all_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(4)
    items = d.Items([(i, " ".join(f"w{x}" for x in rng.integers(0, 5000, 30))) for i in range(50)])
    (prints, owners, first, *_), = items.sizes.values()
    for k, f in enumerate(prints):
        for _ in range(40):
            flips = rng.choice(64, rng.integers(0, d.RADIUS + 1), replace=False)
            g = np.array([int(f) ^ sum(1 << int(b) for b in flips)], np.uint64).view(np.uint16)
            assert any(k in owners[b][first[b][int(g[b])] : first[b][int(g[b]) + 1]] for b in range(4))


def test_recall_at_the_threshold():
    """Items of many lengths with as many evenly spaced edits as the similarity allows, inside other text."""
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(4000)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    tried = missed = 0
    for n in (15, 20, 30, 49, 59, 94, 100, 142, 185, 250):
        items, docs, want = [], [], set()
        for i in range(24):
            item = text(n)
            items.append((i, " ".join(item)))
            most = max((n - 4) // 45, 0)
            copy = list(item)
            for k in range(most):
                at = (k + 1) * n // (most + 1)
                kind = rng.randrange(3)
                copy[at : at + (kind != 1)] = [] if kind == 0 else text(1)
            if most == 0:
                copy[rng.choice([0, -1])] = text(1)[0]
            doc = text(30) + copy + text(30)
            docs.append(doc)
            if any(d.similarity(d.shingles(doc[a : a + n]), d.shingles(item)) >= d.SIMILARITY for a in range(len(doc) - n + 1)):
                want.add((i, i))
        got = {(a, b) for a, b, _, _ in d.matches(docs, d.Items(items))}
        assert got <= want | {(a, b) for a, b in got if a != b}
        tried, missed = tried + len(want), missed + len(want - got)
    assert tried > 120 and missed <= 0.01 * tried


def test_repeated_phrases_lose_nothing(spark):
    """Items of a phrase that is repeated, with one word of it replaced throughout: few distinct shingles change, at many places."""
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8)))
    items, docs = [], []
    for k in range(16):
        phrase, free = [word() for _ in range(10)], [word() for _ in range(100)]
        times = rng.choice([2, 5, 20, 30])
        changed = list(phrase)
        changed[rng.randrange(10)] = word()
        items.append((k, " ".join(free + phrase * times)))
        around = [word() for _ in range(rng.randint(0, 30))]
        docs.append((k, " ".join(around + free + changed * times + [word() for _ in range(rng.randint(0, 30))])))
    want = brute(docs, items)
    got = {(r["doc_id"], r["item_id"]) for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want == d_screened(docs, items) and len(want) == 16


def d_screened(docs, items):
    """Pairs of which some place passes the screens and is similar: what the screens alone leave."""
    out = set()
    for k, text in docs:
        words = d.words(text)
        for i, item in items:
            w = d.words(item)
            s, edge = d.shingles(w), d.WIDTH - 1
            limit = (1 / d.SIMILARITY - 1) / d.WIDTH * sum(s.values()) + 1e-6
            for a in range(max(1, len(words) - len(w) + 1)):
                window = words[a : a + len(w)]
                if d.weight_of(set(w), window[:edge], window[edge : len(window) - edge]) <= limit and d.similarity(d.shingles(window), s) >= d.SIMILARITY:
                    out.add((k, i))
    return out


def test_words_by_numpy_are_those_of_the_pattern():
    rng = random.Random(11)
    letters = ["a", "B", "é", "_", "7", "İ", "Σ", "的", "😀", "\U00020000", "\ud800", "\u0301", " ", "\n", "-", "\x00", "·"]
    texts = [None, "", "x" * (d.PIECE + 9), ("ab cd" * 99 + "\n") * 300] + ["".join(rng.choices(letters, k=rng.randint(0, 90))) for _ in range(300)]
    got, hashes = d.Texts(texts), {}
    at = 0
    for i, t in enumerate(texts):
        want = d.words(t)
        assert got.words(i) == want and got.lengths[i] == len(want)
        assert got.chars[at : at + len(want)].tolist() == list(map(len, want))
        for w, h in zip(want, got.hashes[at : at + len(want)].tolist(), strict=True):
            assert hashes.setdefault(w, h) == h == xxhash.xxh64_intdigest(w)
        at += len(want)
    assert at == len(got.hashes) and len(set(hashes.values())) == len(hashes)


def test_texts_of_a_task_cost_less_than_their_words_as_strings():
    """Items are found in a block of texts of which few words are ever made strings."""
    rng = random.Random(12)
    items = d.Items([(i, " ".join(f"q{rng.randrange(10**6)}" for _ in range(40))) for i in range(20)])
    docs = d.Texts([" ".join(f"w{rng.randrange(3000)}" for _ in range(400)) for _ in range(200)] + [" ".join(items.words[3][1])])
    made = []
    docs.words = lambda i: made.append(i) or d.Texts.words(docs, i)
    assert [(a, b) for a, b, _, _ in d.found_in(docs, items)] == [(200, 3)] and made == [200]
