"""The manifest against a plain tree, for several fanouts, sizes of arrays and tables."""

import hashlib
import random
import zlib

import pytest

from glossa.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes, fanout):
    """Root, and for each leaf the (before, after) digests on its way up."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + fanout] for i in range(0, len(nodes), fanout)]
        for k, p in enumerate(place):
            run, own = runs[p // fanout], p % fanout
            paths[k].append((run[:own], run[own + 1 :]))
            place[k] = p // fanout
        nodes = [h(*r) for r in runs]
    return nodes[0], paths


def plain(rows, fanout):
    nul = lambda v: (v is not None, v if v is not None else 0)
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (nul(r[0]), leaf(r))) for g in langs}
    subs = {g: tree([leaf(r) for r in groups[g]], fanout) for g in langs}
    root, tops = tree([subs[g][0] for g in langs], fanout)
    out = []
    for g, top in zip(langs, tops):
        for r, path in zip(groups[g], subs[g][1]):
            whole = path + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf((*r[:3], r[3] + 1, r[4]) if bad else r)
            for before, after in whole:
                node = h(*before, node, *after)
            out.append((r[0], leaf(r), subs[g][0], root, h(*(x for b, a in whole for x in b + a)), node, node == root))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    return sorted((tuple(r) for r in merkle.audit(spark.createDataFrame(rows, SCHEMA), **kw).collect()), key=str)


def made(n, seed):
    rng = random.Random(seed)
    return [(i, rng.choice(["s", None, ""]), rng.choice(["en"] * 6 + ["de", "fr", None, "", "ű"]), rng.choice([None, i]), rng.choice([None, "", "é" * (i % 9)])) for i in rng.sample(range(-n, 20 * n), n)]


@pytest.mark.parametrize("n, fanout, depth", [(300, 2, 3), (130, 3, 2), (200, 2, 10), (64, 4, 1)])
def test_against_a_plain_tree(spark, n, fanout, depth):
    rows = made(n, n)
    assert got(spark, rows, fanout=fanout, depth=depth) == plain(rows, fanout)


def test_defined_cases(spark):
    assert merkle.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(5, "s", "en", 3, "abc")]
    assert got(spark, one) == plain(one, 2)  # a lone leaf is the root, with no siblings
    odd = [(None, None, None, None, None), (1, "s", None, 2, "x"), (1, "s", None, 2, "x"), (1, "s", None, 2, "y"), (2, "s", "en", 3, "z" * 2_000_000)]
    assert got(spark, odd, depth=2) == plain(odd, 2)
    clash = spark.createDataFrame([(*r, 1, 2, 3) for r in odd], SCHEMA + ", g int, at int, node int")
    assert sorted((tuple(r) for r in merkle.audit(clash).collect()), key=str) == plain(odd, 2)


def test_powers_and_neighbours(spark):
    for n in (2, 3, 4, 5, 8, 9, 16, 17):
        rows = [(i, "s", "en", i, "t") for i in range(n)]
        assert got(spark, rows, depth=2) == plain(rows, 2)
