import base64
import hashlib
import os

from glossa.llm import warc
from glossa.llm.common import Scratch

SCHEMA = "page_id long, url string, html string, head string"


def pages():
    trap = "<p>x</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:777>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1\r\nWARC/1.1\r\nContent-Length: 9999999\r\n\r\n"
    rows = [(1, "http://a/é", "ünï\U0001f600", "h"), (2, None, None, None), (3, "http://b", "", "h"), (4, "http://c", trap, "h"), (5, "http://d", trap, None), (6, "u", "line\nline\r\n", "h"), (7, "u", "ünï\U0001f600", "h")]
    return rows + [(i, f"http://e/{i}", f"page {i % 40} " + "z" * (i % 13) * 50, "h") for i in range(10, 200)] + [(300, "r", "repeat", "h")] * 3 + [(301, "q", "repeat", "h"), (301, None, "repeat", "h")]


def test_round_trip_equals_brute_force(spark):
    rows = pages()
    got = warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    top = {}
    for p, _, h, _ in rows:
        top[h or ""] = max(p, top.get(h or "", p))
    want, seen = [], set()
    for p, _, h, _ in rows:
        b = (h or "").encode()
        first = top[h or ""] == p and (p, b) not in seen
        seen.add((p, b))
        want.append((p, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else top[h or ""]))
    order = lambda r: (r[0], r[3], r[4] or -1)
    assert sorted(map(tuple, got), key=order) == sorted(want, key=order)


def test_payloads_come_back(spark):
    rows = pages()[:12]
    scratch = Scratch(spark)
    warc.write(spark.createDataFrame(rows, SCHEMA), f"{scratch.root}/w")
    got = {r["page_id"]: r for r in warc.read(spark, f"{scratch.root}/w").collect()}
    assert len(got) == len(rows)
    for p, url, html, _ in rows:
        assert got[p]["url"] == url
        if got[p]["record_type"] == "response":
            assert bytes(got[p]["payload"]) == (html or "").encode()


def test_no_record_is_lost_when_splits_change(spark):
    rows = pages()
    scratch = Scratch(spark)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        warc.write(spark.createDataFrame(rows, SCHEMA), f"{scratch.root}/w")
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        _, raw, owned = warc.walk(spark, f"{scratch.root}/w")
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        found = warc.joined(raw, owned).select(*warc._named(warc.F.col("head"))).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["page_id"] for r in found) == sorted(r[0] for r in rows)


def test_null_page_id_and_a_long_payload(spark):
    long = "WARC/1.1\r\n" + "é" * 700_000 + "WARC/1.1\r\n"
    rows = [(None, "u", "x", "h"), (None, "v", "x", "h"), (None, "v", "x", "h"), (4, "u", long, "h"), (3, "u", long, "h"), (5, None, "x!", "h"), (None, None, None, None)]
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.round_trip(spark.createDataFrame(rows, SCHEMA)).collect()}
    n = len(long.encode())
    assert got == {(None, "response", None, 1), (None, "revisit", None, 1), (4, "response", None, n), (3, "revisit", 4, n), (5, "response", None, 2), (None, "response", None, 0)}


def test_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_archives_go_once_their_pieces_are_saved(spark, monkeypatch):
    paths, left = [], []
    monkeypatch.setattr(warc, "write", lambda pages, path, write=warc.write: (paths.append(path), write(pages, path)))
    monkeypatch.setattr(warc, "chain", lambda scratch, found, chain=warc.chain: (left.append(os.path.exists(paths[0].removeprefix("file://"))), chain(scratch, found))[1])
    pages = spark.createDataFrame([(1, "u", "<p>a</p>"), (2, "u", "<p>a</p>"), (3, None, None)], "page_id long, url string, html string")
    assert {r["page_id"]: r["record_type"] for r in warc.round_trip(pages).collect()} == {1: "revisit", 2: "response", 3: "response"}
    assert left == [False]
