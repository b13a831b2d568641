"""Codes without clashes, prefix ranges, and exports, against plain Python."""

import datetime as dt
import gzip
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from glossa.operators import edits
from glossa.operators import export as X
from glossa.operators import index as I
from glossa.operators import numbers as N
from glossa.sources import entries


@pytest.mark.parametrize("n, used", [(100, 0), (60, 40), (30, 0), (1, 99), (0, 5)])
def test_no_row_is_lost_in_a_space_of_a_hundred(spark, n, used):
    rows = spark.createDataFrame([(i, f"k{i % 7}") for i in range(n)], "i int, k string")
    taken = spark.createDataFrame([(x,) for x in random.Random(n).sample(range(100), used)], "number long")
    got = N.unique_numbers(rows, F.col("k"), 100, taken).collect()
    numbers = {r.number for r in got}
    assert sorted(r.i for r in got) == list(range(n)) and len(numbers) == n
    assert all(0 <= x < 100 for x in numbers) and not numbers & {r.number for r in taken.collect()}


def test_a_full_space_is_refused(spark):
    with pytest.raises(ValueError, match="don't fit"):
        N.unique_numbers(spark.range(11), F.col("id"), 10)


def test_free_numbers(spark):
    taken = [0, 1, 4, 7, 8, 20]
    wanted = spark.range(12).withColumnRenamed("id", "place")
    got = {r.place: r.n for r in N.free_numbers(wanted, spark.createDataFrame([(x,) for x in taken], "number long"), "place", "n").collect()}
    free = [x for x in range(40) if x not in taken]
    assert got == {i: free[i] for i in range(12)}


def test_codes_of_repeated_lines(spark):
    lines = spark.createDataFrame([("X X [x] /same/",)] * 40 + [(f"X X [x] /s{i}/",) for i in range(50)], "text string")
    made = edits.prepared(lines, "2017-05-02T22:41:05Z", "u", "n", space=100).collect()
    assert len(made) == 90 and len({r.code for r in made}) == 90


def test_first_codes_follow_from_the_lines(spark):
    lines = spark.createDataFrame([(f"X X [x] /s{i}/",) for i in range(50)], "text string")
    codes = lambda df: {(r.line, r.code) for r in edits.prepared(df, "2017-05-02T22:41:05Z", "u", "n").collect()}
    assert codes(lines) == codes(lines.orderBy(F.desc("text")).repartition(3))


def test_prefix_ranges_reach_the_scan(spark, tmp_path):
    words = [("ela", 1), ("élan", 2), ("Elbe", 3), ("el", 1), ("xeno", 1), ("elań", 5), ("鿿a", 1), ("鿿", 2), ("gone", 0)]
    held = I.prefix_table(spark.createDataFrame(words, "word string, freq int"), str(tmp_path / "p"))
    assert [r.folded for r in I.prefix_hints(held, "ÉLA", 10).collect()] == ["ela", "elan", "elan"]
    assert [r.word for r in I.prefix_hints(held, "鿿", 10).collect()] == ["鿿", "鿿a"]
    assert I.prefix_hints(held, "", 100).count() == 8 and I.prefix_hints(held, "elanx", 5).count() == 0
    plan = spark._jvm.PythonSQLUtils.explainString(I.prefix_hints(held, "ela", 10)._jdf.queryExecution(), "formatted")
    pushed = next(line for line in plan.split("\n") if "PushedFilters" in line)
    assert "GreaterThanOrEqual(packed" in pushed and "LessThanOrEqual(packed" in pushed


def plain_versions(now, changes):
    """From the newest change back: what a change found is the state of the version before it."""
    head, target, status = now
    out = []
    for c in sorted(changes, key=lambda c: c["time"], reverse=True):
        out.append((head, target, status))
        head, target = c["head_before"] or head, c["target_before"] or target
        status = c["status_before"] if c["chg"] == 4 else status
    out.reverse()
    shown = [i in (0, len(out) - 1) or out[i][:2] != out[i - 1][:2] for i in range(len(out))]
    return [(*o, s) for o, s in zip(out, shown)]


SCHEMA = "entry_id long, head string, target string, status int, time timestamp, user string, bulk_ref int, comment string, head_before string, target_before string, status_before int, chg int"


def made(n_entries, seed):
    rng, rows, want = random.Random(seed), [], {}
    for e in range(n_entries):
        now, changes = (f"h{e}", f"/t{e}/", rng.randint(0, 2)), []
        for k in range(rng.randint(1, 9)):
            chg = rng.randint(0, 4)
            changes.append({"time": dt.datetime(2020, 1, 1 + k), "head_before": rng.choice([None, "", f"x{k}"]), "target_before": rng.choice([None, "", f"/y{k}/"]), "status_before": rng.randint(0, 2), "chg": chg})
        rows += [(e, *now, c["time"], "u", 1, "a\nb", c["head_before"], c["target_before"], c["status_before"], c["chg"]) for c in changes]
        want[e] = plain_versions(now, changes)
    return rows, want


def test_versions_and_blocks(spark, tmp_path):
    rows, want = made(40, 3)
    versions = X.version_rows(spark.createDataFrame(rows, SCHEMA), "time")
    got = {}
    for r in sorted(versions.collect(), key=lambda r: (r.entry_id, r.version)):
        got.setdefault(r.entry_id, []).append((r.head, r.target, r.status, r.shown))
    assert got == want
    folder = str(tmp_path / "out")
    lines = X.block_lines(versions, F.lpad(F.col("entry_id").cast("string"), 7, "0"))
    assert X.write_blocks(lines, folder, ["# first", "# second"])
    text = "".join(gzip.open(p, "rt").read() for p in sorted(Path(folder, "blocks").glob("*.gz")))
    blocks = [b for b in text.split("\n\n") if b.strip()]
    assert len(blocks) == 40 and all(b.startswith("# ID-") for b in blocks)
    for b in blocks:
        rows_ = b.split("\n")
        e = int(rows_[0][5:])
        bodies = [x for x in rows_[1:] if not x.startswith("# Ver ")]
        assert [x.startswith("# ") for x in bodies] == [True] * (len(bodies) - 1) + [False]
        assert [x.removeprefix("# ") for x in bodies] == [f"{h} {t}" for h, t, _, s in want[e] if s]
        assert sum(x.startswith("# Ver ") for x in rows_) == len(want[e]) and "a\\nb" in rows_[1]
    assert [p.name for p in sorted(Path(folder).iterdir())][0] == "a-prologue"
    # what was written parses again, with the lines left out filled in
    back = entries.versions(entries.read_blocks(spark, f"{folder}/blocks").select("block"))
    assert {r.code: r.n for r in back.groupBy("code").agg(F.count("*").alias("n")).collect()} == {f"{e:07d}": len(v) for e, v in want.items()}


def test_nothing_is_written_over_newer_files(spark, tmp_path):
    lines = spark.createDataFrame([("a", 0, 0, "x")], "code string, version int, part int, text string")
    assert not X.write_blocks(lines, str(tmp_path / "o"), [], last_change=5, written_at=6)
    assert X.write_blocks(lines, str(tmp_path / "o"), [], last_change=6, written_at=6, compression=None)


def test_an_entry_with_many_versions(spark, tmp_path):
    n = 300_000
    changes = spark.range(n).select(
        F.lit(1).cast("long").alias("entry_id"), F.lit("h").alias("head"), F.lit("/t/").alias("target"), F.lit(0).alias("status"), F.timestamp_seconds("id").alias("time"), F.lit("u").alias("user"), F.lit(0).alias("bulk_ref"), F.lit("").alias("comment"),
        F.lit(None).cast("string").alias("head_before"), F.when(F.col("id") % 2 == 0, F.concat(F.lit("/"), F.col("id").cast("string"), F.lit("/"))).alias("target_before"), F.lit(0).alias("status_before"), F.lit(2).alias("chg"),
    )
    lines = X.block_lines(X.version_rows(changes, "time"), F.lit("aaaaaaa"))
    X.write_blocks(lines, str(tmp_path / "o"), [])
    assert X.read_lines(spark, str(tmp_path / "o")).count() == 1 + n + n // 2 + 1 + 1


def test_files_of_an_export_grow_in_number(spark, tmp_path):
    assert [X.parts_of(n) for n in (0, 1, X.PART_ROWS, X.PART_ROWS + 1, 90 * X.PART_ROWS)] == [1, 1, 1, 2, 90]
    lines = spark.createDataFrame([(f"{i:03}", 0, p, f"# ID-{i:03}" if p == 0 else "x") for i in range(200) for p in (0, 1)], "code string, version int, part int, text string")
    assert X.write_blocks(lines, str(tmp_path / "o"), [], parts=7)
    rows = X.read_lines(spark, str(tmp_path / "o"))
    assert rows.count() == 400 and rows.select("file").distinct().count() == 7
