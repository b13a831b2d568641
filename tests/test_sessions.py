"""Sessions as streaming state: a plain run over the events, late rows, and a restart from the checkpoint."""

import datetime as dt
import random

import pandas as pd
import pytest

from glossa.streaming import sessions as S

EVENT = "time timestamp, token string, kind string, user_id long, user_name string"
START = dt.datetime(2024, 1, 1)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def put(spark, folder, n, rows):
    spark.createDataFrame([(at(m), *r) for m, *r in rows], EVENT).coalesce(1).write.parquet(f"{folder}/in/{n}")


def run(spark, folder, late="10 minutes"):
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
    S.write(S.sessions(events, late), f"{folder}/out", f"{folder}/check", once=True).awaitTermination()
    return spark.read.parquet(f"{folder}/out")


def seen(df):
    minutes = lambda t: None if t is None else (t - START).total_seconds() / 60
    return sorted((r.token, minutes(r.time), r.kind, r.live, r.user_id, minutes(r.expires)) for r in df.collect())


def test_sliding_expiry_and_log_out(spark, tmp_path):
    put(spark, tmp_path, 0, [(0, "a", "login", 1, "Anna"), (50, "a", "page", None, None), (100, "a", "page", None, None), (161, "a", "page", None, None), (0, "b", "login", 2, "Béla"), (1, "b", "logout", None, None), (2, "b", "page", None, None), (5, "c", "page", None, None)])
    assert seen(run(spark, tmp_path)) == sorted([
        ("a", 0, "login", True, 1, 60), ("a", 50, "page", True, 1, 110), ("a", 100, "page", True, 1, 160), ("a", 160, "expired", False, 1, 160), ("a", 161, "page", False, -1, None),
        ("b", 0, "login", True, 2, 60), ("b", 1, "logout", False, -1, None), ("b", 2, "page", False, -1, None), ("c", 5, "page", False, -1, None),
    ])


def test_timers_late_rows_and_a_restart(spark, tmp_path):
    put(spark, tmp_path, 0, [(0, "a", "login", 1, "Anna"), (0, "x", "login", 9, "x"), (30, "b", "login", 2, "Béla")])
    first = seen(run(spark, tmp_path))
    assert [r[:3] for r in first] == [("a", 0, "login"), ("b", 30, "login"), ("x", 0, "login")]
    # the stream stops and starts again with what it held; a row within the watermark doesn't bring the expiry forward
    put(spark, tmp_path, 1, [(40, "a", "page", None, None), (35, "b", "page", None, None), (25, "b", "page", None, None)])
    second = seen(run(spark, tmp_path))
    assert ("a", 40, "page", True, 1, 100) in second and ("b", 25, "page", True, 2, 90) in second and ("b", 35, "page", True, 2, 95) in second
    # time goes on: x and b run out by their timers, a row older than the watermark is dropped
    put(spark, tmp_path, 2, [(98, "a", "page", None, None), (120, "z", "login", 3, "z")])
    run(spark, tmp_path)
    put(spark, tmp_path, 3, [(20, "a", "logout", None, None), (121, "z", "page", None, None)])
    last = seen(run(spark, tmp_path))
    assert ("x", 60, "expired", False, 9, 60) in last and ("b", 95, "expired", False, 2, 95) in last
    assert not any(r[2] == "logout" for r in last) and ("a", 98, "page", True, 1, 158) in last
    assert len(last) == len(set(last))


def test_who_is_around(spark, tmp_path):
    put(spark, tmp_path, 0, [(0, "a", "login", 1, "A"), (9, "b", "login", 2, "B"), (9, "b2", "login", 2, "B"), (10, "b2", "logout", None, None), (10, "c", "login", 3, "C"), (11, "c", "logout", None, None)])
    out = run(spark, tmp_path)
    assert [r.user_id for r in S.around(out, at(10)).orderBy("user_id").collect()] == [1, 2, 3]
    assert [r.user_id for r in S.around(out, at(15)).collect()] == [2]  # touched within ten minutes
    assert S.around(out, at(20)).count() == 0
    users = spark.createDataFrame([(1, 5), (2, 200)], "user_id long, score int")
    assert [tuple(r) for r in S.around(out, at(15), users).collect()] == [(2, 200)]


@pytest.mark.parametrize("seed", [1, 2])
def test_one_batch_equals_a_plain_run(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(m, rng.choice("abcdef"), rng.choice(["login", "page", "page", "page", "logout"]), rng.randint(1, 9), "n") for m in rng.sample(range(0, 1500), 200)]
    put(spark, tmp_path, 0, rows)
    want, held, top = [], {}, max(r[0] for r in rows)
    for m, token, kind, user, _ in sorted(rows):
        if token in held and held[token][1] < m:
            want.append((token, held[token][1], "expired", False, held[token][0], held[token][1]))
            del held[token]
        if kind == "login":
            held[token] = (user, m + 60)
        elif kind == "logout":
            held.pop(token, None)
        elif token in held:
            held[token] = (held[token][0], m + 60)
        want.append((token, m, kind, True, *held[token]) if token in held else (token, m, kind, False, -1, None))
    want += [(t, e, "expired", False, u, e) for t, (u, e) in held.items() if e < top - 10]
    assert seen(run(spark, tmp_path)) == sorted(want)


def test_empty_frames():
    assert S._follow([], None, 1) == ([], None) and isinstance(S._moment(0), pd.Timestamp)
