"""Sessions as keyed state of a stream: sliding expiry, log-outs, timers, and who is around.

Events have time, token, kind (login, logout; others touch the session), user_id and user_name. A session lives for TIMEOUT
after the last event that touched it. Rows of one batch are taken in the order of time; of rows that a later batch brings,
those older than the watermark are dropped, and others never bring an expiry forward. A timer ends a session that nothing
touches any more, so the state holds live sessions alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Seconds that a session lives untouched, and seconds that it must have left for its user to be around.
TIMEOUT, AROUND = 3600, 3000
STATE = "user_id long, user_name string, expires long"
OUT = "token string, time timestamp, kind string, live boolean, user_id long, user_name string, expires timestamp"
NOBODY = -1


def _moment(micros: int | None):
    return None if micros is None else pd.Timestamp(micros, unit="us")


def _follow(rows: list[tuple], held: tuple | None, timeout: int) -> tuple[list[tuple], tuple | None]:
    """What a token's events (micros, kind, user_id, user_name), in order, do to its session (user_id, user_name, expires)."""
    out = []
    for at, kind, user, name in rows:
        if held and held[2] < at:
            out.append((held[2], "expired", False, held[0], held[1], held[2]))
            held = None
        if kind == "login":
            held = (user, name, at + timeout)
        elif kind == "logout":
            held = None
        elif held:
            held = (held[0], held[1], max(held[2], at + timeout))
        out.append((at, kind, True, *held) if held else (at, kind, False, NOBODY, None, None))
    return out, held


def sessions(events: DataFrame, late: str = "10 minutes", timeout: int = TIMEOUT) -> DataFrame:
    """One row for each event, with the session as it is after it (live, user, expiry), and one for each session that runs out."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            out, held = [(held[2], "expired", False, *held)], None
        else:
            rows = [r for f in frames for r in zip(f["at"].tolist(), f["kind"].tolist(), f["user_id"].tolist(), f["user_name"].tolist())]
            rows.sort(key=lambda r: (r[0], r[1] != "login", r[1] == "logout"))
            out, held = _follow(rows, held, timeout * 1_000_000)
        if held and held[2] // 1000 <= state.getCurrentWatermarkMs():
            out.append((held[2], "expired", False, *held))
            held = None
        if held is None:
            if state.exists:
                state.remove()
        else:
            state.update(held)
            state.setTimeoutTimestamp(held[2] // 1000)
        yield pd.DataFrame({
            "token": [key[0]] * len(out), "time": [_moment(r[0]) for r in out], "kind": [r[1] for r in out], "live": [r[2] for r in out],
            "user_id": pd.array([r[3] for r in out], dtype="Int64"), "user_name": [r[4] for r in out], "expires": pd.Series([_moment(r[5]) for r in out], dtype="datetime64[us]"),
        })

    marked = events.where("token IS NOT NULL AND time IS NOT NULL").withWatermark("time", late)
    keyed = marked.select("token", "time", F.unix_micros("time").alias("at"), "kind", F.coalesce("user_id", F.lit(NOBODY)).cast("long").alias("user_id"), "user_name")
    return keyed.groupBy("token").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def write(rows: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends rows to a Parquet folder; with the same checkpoint it goes on where it stopped, with the sessions it held."""
    writer = rows.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def around(rows: DataFrame, now, users: DataFrame | None = None, left: int = AROUND) -> DataFrame:
    """user_id of users with a live session that has at least ``left`` seconds to go at a moment; of ``users``, their present rows.

    A user's score and permissions are looked up here and not kept in the state, so a change shows in all their sessions at once.
    """
    moment = F.lit(now).cast("timestamp")
    last = rows.where(F.col("time") <= moment).groupBy("token").agg(F.max_by(F.struct("live", "user_id", "expires"), F.struct("time", F.col("kind") != "login")).alias("s"))
    ids = last.where(F.col("s.live") & (F.col("s.expires") >= moment + F.make_dt_interval(secs=F.lit(left)))).select("s.user_id").distinct()
    return ids if users is None else users.join(ids, "user_id", "left_semi")
