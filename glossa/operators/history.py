"""Version histories: state before and after changes, change types, scores, roll-ups, pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW, DELETE, EDIT, NOTE, STATUS = 0, 1, 2, 3, 4


def timeline(key: str, *order: str) -> Window:
    return Window.partitionBy(key).orderBy(*order)


def next_known(value: Column, line: Window) -> Column:
    """The first non-null value among later rows."""
    return F.first(value, ignorenulls=True).over(line.rowsBetween(1, Window.unboundedFollowing))


def last_known(value: Column, line: Window) -> Column:
    """The last non-null value up to the row."""
    return F.last(value, ignorenulls=True).over(line.rowsBetween(Window.unboundedPreceding, 0))


def change_type(head: Column, body: Column, status: Column, line: Window) -> Column:
    """0 for a first version; 2 where text changed; 4 where status changed; else 3."""
    first = F.row_number().over(line) == 1
    changed = ~F.lag(head).over(line).eqNullSafe(head) | ~F.lag(body).over(line).eqNullSafe(body)
    return F.when(first, NEW).when(changed, EDIT).when(~F.lag(status).over(line).eqNullSafe(status), STATUS).otherwise(NOTE)


def earlier_changes(key: str, *order: str) -> Column:
    """On a key's newest row, how many rows came before it; -1 on the others."""
    newest = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return F.when(F.row_number().over(newest) == 1, F.count("*").over(Window.partitionBy(key)) - 1).otherwise(-1)


def points(change: Column) -> Column:
    """Points of a change: new 4, edit 2, else 1."""
    return F.when(change == NEW, 4).when(change == EDIT, 2).otherwise(1)


def rolled_up(changes: DataFrame, ref: str, when: str, user: str, note: str, change: str, tie: str) -> DataFrame:
    """For each bulk reference: its first change's time, user and note, and how many rows are new or changed."""
    at = F.struct(when, tie)
    return changes.groupBy(ref).agg(
        F.min(when).alias("first_time"), F.min_by(user, at).alias("first_user"), F.min_by(note, at).alias("first_note"),
        F.sum(F.when(F.col(change) == NEW, 1).otherwise(0)).alias("n_new"), F.sum(F.when(F.col(change) != NEW, 1).otherwise(0)).alias("n_changed"),
    )


def page(df: DataFrame, order: list, offset: int, size: int) -> DataFrame:
    """One page of the rows in an order; late lookups join it afterwards."""
    return df.orderBy(*order).offset(offset).limit(size)


def without(base: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return base.join(deleted.select(key).distinct(), key, "left_anti")


def with_deltas(base: DataFrame, deltas: DataFrame, key: str, count: str) -> DataFrame:
    """Counts with signed deltas added; keys at or below zero go."""
    return base.select(key, count).unionByName(deltas.select(key, count)).groupBy(key).agg(F.sum(count).alias(count)).where(F.col(count) > 0)


def upserted(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Base rows whose key isn't changed, and the changes."""
    return without(base, changes, key).unionByName(changes)
