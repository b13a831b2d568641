"""Edits of a dictionary with their history, in batches: a batch of requests meets the table of entries.

Entries have entry_id, head, target and status (0 neutral, 1 approved, 2 flagged). What a batch does comes back as tables:
changes to append to the history, and the entries as they are afterwards. The tables given are left as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.operators.history import EDIT, NEW, NOTE, STATUS
from glossa.operators.tokens import ranked

#: What status a request asks for.
ASKED = {"approve": 1, "flag": 2, "unflag": 0}
APPROVAL_SCORE = 100
#: Numbers that have a code.
CODES = 52**4 * 10**3


def _folded(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """Entries with requests, and the state and changes after them, request by request in the order of req_id.

    An entry's requests are few beside the table, so they are folded inside its row.
    """
    asked = requests.groupBy("entry_id").agg(F.array_sort(F.collect_list(F.struct("req_id", "kind", "text", "user_id"))).alias("asked"))
    change = "array<struct<req_id:bigint,user_id:bigint,chg:int,trg_before:string,status_before:int,accepted:boolean>>"
    begin = F.struct("target", F.col("status").cast("int").alias("status"), F.array().cast(change).alias("out"))

    def step(acc, r):
        wanted = F.lit(None).cast("int")
        for kind, status in ASKED.items():
            wanted = F.when(r["kind"] == kind, F.lit(status)).otherwise(wanted)
        legal = F.when(r["kind"] == "unflag", acc["status"] == 2).when(wanted.isNotNull(), acc["status"] != wanted).when(r["kind"] == "target", r["text"] != acc["target"]).otherwise(F.lit(True))
        edit, status = r["kind"] == "target", wanted.isNotNull()
        row = F.struct(
            r["req_id"].alias("req_id"), r["user_id"].alias("user_id"), F.when(edit, EDIT).when(status, STATUS).otherwise(NOTE).alias("chg"), F.when(edit & legal, acc["target"]).otherwise("").alias("trg_before"),
            F.when(status & legal, acc["status"]).otherwise(99).alias("status_before"), legal.alias("accepted"),
        )
        return F.struct(F.when(edit & legal, r["text"]).otherwise(acc["target"]).alias("target"), F.when(status & legal, wanted).otherwise(acc["status"]).alias("status"), F.concat(acc["out"], F.array(row)).alias("out"))

    return entries.join(asked, "entry_id").withColumn("after", F.aggregate("asked", begin, step))


def changes(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """entry_id, req_id, user_id, chg, trg_before, status_before, accepted for each request (req_id, entry_id, user_id, kind, text).

    Kinds: target (a new text), comment, approve, flag, unflag. What an entry's status doesn't allow, and a text that
    changes nothing, is refused. Requests for entries that aren't there have no row.
    """
    return _folded(entries, requests).select("entry_id", F.explode("after.out").alias("c")).select("entry_id", "c.*")


def edited(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """The entries after the requests."""
    touched = _folded(entries, requests).select("entry_id", "head", F.col("after.target").alias("target"), F.col("after.status").alias("status"))
    return entries.join(requests.select("entry_id").distinct(), "entry_id", "left_anti").select("entry_id", "head", "target", F.col("status").cast("int").alias("status")).unionByName(touched)


def head_changes(entries: DataFrame, requests: DataFrame) -> DataFrame:
    """req_id, entry_id, hw_before, head, accepted: a new head is refused where an entry has it, or an earlier request asks for it."""
    first = requests.groupBy("head").agg(F.min("req_id").alias("first"))
    taken = entries.select("head", F.lit(True).alias("taken")).distinct()
    met = requests.join(entries.select("entry_id", F.col("head").alias("hw_before")), "entry_id").join(first, "head").join(taken, "head", "left")
    return met.select("req_id", "entry_id", "hw_before", "head", (F.col("taken").isNull() & (F.col("req_id") == F.col("first"))).alias("accepted"))


def added(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """entry_id, req_id, head, target of the rows (req_id, head, target) whose head is new, the first of each; ids follow the largest one."""
    first = rows.groupBy("head").agg(F.min_by(F.struct("req_id", "target"), "req_id").alias("r")).select("head", "r.*")
    new = ranked(first.join(entries.select("head"), "head", "left_anti"), "req_id")
    top = F.broadcast(entries.agg(F.coalesce(F.max("entry_id"), F.lit(0)).alias("top")))  # one row
    return new.join(top).select((F.col("top") + F.col("rank")).cast("long").alias("entry_id"), "req_id", "head", "target")


def bulk_changes(new: DataFrame, ref: int, user_id: int, note: str) -> DataFrame:
    """entry_id, parent, bulk_ref, user_id, note, chg, n_new: one row for a bulk change (without an entry), and one for each entry that it adds."""
    parent = new.agg(F.count("*").alias("n_new")).select(F.lit(None).cast("long").alias("entry_id"), F.lit(True).alias("parent"), F.lit(ref).alias("bulk_ref"), F.lit(user_id).alias("user_id"), F.lit(note).alias("note"), F.lit(99).alias("chg"), "n_new")
    each = new.select("entry_id", F.lit(False).alias("parent"), F.lit(ref).alias("bulk_ref"), F.lit(user_id).alias("user_id"), F.lit("").alias("note"), F.lit(NEW).alias("chg"), F.lit(-1).cast("long").alias("n_new"))
    return parent.unionByName(each)


def reserved(entries: DataFrame, rows: DataFrame, key: Column, space: int = CODES) -> DataFrame:
    """rows with an ``entry_id`` that neither an entry nor another row has."""
    from glossa.operators.numbers import unique_numbers

    return unique_numbers(rows, key, space, entries.select(F.col("entry_id").alias("number")), "entry_id")


def stored(entries: DataFrame, rows: DataFrame) -> DataFrame:
    """entries with rows appended; an id that is taken is an error when it is read."""
    taken = entries.select("entry_id", F.lit(True).alias("taken"))
    checked = rows.join(taken, "entry_id", "left").withColumn("entry_id", F.when(F.col("taken"), F.raise_error(F.concat(F.lit("taken: "), F.col("entry_id").cast("string")))).otherwise(F.col("entry_id")))
    return entries.unionByName(checked.drop("taken"))


def approvers(scores: DataFrame, least: int = APPROVAL_SCORE) -> DataFrame:
    """user_id, may_approve by score."""
    return scores.select("user_id", (F.col("score") >= least).alias("may_approve"))


def cleansed_versions(versions: DataFrame, when: str, user: str, ref: int, note: str) -> DataFrame:
    """Versions (code, version, time, user, status, bulk_ref, comment, line) with one more where cleansing changes an entry's last line."""
    from glossa.functions.corpus import cleansed

    last = versions.withColumn("place", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("version")))).where("place = 1").drop("place").withColumn("new", cleansed(F.col("line")))
    more = last.where("new <> line").select("code", (F.col("version") + 1).alias("version"), F.lit(when).cast("timestamp").alias("time"), F.lit(user).alias("user"), "status", F.lit(ref).alias("bulk_ref"), F.lit(note).alias("comment"), F.col("new").alias("line"))
    return versions.unionByName(more.select(*versions.columns))


def prepared(lines: DataFrame, when: str, user: str, note: str, mark: str | None = "(u.E.)", lower_pinyin: bool = False, taken: DataFrame | None = None, space: int = CODES) -> DataFrame:
    """The first version (version, time, user, …) of each entry line with a headword of at most 16 characters.

    Codes follow from a hash of the line, and are found again where they clash with each other or with those in use (taken
    has number); every line keeps an entry of its own. Entries with the mark in a sense aren't verified.
    """
    from glossa.functions.ids import code_of
    from glossa.operators.numbers import unique_numbers
    from glossa.sources.entries import parse_lines, written

    text = F.col("text")
    if lower_pinyin:
        text = F.concat(F.regexp_extract(text, r"^([^\[]*)", 1), F.lower(F.regexp_extract(text, r"(\[[^\]]*\])", 1)), F.regexp_extract(text, r"^[^\]]*\](.*)$", 1))
    parsed = parse_lines(lines.withColumn("text", text)).where("entry IS NOT NULL").where(F.length("entry.simp") <= 16)
    status = F.when(F.contains("text", F.lit(mark)), 0).otherwise(1) if mark else F.lit(1)
    kept = parsed.select(F.col("text").alias("__text"), status.alias("status"), written(F.col("entry")).alias("line"))
    coded = unique_numbers(kept, F.col("__text"), space, taken)
    return coded.select(code_of(F.col("number")).alias("code"), F.lit(0).alias("version"), F.lit(when).cast("timestamp").alias("time"), F.lit(user).alias("user"), "status", F.lit(1).alias("bulk_ref"), F.lit(note).alias("comment"), "line")
