"""Export of histories as text: versions from what changes recorded, and blocks of lines written entry by entry.

Every step keeps the rows of an entry as rows: windows run through them, and the writer sorts inside partitions, so an
entry with any number of versions is never one value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.sources import store
from glossa.sources.entries import version_line

CHANGE_OF_STATUS = 4
#: Changes of a partition, and so of a file.
PART_ROWS = 100_000


def parts_of(changes: int) -> int:
    """Partitions that hold so many changes; they grow in number and not in size."""
    return max(1, -(-changes // PART_ROWS))


def version_rows(changes: DataFrame, *order: str) -> DataFrame:
    """changes of entries as versions: version (from 0), head, target and status after the change, and whether the entry is shown.

    changes have entry_id, what the entry is now (head, target, status), and what each change recorded as the state before it
    (head_before, target_before, status_before, chg; empty texts and statuses of other kinds of change count as none). A
    version shows its entry where it is the first, the last, or differs in head or target from the one before.
    """
    newest = Window.partitionBy("entry_id").orderBy(*(F.desc(c) for c in order))
    later = newest.rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.when(F.col(c) != "", F.col(c))
    state = {"head": none("head_before"), "target": none("target_before"), "status": F.when(F.col("chg") == CHANGE_OF_STATUS, F.col("status_before"))}
    # the state after a change is what the next recorded change found
    known = changes.withColumns({k: F.coalesce(F.last(v, ignorenulls=True).over(later), F.col(k)) for k, v in state.items()} | {"__last": F.row_number().over(newest) == 1})
    oldest = Window.partitionBy("entry_id").orderBy(*order)
    same = F.lag("head").over(oldest).eqNullSafe(F.col("head")) & F.lag("target").over(oldest).eqNullSafe(F.col("target"))
    version = F.row_number().over(oldest) - 1
    return known.withColumns({"version": version, "shown": F.col("__last") | (version == 0) | ~same, "newest": F.col("__last")}).drop("__last", "head_before", "target_before", "status_before")


def block_lines(versions: DataFrame, code: Column, name: str = "user") -> DataFrame:
    """code, version, part, text: the lines of each entry's block: its code, and for each version its line and, if shown, the entry, commented but for the last."""
    body = F.concat_ws(" ", "head", "target")
    lines = F.array(
        F.when(F.col("version") == 0, F.concat(F.lit("# ID-"), code)), version_line(F.col("time"), F.col(name), F.col("status"), F.col("bulk_ref"), F.col("comment")),
        F.when(F.col("shown"), F.concat(F.when(F.col("newest"), "").otherwise("# "), body)), F.when(F.col("newest"), ""),
    )
    return versions.select(code.alias("code"), "version", F.posexplode(lines).alias("part", "text")).where("text IS NOT NULL")


def write_blocks(lines: DataFrame, folder: str, prologue: list[str], last_change=None, written_at=None, compression: str | None = "gzip", parts: int | None = None) -> bool:
    """Writes blocks as text files, each block whole in one of them, and the prologue as a file before them; says whether it did.

    Nothing is written where the files are newer than the last change. An empty line parts blocks. ``parts`` says how many files.
    """
    if written_at is not None and last_change is not None and written_at > last_change:
        return False
    options = {"compression": compression} if compression else {}
    spark = lines.sparkSession
    dealt = (lines.repartition(parts, "code") if parts else lines.repartition("code")).sortWithinPartitions("code", "version", "part").select("text")
    dealt.write.mode("overwrite").text(f"{folder}/blocks", **options)
    spark.createDataFrame([(t,) for t in prologue], "text string").coalesce(1).write.mode("overwrite").text(f"{folder}/a-prologue", **options)
    return True


def read_lines(spark, folder: str) -> DataFrame:
    """file, line (from 0), text of written blocks, in the order of each file."""
    rows = spark.read.text(f"{folder}/blocks").select(F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    return store.saved(rows, store.new_folder(spark, "lines"))
