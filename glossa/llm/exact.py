"""Exact deduplication against a persistent index of digests, bucketed and sorted by digest.

The index is an external Parquet table: a digest, the row that stays, and the batch that brought it. A batch of new data is
reduced to its digests (counted in the map tasks, so a text that makes up a third of all rows is one row a task), met with
the index by a sort-merge anti-join, and what is left is appended. Both sides of that join are dealt by digest into the
index's buckets, so the index itself is never shuffled, however large it has grown.

What an index holds stays: a later batch never replaces the row kept for a text. Within a batch, of equal texts the row with
the largest id stays, of rows with that id the last one as they were read. Texts are compared after ``normal``, by
default unchanged; a null text is empty. A null id is below all others. Repeated rows are copies like any others. An empty
table gives no rows and leaves the index as it was. Texts of any length are hashed whole. Columns of the documents
other than the two named are of no concern, so none of their names can clash.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import Scratch, quoted, unused

#: Buckets of an index; a bucket of an index of 10^11 texts in 65,536 buckets holds 60 MB. Fixed once an index exists.
BUCKETS = 64
#: A text found at least this often in a million rows is met by a broadcast, of 10,000 texts at most; others by a shuffle.
HOT_PER_MILLION = 100


def digest_of(text: Column, normal: Callable[[Column], Column] = lambda t: t) -> Column:
    return F.unhex(F.sha2(normal(F.coalesce(text, F.lit(""))), 256))


class DigestIndex:
    """An index in a folder that driver and executors share; opened again, it holds what earlier sessions appended."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, normal: Callable[[Column], Column] = lambda t: t):
        self.spark, self.buckets, self.normal = spark, buckets, normal
        self.path, self.name = f"{folder.rstrip('/')}/digests-{buckets}", f"digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{self.path}'"
        )

    def table(self) -> DataFrame:
        """digest, keep_id, keep_row, batch."""
        return self.spark.table(self.name)

    def digests(self, docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
        """id, row, digest of every document, where row numbers the documents as they were read; save it before it is added."""
        return docs.select(F.col(quoted(ident)).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), digest_of(F.col(quoted(text)), self.normal).alias("digest"))

    def add(self, digests: DataFrame, batch: str | None = None) -> str:
        """Appends the texts of a batch (a saved table of ``digests``) that the index lacks; gives the batch's name.

        Added again, after a driver was lost for example, a batch finds its texts in the index and appends nothing.
        """
        batch = batch or uuid.uuid4().hex
        best = F.max(F.struct(F.col("id"), F.col("row")))
        new = digests.groupBy("digest").agg(best.alias("best")).select("digest", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"), F.lit(batch).alias("batch"))
        # dealt like the index, so that only this side of the join is shuffled
        dealt = new.repartition(self.buckets, "digest")
        self._append(dealt.join(self.table().select("digest").hint("merge"), "digest", "left_anti"))
        return batch

    def _append(self, rows: DataFrame) -> None:
        """Writes rows with one file a bucket, whatever number of partitions the session deals them to."""
        dealt = rows.repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
        dealt.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        self.spark.catalog.refreshTable(self.name)

    def compact(self) -> "DigestIndex":
        """An index of its own folder, with one sorted file a bucket, holding the same rows; use it once it is complete."""
        other = DigestIndex(self.spark, f"{self.path}-{uuid.uuid4().hex}", self.buckets, self.normal)
        other._append(self.table())
        return other


def verdicts(index: DigestIndex, digests: DataFrame, batch: Column) -> DataFrame:
    """id, row, digest, keep_id, kept, group_size of documents already added, in batches named by a column expression of ``digests``.

    group_size counts equal texts among the given documents. Texts that are hot are met by a broadcast of 10,000 rows at most:
    no more texts can reach their share.
    """
    sizes = digests.groupBy("digest").agg(F.count("*").alias("group_size"))
    known = sizes.join(index.table().hint("merge"), "digest")
    hot = (F.col("group_size") * 1_000_000 >= digests.count() * HOT_PER_MILLION) & (F.col("group_size") > 1)
    many = F.broadcast(known.where(hot))
    split = digests.withColumn("of", batch).join(many, "digest", "left")
    mine = (F.col("row") == F.col("keep_row")) & (F.col("of") == F.col("batch"))
    done = split.where("keep_row IS NOT NULL")
    rest = split.where("keep_row IS NULL").select("digest", "id", "row", "of").join(known.where(~hot), "digest")
    return done.unionByName(rest.select(*done.columns)).select("id", "row", "digest", "keep_id", F.coalesce(mine, F.lit(False)).alias("kept"), "group_size")


def dedup(docs: DataFrame, ident: str = "doc_id", text: str = "text", batches: int = 2, folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: every document against an index that takes them from large ids to small.

    Documents enter in ``batches`` ranges of ids, the range of the largest first, so that the row kept for a text is the one
    with the largest id of all.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    index = DigestIndex(spark, folder or f"{scratch.root}/index")
    saved = scratch.save(index.digests(docs, ident, text), "digests")
    lo, hi = saved.agg(F.min("id"), F.max("id")).first()
    lo, hi = (0, 0) if hi is None else (lo, hi)
    at = F.floor((hi - F.coalesce("id", F.lit(lo)).cast("decimal(20,0)")) * batches / (hi - lo + 1)).cast("int")
    # a null id is below all others, so it waits for the last range
    at = F.when(F.col("id").isNull(), batches - 1).otherwise(at)
    run = uuid.uuid4().hex
    name = F.concat(F.lit(f"{run}-"), at.cast("string"))
    for i in range(batches):
        index.add(saved.where(at == i), f"{run}-{i}")
    out = verdicts(index, saved, name)
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def keep_one(docs: DataFrame, index: DigestIndex, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents of a batch whose text the index lacked, one of each text, columns as they came; the batch is in the index after."""
    scratch = Scratch(docs.sparkSession)
    saved = scratch.save(index.digests(docs, ident, text), "digests")
    batch = index.add(saved)
    digest, keep = unused(docs, "digest", "keep")
    fresh = index.table().where(F.col("batch") == batch).select(F.col("digest").alias(digest), F.col("keep_id").alias(keep))
    key = digest_of(F.col(quoted(text)), index.normal)
    met = docs.join(fresh, (key == F.col(digest)) & F.col(quoted(ident)).cast("long").eqNullSafe(F.col(keep)), "left_semi")
    # rows that repeat both id and text pass together
    repeated = saved.groupBy("digest", "id").count().where("count > 1")
    return met if repeated.isEmpty() else met.dropDuplicates([ident, text])
