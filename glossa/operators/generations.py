"""Posting tables kept in a folder: buckets of terms, batches as generations with tombstones, compaction of single buckets.

A batch is written once, as Parquet folders ``gen=<g>/bucket=<b>`` with rows sorted by term, and beside it the keys that it
takes out. A row is alive unless a later generation took its key out, so a batch that files a key again replaces what it
had. Look-ups open the buckets of their terms and no other, and push the terms down to the row groups. Compaction rewrites the
buckets that hold many generations; other buckets keep their files.

Which folders count is said by a small table of versions: a batch or a compaction is in force once its version is written,
so one that was broken off leaves nothing behind but unread folders. A version has a row for each bucket and
generation, so it is as bounded as the number of buckets. Batches are added by one writer at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.sources import store

VERSION = "gen long, kind string, bucket int, rows long, folder string"
#: Rows of a file; a bucket with more is cut by key, so that a term that every text holds is no single task.
FILE_ROWS = 1_000_000


class Generations:
    """Posting rows of a schema with columns ``term`` and ``key``; others are carried along."""

    def __init__(self, spark: SparkSession, folder: str, columns: str, buckets: int = 64):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self.columns = columns
        self.schema = spark.createDataFrame([], f"{columns}, gen long").schema
        self.names = [f.name for f in self.schema.fields]
        self.key_type = self.schema["key"].dataType.simpleString()

    # versions

    def _number(self) -> int:
        """The last version that was written whole."""
        at = getattr(self, "_last", 0)
        while store.exists(self.spark, f"{self.folder}/versions/{at + 1}/_SUCCESS"):
            at += 1
        self._last = at
        return at

    def version(self) -> list:
        """Rows (gen, kind, bucket, rows, folder) of the present version."""
        n = self._number()
        return self.spark.read.schema(VERSION).parquet(f"{self.folder}/versions/{n}").collect() if n else []

    def _commit(self, rows: list[tuple]) -> None:
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/versions/{self._number() + 1}")

    # writing

    def bucket_of(self, term: Column) -> Column:
        # a checksum that tasks outside the JVM have too
        return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(self.buckets)).cast("int")

    def _write(self, rows: DataFrame, gen: int, most: int, unpack=None) -> list[tuple]:
        """Writes live rows as one generation, of which no term has more than ``most``; its rows of the version.

        With ``unpack``, rows are (bucket, key, packed) with all that a key files in a bucket, and unpack makes posting rows of
        them after they were dealt; so a key is shuffled once for each bucket and not for each term.
        """
        part = F.pmod(F.xxhash64("key"), F.lit(-(-most // FILE_ROWS) or 1))
        bucket = self.bucket_of(F.col("term"))
        # what rows are dealt by isn't shuffled with them
        dealt = unpack(rows.repartition("bucket", part)) if unpack else rows.select(*(c for c in self.names if c != "gen")).repartition(bucket, part)
        placed = dealt.select(*(c for c in self.names if c != "gen"), F.lit(gen).cast("long").alias("gen"), bucket.alias("bucket")).sortWithinPartitions("bucket", "term", "key")
        at = f"{self.folder}/gen={gen}"
        placed.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(at)
        written = self.spark.read.schema(f"{self.columns}, gen long, bucket int").parquet(at) if most else None
        counts = written.groupBy("bucket").agg(F.count("*").alias("n")).collect() if most else []  # a row for each bucket, from the footers
        return [(gen, "rows", r["bucket"], r["n"], f"{at}/bucket={r['bucket']}") for r in counts]

    def add(self, rows: DataFrame, most: int, keys: DataFrame | None = None, unpack=None) -> int:
        """Files rows, or packed rows and how to unpack them, as a new generation; ``keys`` (key) are taken out of older ones first.

        ``most`` bounds the rows of one term, such as the number of texts; it sets how many files a bucket is cut into.
        """
        now = self.version()
        gen = max((r["gen"] for r in now), default=0) + 1
        new = [tuple(r) for r in now] + (self._write(rows, gen, most, unpack) if most else [])
        if keys is not None:
            at = f"{self.folder}/gone={gen}"
            keys.select(F.col("key").cast(self.key_type).alias("key"), F.lit(gen).cast("long").alias("gone")).distinct().write.mode("overwrite").parquet(at)
            new.append((gen, "gone", -1, 0, at))
        if any(r[0] == gen for r in new):
            self._commit(new)
        return gen

    def remove(self, keys: DataFrame) -> int:
        return self.add(self.spark.createDataFrame([], self.schema), 0, keys)

    # reading

    def _open(self, version: list, buckets: set[int] | None) -> DataFrame:
        folders = [r["folder"] for r in version if r["kind"] == "rows" and (buckets is None or r["bucket"] in buckets)]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    def _alive(self, rows: DataFrame, version: list) -> DataFrame:
        gone = [r["folder"] for r in version if r["kind"] == "gone"]
        if not gone:
            return rows
        last = self.spark.read.schema(f"key {self.key_type}, gone long").parquet(*gone).groupBy("key").agg(F.max("gone").alias("gone"))
        return rows.join(last, "key", "left").where("gone IS NULL OR gone <= gen").drop("gone").select(*self.names)

    def rows(self, terms: list[str] | None = None) -> DataFrame:
        """Live rows, of some terms or of all, with the generation that filed them."""
        version = self.version()
        if terms is None:
            return self._alive(self._open(version, None), version)
        if not terms:
            return self.spark.createDataFrame([], self.schema)
        wanted = self.spark.createDataFrame([(t,) for t in sorted(set(terms))], "term string").select(self.bucket_of(F.col("term")).alias("b")).distinct()
        found = self._open(version, {r["b"] for r in wanted.collect()}).where(F.col("term").isin(*set(terms)))
        return self._alive(found, version)

    # compaction

    def compact(self, most: int = 4) -> set[int]:
        """Rewrites the buckets that hold rows of over ``most`` generations as one; the others keep their files. Gives those rewritten.

        Tombstones that no older row is left for are dropped. Folders that no version needs any more stay until ``vacuum``.
        """
        now = self.version()
        held: dict[int, int] = {}
        for r in now:
            if r["kind"] == "rows":
                held[r["bucket"]] = held.get(r["bucket"], 0) + 1
        touched = {b for b, n in held.items() if n > most}
        if not touched:
            return touched
        gen = max(r["gen"] for r in now) + 1
        kept = [r for r in now if not (r["kind"] == "rows" and r["bucket"] in touched)]
        size = max(sum(r["rows"] for r in now if r["bucket"] == b) for b in touched)
        new = [tuple(r) for r in kept] + self._write(self._alive(self._open(now, touched), now), gen, size)
        oldest = min((r[0] for r in new if r[1] == "rows"), default=gen)
        self._commit([r for r in new if r[1] == "rows" or r[0] > oldest])
        return touched

    def vacuum(self) -> None:
        """Deletes folders and versions that the present version doesn't need; not while look-ups of older ones run."""
        last = self._number()
        needed = {r["folder"] for r in self.version()}
        for n in range(1, last):
            old = f"{self.folder}/versions/{n}"
            if store.exists(self.spark, old):
                for r in self.spark.read.schema(VERSION).parquet(old).collect():
                    if r["folder"] not in needed:
                        store.remove(self.spark, r["folder"])
        # versions are counted from the first, so their marks stay

