"""What several operators share: scratch tables in the shared folder, local bindings, connected components."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contract; words are the runs between.
SPACE = r"[\x20\x09-\x0D]+"


#: Bytes of an Arrow batch that Spark hands to a task, and characters of text that a task works on at a time.
BATCH_BYTES, SLICE = 4 << 20, 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. In a single JVM, as in tests, one of our own where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="glossa-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bounded(spark: SparkSession) -> None:
    """Limits Arrow batches to BATCH_BYTES, so that a task's Python process holds little at a time."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"([0-9]+)b?", spark.conf.get(key))
    if not now or int(now[1]) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def sliced(batches, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of batches with about SLICE bytes in a column of texts; a longer text is alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        lo = held = 0
        for i, size in enumerate(sizes.tolist()):
            if i > lo and held + size > SLICE:
                yield batch.slice(lo, i - lo)
                lo, held = i, 0
            held += size
        if batch.num_rows > lo:
            yield batch.slice(lo)


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def all_of(df: DataFrame) -> list[Column]:
    """The columns of a table, whatever their names."""
    return [F.col(quoted(c)) for c in df.columns]


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of the table has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


#: With this, the shuffle files of a query go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str) -> None:
    """Writes a table as Parquet; what was shuffled for it is deleted then, and doesn't wait for the driver to collect its garbage."""
    spark = df.sparkSession
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)


class Scratch:
    """Tables written to the shared folder, to cut lineage; a name is written once, or again after it was dropped."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, f"{shared_folder(spark)}/glossa-{uuid.uuid4().hex}"
        self.names: list[str] = []
        bounded(spark)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        written(df, f"{self.root}/{name}")
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def parts(self, name: str, saved: list[DataFrame]) -> DataFrame:
        """The tables that were saved as name/0, name/1, … as one; dropping name drops them all."""
        return self.spark.read.schema(saved[0].schema).parquet(*(f"{self.root}/{name}/{i}" for i in range(len(saved))))

    def last(self, df: DataFrame, name: str) -> DataFrame:
        """A table that needs none of the others once it is saved: they are dropped."""
        saved = self.save(df, name)
        for other in {x.split("/")[0] for x in self.names} - {name}:
            self.drop(other)
        return saved

    def drop(self, name: str) -> None:
        self.names = [x for x in self.names if x != name and not x.startswith(f"{name}/")]
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; plain columns may be computed again at each use in a lambda."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def components(scratch: Scratch, edges: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """(node, component): the smallest node that edges reach. Nodes without an edge have no row.

    Smallest labels pass along edges and then along their own labels, so a chain of n nodes takes about log n rounds.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = scratch.save(both.union(both.select("v", "u")).distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("component")), f"{name}-0")
    step = 0
    while True:
        near = both.join(labels, both.v == labels.node).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("seen"))
        low = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "seen").alias("low"))
        jump = labels.select(F.col("node").alias("low"), F.col("component").alias("deep"))
        nxt = low.join(jump, "low", "left").select("node", "was", F.least("low", F.coalesce("deep", "low")).alias("component"))
        step += 1
        nxt = scratch.save(nxt, f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
        labels = nxt.select("node", "component")
        if nxt.where("component <> was").isEmpty():
            return labels


#: Bits of a map of keys. Where it is full, tasks pass on more rows than are wanted; joins after it stay exact.
MAP_BITS = 1 << 22


def bit_map(keys: DataFrame, key: Column) -> DataFrame:
    """(at, bits): a map of MAP_BITS bits in which the bits of the keys are set, as MAP_BITS / 64 rows at most."""
    slot = keys.select(F.pmod(F.xxhash64(key), F.lit(MAP_BITS)).alias("s"))
    return slot.groupBy(F.shiftright("s", 6).cast("int").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(s, 64) AS int)))").alias("bits"))


def hits(df: DataFrame, known: DataFrame, key: Column, wanted: bool = True) -> DataFrame:
    """The rows of which the key's bit is set, among them all rows with a wanted key; or the other rows.

    The map has a bounded size, so it is broadcast.
    """
    slot, at, bits = unused(df, "slot", "at", "bits")
    met = df.withColumn(slot, F.pmod(F.xxhash64(key), F.lit(MAP_BITS)))
    met = met.join(F.broadcast(known.toDF(at, bits)), F.shiftright(F.col(slot), 6).cast("int") == F.col(at), "left")
    found = F.expr(f"coalesce(shiftright({bits}, cast(pmod({slot}, 64) AS int)) & 1L, 0L) = 1L")
    return met.where(found if wanted else ~found).select(*all_of(df))
