"""Query logs as streams: files of JSON lines in, tab-separated lines out, and windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "time timestamp, country string, device string, lang string, script string, mode string, total_ms long, lookup_ms long, n_results long, query string"


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).json(path)


def line(mode: str = "mode"):
    """A record as the log shows it."""
    seconds = lambda c: F.concat((F.col(c) / 1000).cast("long").cast("string"), F.lit("."), F.lpad((F.col(c) % 1000).cast("string"), 3, "0"))
    flags = F.concat(F.coalesce("country", F.lit("--")), F.lit("-"), F.upper(F.concat(F.substring("device", 1, 1), F.substring("lang", 1, 1), F.substring("script", 1, 1))))
    return F.concat_ws("\t", F.date_format("time", "yyyy-MM-dd!HH:mm:ss"), flags, F.col(mode), seconds("total_ms"), seconds("lookup_ms"), F.col("n_results").cast("string"), F.regexp_replace("query", r"[\t\n]", " "))


def append_log(log: DataFrame, path: str, checkpoint: str, every: str = "500 milliseconds", once: bool = False) -> StreamingQuery:
    """Writes each batch's lines under its own number, so that a batch which is run again replaces what it wrote."""

    def write(batch: DataFrame, number: int) -> None:
        batch.select(line().alias("value")).write.mode("overwrite").text(f"{path}/batch={number}")

    writer = log.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def per_window(log: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Counts and mean times a window, country and mode; records later than the watermark are dropped."""
    return log.withWatermark("time", late).groupBy(F.window("time", window).alias("w"), "country", "mode").agg(F.count("*").alias("n"), F.avg("total_ms").alias("mean_ms"), F.sum((F.col("n_results") == 0).cast("long")).alias("n_empty"))


def user_sessions(log: DataFrame, user: str = "country", gap: str = "60 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions that end after a gap without a record."""
    return log.withWatermark("time", late).groupBy(F.session_window("time", gap).alias("w"), user).agg(F.count("*").alias("n"))


def distinct_queries(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first of equal queries of a country within the watermark; older state is dropped."""
    return log.withWatermark("time", late).dropDuplicatesWithinWatermark(["country", "query"])
