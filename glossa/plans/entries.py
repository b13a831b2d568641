"""Queries of the entry formats, on entries made from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.ids import code_of, djb2
from glossa.plans.catalog import query
from glossa.sources import entries as E
from glossa.sources.tables import table


@query("entry_parse", "SELECT p_partkey, replace(p_name, ' ', '') AS trad, '(' || p_type || ') ' AS domain, p_brand || '/x' AS equiv, ' (' || p_size || ' (cm))' AS note, true AS same FROM part")
def entry_parse(spark, d):
    """Entry lines of parts, parsed and written again."""
    head = F.replace("p_name", F.lit(" "), F.lit(""))
    line = F.concat(head, F.lit(" "), head, F.lit(" [xx] /("), "p_type", F.lit(") "), "p_brand", F.lit("\\x ("), F.col("p_size").cast("string"), F.lit(" (cm))/"))
    parsed = E.parse_lines(table(spark, d, "part").select("p_partkey", line.alias("text")))
    s = F.col("entry.senses")[0]
    return parsed.select("p_partkey", F.col("entry.trad").alias("trad"), s["domain"].alias("domain"), s["equiv"].alias("equiv"), s["note"].alias("note"), (E.written(F.col("entry")) == F.col("text")).alias("same"))


@query("block_versions", """SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS version, CAST(date_trunc('second', ts) AS TIMESTAMP) AS time, CAST(event_id % 3 AS INTEGER) AS status, CASE WHEN event_id % 5 = 0 THEN -1 ELSE CAST(event_id % 5 AS INTEGER) END AS bulk_ref, 'a\\b' || chr(10) || event_type AS comment, event_type AS line FROM events""")
def block_versions(spark, d):
    """Version blocks of each user's events, written and parsed again."""
    from pyspark.sql import Window

    line = Window.partitionBy("user_id").orderBy("ts", "event_id")
    events = table(spark, d, "events").select(
        code_of(F.col("user_id")).alias("code"), "user_id", (F.row_number().over(line) - 1).alias("version"), F.col("ts").cast("timestamp").alias("time"), F.lit("u").alias("user"),
        (F.col("event_id") % 3).cast("int").alias("status"), (F.col("event_id") % 5).cast("int").alias("bulk_ref"), F.concat(F.lit("a\\b\n"), "event_type").alias("comment"), F.col("event_type").alias("line"),
    )
    blocks = E.block_text(events.drop("user_id")).select(F.regexp_replace("block", "^# ID-", "").alias("block"))
    users = events.select("code", "user_id").distinct()
    return E.versions(blocks).join(users, "code").select("user_id", "version", F.col("time").cast("timestamp_ntz").alias("time"), "status", "bulk_ref", "comment", "line")


@query(
    "string_hash",
    """SELECT p_partkey, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS hash FROM (SELECT p_partkey, list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(p_name, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: (a * 33 + b) % 4294967296) AS h FROM part)""",
)
def string_hash(spark, d):
    return table(spark, d, "part").select("p_partkey", djb2(F.col("p_name")).alias("hash"))
