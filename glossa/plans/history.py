"""Queries on histories, tables and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from glossa.operators import export as X
from glossa.operators import history as H
from glossa.operators import ranges as R
from glossa.operators.tokens import ranked
from glossa.plans.catalog import query
from glossa.sources.store import new_folder
from glossa.sources.tables import table


def _line():
    return H.timeline("user_id", "ts", "event_id")


O = "OVER (PARTITION BY user_id ORDER BY ts, event_id"


@query("version_backfill", f"SELECT event_id, user_id, coalesce(first_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) {O} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS value_before FROM events")
def version_backfill(spark, d):
    """The next recorded value of the user's line, or the current one (-1 here) where none follows."""
    recorded = F.when(F.col("event_type") == "click", F.col("value"))
    return table(spark, d, "events").select("event_id", "user_id", F.coalesce(H.next_known(recorded, _line()), F.lit(-1.0)).alias("value_before"))


@query("version_forward_fill", f"SELECT event_id, user_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) {O} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS value_now FROM events")
def version_forward_fill(spark, d):
    recorded = F.when(F.col("event_type") == "view", F.col("value"))
    return table(spark, d, "events").select("event_id", "user_id", H.last_known(recorded, _line()).alias("value_now"))


TYPES = f"""c AS (SELECT *, CASE WHEN row_number() {O}) = 1 THEN 0 WHEN lag(event_type) {O}) IS DISTINCT FROM event_type THEN 2 WHEN lag(floor(value)) {O}) IS DISTINCT FROM floor(value) THEN 4 ELSE 3 END AS change FROM events)"""


def _changes(spark, d):
    events = table(spark, d, "events")
    return events.withColumn("change", H.change_type(F.col("event_type"), F.col("event_type"), F.floor("value"), _line()))


@query("change_type", f"WITH {TYPES} SELECT event_id, user_id, CAST(change AS INTEGER) AS change FROM c")
def change_type(spark, d):
    return _changes(spark, d).select("event_id", "user_id", "change")


@query("prev_change_count", "SELECT event_id, user_id, CAST(CASE WHEN row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1 THEN count(*) OVER (PARTITION BY user_id) - 1 ELSE -1 END AS BIGINT) AS earlier FROM events")
def prev_change_count(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", H.earlier_changes("user_id", "ts", "event_id").cast("long").alias("earlier"))


@query("contrib_score", f"WITH {TYPES} SELECT user_id, CAST(sum(CASE WHEN change = 0 THEN 4 WHEN change = 2 THEN 2 ELSE 1 END) AS BIGINT) AS score FROM c GROUP BY user_id")
def contrib_score(spark, d):
    return _changes(spark, d).groupBy("user_id").agg(F.sum(H.points(F.col("change"))).alias("score"))


@query("bulk_rollup", f"""WITH {TYPES} SELECT event_id // 100 AS bulk_ref, min(ts) AS first_time, arg_min(user_id, struct_pack(a := ts, b := event_id)) AS first_user, arg_min(event_type, struct_pack(a := ts, b := event_id)) AS first_note,
CAST(sum(CASE WHEN change = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_new, CAST(sum(CASE WHEN change <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_changed FROM c GROUP BY 1""")
def bulk_rollup(spark, d):
    changes = _changes(spark, d).withColumn("bulk_ref", F.expr("event_id div 100"))
    return H.rolled_up(changes, "bulk_ref", "ts", "user_id", "event_type", "change", "event_id")


@query("history_page", """WITH p AS (SELECT o_orderkey, o_custkey, o_orderdate FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 100)
SELECT o_orderkey, o_orderdate, c_name, n_name FROM p LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def history_page(spark, d):
    """A page of changes, newest first; names are looked up for the page's rows only."""
    orders = table(spark, d, "orders").where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey", "o_orderdate")
    page = H.page(orders, [F.desc("o_orderdate"), "o_orderkey"], 100, 50)
    customer, nation = table(spark, d, "customer"), table(spark, d, "nation")
    named = page.join(customer, page["o_custkey"] == customer["c_custkey"], "left").join(nation, customer["c_nationkey"] == nation["n_nationkey"], "left")
    return named.select("o_orderkey", "o_orderdate", "c_name", "n_name")


@query("entry_changes", "SELECT c_custkey, c_name, o_orderkey, o_orderdate, n_name FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey")
def entry_changes(spark, d):
    """Changes with their entry and user, newest first."""
    customer, orders, nation = (table(spark, d, t) for t in ("customer", "orders", "nation"))
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).join(nation, customer["c_nationkey"] == nation["n_nationkey"]).select("c_custkey", "c_name", "o_orderkey", "o_orderdate", "n_name").orderBy(F.desc("o_orderdate"), "o_orderkey")


@query("entry_pages", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS newest, string_agg(CAST(o_orderkey AS VARCHAR), ' ' ORDER BY o_orderdate DESC, o_orderkey) AS history FROM orders GROUP BY o_custkey")
def entry_pages(spark, d):
    """For each entry its history in one row, newest first: what an export or an edit page reads, entry by entry."""
    orders = table(spark, d, "orders")
    row = F.struct((-F.unix_micros(F.col("o_orderdate").cast("timestamp"))).alias("at"), "o_orderkey")
    grouped = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_orderdate").alias("newest"), F.array_sort(F.collect_list(row)).alias("rows"))
    return grouped.select("o_custkey", "n", "newest", F.array_join(F.transform("rows", lambda r: r["o_orderkey"].cast("string")), " ").alias("history"))


EXPORT = r"""c AS (SELECT o_custkey AS e, o_orderkey AS id, o_orderdate AS t, c_name, c_mktsegment, c_custkey % 3 AS now, CASE WHEN o_orderkey % 4 = 0 THEN 'old ' || o_orderkey END AS hb, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority END AS tb,
CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 3 END AS sb, o_orderstatus || '\' || chr(10) || o_orderpriority AS note FROM orders JOIN customer ON c_custkey = o_custkey),
v AS (SELECT *, row_number() OVER (PARTITION BY e ORDER BY t, id) - 1 AS version, row_number() OVER w = 1 AS newest, coalesce(last_value(hb IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_name) AS head,
coalesce(last_value(tb IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), c_mktsegment) AS target, coalesce(last_value(sb IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), now) AS status FROM c WINDOW w AS (PARTITION BY e ORDER BY t DESC, id DESC)),
s AS (SELECT *, newest OR version = 0 OR head <> lag(head) OVER u OR target <> lag(target) OVER u AS shown FROM v WINDOW u AS (PARTITION BY e ORDER BY version)),
l AS (SELECT e, version, 0 AS part, '# ID-' || lpad(CAST(e AS VARCHAR), 9, '0') AS text FROM s WHERE version = 0
UNION ALL SELECT e, version, 1, '# Ver ' || strftime(t, '%Y-%m-%dT%H:%M:%SZ') || ' u' || id % 7 || ' Stat-' || ['New', 'Verif', 'Flagged'][status + 1] || ' ' || lpad(CAST(id % 4 AS VARCHAR), 3, '0') || '>' || replace(replace(note, '\', '\\'), chr(10), '\n') FROM s
UNION ALL SELECT e, version, 2, CASE WHEN newest THEN '' ELSE '# ' END || head || ' ' || target FROM s WHERE shown UNION ALL SELECT e, version, 3, '' FROM s WHERE newest)"""


@query("export_blocks", f"WITH {EXPORT} SELECT e AS entry_id, row_number() OVER (PARTITION BY e ORDER BY version, part) AS line, text FROM l")
def export_blocks(spark, d):
    """The files of an export, read back: each customer's orders as the versions of an entry, numbered line by line."""
    key, when = F.col("o_orderkey"), lambda n, v: F.when(F.col("o_orderkey") % n == 0, v)
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("head"), F.col("c_mktsegment").alias("target"), (F.col("c_custkey") % 3).cast("int").alias("status"))
    orders = table(spark, d, "orders")
    # all steps are dealt to as many partitions as the changes need, so that a task's share doesn't grow with them
    parts = X.parts_of(orders.count())
    changes = orders.select(
        F.col("o_custkey").alias("entry_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("time"), F.concat(F.lit("u"), (key % 7).cast("string")).alias("user"), (key % 4).cast("int").alias("bulk_ref"),
        F.concat("o_orderstatus", F.lit("\\\n"), "o_orderpriority").alias("comment"), when(4, F.concat(F.lit("old "), key.cast("string"))).alias("head_before"), when(3, F.col("o_orderpriority")).alias("target_before"),
        (key % 3).cast("int").alias("status_before"), when(5, 4).otherwise(2).alias("chg"),
    ).repartition(parts, "entry_id").join(customer.repartition(parts, "entry_id"), "entry_id")
    folder = new_folder(spark, "export")
    lines = X.block_lines(X.version_rows(changes, "time", "id"), F.lpad(F.col("entry_id").cast("string"), 9, "0"))
    X.write_blocks(lines, folder, ["# an export"], parts=parts)
    rows = X.read_lines(spark, folder).repartition(parts, "file")
    # a block stays together, so lines belong to the last code before them
    code = F.last(F.when(F.startswith("text", F.lit("# ID-")), F.substring("text", 6, 9).cast("long")), ignorenulls=True).over(Window.partitionBy("file").orderBy("at"))
    numbered = rows.withColumn("entry_id", code).select("entry_id", "at", "text").repartition(parts, "entry_id")
    return numbered.select("entry_id", F.row_number().over(Window.partitionBy("entry_id").orderBy("at")).cast("long").alias("line"), "text")


@query("full_history", "SELECT o_orderkey, l_linenumber, l_partkey, o_orderdate, l_shipdate FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def full_history(spark, d):
    """All changes, ordered by entry."""
    orders, lines = table(spark, d, "orders"), table(spark, d, "lineitem")
    return orders.join(lines, orders["o_orderkey"] == lines["l_orderkey"]).select("o_orderkey", "l_linenumber", "l_partkey", "o_orderdate", "l_shipdate").orderBy("o_orderkey", "l_linenumber")


@query("latest_change", "SELECT max(ts) AS latest FROM events")
def latest_change(spark, d):
    return table(spark, d, "events").agg(F.max("ts").alias("latest"))


@query("change_count", "SELECT count(*) AS n FROM events WHERE event_type <> 'view'")
def change_count(spark, d):
    return table(spark, d, "events").where("event_type <> 'view'").agg(F.count("*").alias("n"))


@query("head_count", "SELECT p_name AS head, count(*) AS n FROM part GROUP BY p_name")
def head_count(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_name").alias("head")).agg(F.count("*").alias("n"))


@query("duplicate_heads", "SELECT lower(p_name) AS head, count(*) AS n, min(p_partkey) AS first_key FROM part GROUP BY 1 HAVING count(*) > 1")
def duplicate_heads(spark, d):
    return table(spark, d, "part").groupBy(F.lower("p_name").alias("head")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_key")).where("n > 1")


@query("next_ref", "SELECT CAST(coalesce(max(event_id) + 1, 1) AS BIGINT) AS next_ref FROM events WHERE event_type = 'never'")
def next_ref(spark, d):
    return table(spark, d, "events").where("event_type = 'never'").agg(F.coalesce(F.max("event_id") + 1, F.lit(1)).cast("long").alias("next_ref"))


@query("point_lookup", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 77")
def point_lookup(spark, d):
    return table(spark, d, "orders").where("o_orderkey = 77").select("o_orderkey", "o_custkey", "o_orderstatus")


@query("in_list_fetch", "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey IN (1, 3, 5, 7, 11, 13, 17, 19, 23, 29)")
def in_list_fetch(spark, d):
    return table(spark, d, "part").where(F.col("p_partkey").isin(1, 3, 5, 7, 11, 13, 17, 19, 23, 29)).select("p_partkey", "p_name", "p_brand")


DELTA = "d AS (SELECT l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN -1 ELSE 0 END AS BIGINT) AS n FROM lineitem UNION ALL SELECT p_partkey, CAST(8 AS BIGINT) FROM part)"


@query("upsert_counts", f"WITH {DELTA} SELECT l_partkey AS partkey, CAST(sum(n) AS BIGINT) AS n FROM d GROUP BY 1 HAVING sum(n) > 0")
def upsert_counts(spark, d):
    base = table(spark, d, "part").select(F.col("p_partkey").alias("partkey"), F.lit(8).cast("long").alias("n"))
    deltas = table(spark, d, "lineitem").select(F.col("l_partkey").alias("partkey"), F.when(F.col("l_returnflag") == "R", -1).otherwise(0).cast("long").alias("n"))
    return H.with_deltas(base, deltas, "partkey", "n")


@query("anti_delete", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def anti_delete(spark, d):
    gone = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return H.without(table(spark, d, "orders").select("o_orderkey", "o_custkey"), gone, "o_orderkey")


@query("rewrite_changed", "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN upper(c_name) ELSE c_name END AS c_name FROM customer")
def rewrite_changed(spark, d):
    """An update as a rewrite: rows of changed keys replaced, the rest as they were."""
    base = table(spark, d, "customer").select("c_custkey", "c_name")
    changes = base.where("c_custkey % 7 = 0").withColumn("c_name", F.upper("c_name"))
    return H.upserted(base, changes, "c_custkey")


@query("user_ranking", "SELECT user_id, CAST(round(sum(value)) AS BIGINT) AS score, min(event_id) AS first_event FROM events GROUP BY user_id ORDER BY score DESC, first_event LIMIT 20")
def user_ranking(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value")).cast("long").alias("score"), F.min("event_id").alias("first_event")).orderBy(F.desc("score"), "first_event").limit(20)


@query("page_numbers", "SELECT user_id, count(*) AS n, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM events GROUP BY user_id")
def page_numbers(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count("*").alias("n")).withColumn("pages", F.ceil(F.col("n") / 50.0).cast("long"))


@query("log_line", """SELECT event_id, strftime(ts, '%Y-%m-%d!%H:%M:%S') || chr(9) || 'HU-' || upper(left(event_type, 3)) || chr(9) || lpad(CAST(event_id % 60000 // 1000 AS VARCHAR), 2, '0') || '.' || lpad(CAST(event_id % 1000 AS VARCHAR), 3, '0') || chr(9) || user_id AS line FROM events""")
def log_line(spark, d):
    seconds = F.concat(F.lpad(F.expr("event_id % 60000 div 1000").cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("event_id") % 1000).cast("string"), 3, "0"))
    parts = [F.date_format("ts", "yyyy-MM-dd!HH:mm:ss"), F.concat(F.lit("HU-"), F.upper(F.substring("event_type", 1, 3))), seconds, F.col("user_id").cast("string")]
    return table(spark, d, "events").select("event_id", F.concat_ws("\t", *parts).alias("line"))


@query("sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 60 MINUTE THEN 1 ELSE 0 END AS s FROM events),
i AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM g) SELECT user_id, min(ts) AS first_ts, max(ts) AS last_ts, count(*) AS n FROM i GROUP BY user_id, session""")
def sessions(spark, d):
    """Sessions that end after 60 minutes without an event."""
    events = table(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    grouped = events.groupBy("user_id", F.session_window("at", "60 minutes").alias("w")).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("n"))
    return grouped.drop("w")


@query("expired", "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 7 DAY")
def expired(spark, d):
    """What stays after an expiry sweep with seven days of grace."""
    return table(spark, d, "events").where("ts >= TIMESTAMP_NTZ '2024-01-10 00:00:00' - INTERVAL '7' DAY").select("event_id")


@query("json_flatten", "SELECT event_id, 'k' AS key, json_extract_string(props, '$.k') AS value FROM events")
def json_flatten(spark, d):
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("range_lookup", """WITH r AS (SELECT p_partkey * 10 AS lo, p_partkey * 10 + CASE WHEN p_size % 3 = 0 THEN 9 ELSE 5 END AS hi, p_brand AS label FROM part)
SELECT event_id, event_id * 2 AS v, coalesce(label, 'none') AS label FROM events LEFT JOIN r ON event_id * 2 BETWEEN lo AND hi""")
def range_lookup(spark, d):
    ranges = table(spark, d, "part").select((F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + F.when(F.col("p_size") % 3 == 0, 9).otherwise(5)).alias("hi"), F.col("p_brand").alias("label"))
    values = table(spark, d, "events").select("event_id", (F.col("event_id") * 2).alias("v"))
    return R.lookup(values, ranges, "v", "label", "none")


@query("merge_ranges", """WITH r AS (SELECT p_type AS label, p_partkey * 10 AS lo, p_partkey * 10 + 9 AS hi FROM part), s AS (SELECT *, CASE WHEN lag(hi) OVER (PARTITION BY label ORDER BY lo) + 1 = lo THEN 0 ELSE 1 END AS st FROM r),
i AS (SELECT *, sum(st) OVER (PARTITION BY label ORDER BY lo) AS island FROM s) SELECT label, min(lo) AS lo, max(hi) AS hi FROM i GROUP BY label, island""")
def merge_ranges(spark, d):
    ranges = table(spark, d, "part").select(F.col("p_type").alias("label"), (F.col("p_partkey") * 10).alias("lo"), (F.col("p_partkey") * 10 + 9).alias("hi"))
    return R.merged(ranges, "label")


@query("retention", """WITH f AS (SELECT o_orderkey, arg_min(o_orderkey, struct_pack(a := o_orderdate, b := o_orderkey)) OVER (PARTITION BY year(o_orderdate) * 100 + month(o_orderdate)) AS first_key, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders)
SELECT o_orderkey FROM f WHERE o_orderkey = first_key OR r <= 7""")
def retention(spark, d):
    """The first file of each month and the last seven."""
    return R.retained(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 7).select("o_orderkey")


@query("line_ranks", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank FROM events")
def line_ranks(spark, d):
    return ranked(table(spark, d, "events").select("event_id"), "event_id").select("event_id", F.col("rank").cast("long").alias("rank"))


@query("state_walkback", f"SELECT event_id, user_id, coalesce(first_value(event_type) {O} ROWS BETWEEN 1 FOLLOWING AND 1 FOLLOWING), 'current') AS state_after FROM events")
def state_walkback(spark, d):
    return table(spark, d, "events").select("event_id", "user_id", F.coalesce(F.lead("event_type").over(_line()), F.lit("current")).alias("state_after"))
