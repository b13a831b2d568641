"""Queries of stems and of edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import edits as E
from glossa.operators import stemming as S
from glossa.operators.tokens import frequencies
from glossa.plans.catalog import query
from glossa.plans.text import W
from glossa.sources.store import new_folder, saved
from glossa.sources.tables import table

FORMS = f"f AS (SELECT word AS surf, count(*) AS freq FROM (SELECT unnest({W}) AS word FROM documents) GROUP BY word)"
BEST = """b AS (SELECT surf, freq, CASE WHEN surf LIKE 'z%' THEN NULL WHEN length(surf) > 6 THEN left(surf, 4) WHEN length(surf) > 4 THEN left(surf, 3) END AS stem FROM f)"""
STEM_SQL = f"WITH {FORMS}, {BEST} SELECT surf, CASE WHEN stem = 'the' THEN surf WHEN stem IS NOT NULL THEN stem WHEN freq >= 5 THEN surf END AS stem, stem IS NOT NULL AS analysed FROM b"


def _stems(spark, d):
    """A dictionary from made-up analyses: words of over four letters lose some, those in z have none."""
    forms = frequencies(table(spark, d, "documents")).withColumnRenamed("word", "surf")
    n = F.length("surf")
    tries = F.array(F.struct(F.lit(0).alias("place"), F.lit("").alias("stem")), F.struct(F.lit(1).alias("place"), F.when(n > 6, F.substring("surf", 1, 5)).otherwise("").alias("stem")), F.struct(F.lit(2).alias("place"), F.when(n > 6, F.substring("surf", 1, 4)).when(n > 4, F.substring("surf", 1, 3)).otherwise("").alias("stem")))
    candidates = forms.select("surf", F.explode(F.when(F.startswith("surf", F.lit("z")), F.slice(tries, 1, 1)).otherwise(tries)).alias("c")).select("surf", "c.*")
    return S.stem_dictionary(candidates, forms.where("freq >= 5"), ["the"])


@query("stem_dictionary", STEM_SQL)
def stem_dictionary(spark, d):
    return _stems(spark, d)


@query("stem_coverage", f"SELECT count(*) AS surfaces, count(stem) AS stemmed, count(DISTINCT stem) AS stems FROM ({STEM_SQL})")
def stem_coverage(spark, d):
    return S.coverage(_stems(spark, d))


@query("stem_file", f"SELECT row_number() OVER (ORDER BY surf) AS number, surf, stem FROM ({STEM_SQL}) WHERE stem <> surf")
def stem_file(spark, d):
    return S.stem_file(_stems(spark, d))


SPLIT = """w AS (SELECT conv_id, turn, unnest(ws) AS surf, unnest(range(len(ws))) AS pos FROM (SELECT conv_id, turn, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda t: t <> '' AND NOT regexp_matches(t, '^\\p{P}')) AS ws FROM conversations)),
t AS (SELECT *, CASE WHEN length(surf) >= 8 THEN lower(left(surf, 3)) || '+' || lower(substr(surf, 4)) WHEN length(surf) >= 5 THEN lower(left(surf, 4)) END AS stem FROM w),
p AS (SELECT *, CASE WHEN length(surf) >= 8 THEN '2/' || split_part(stem, '+', 1) || '#' || surf || ' 2/' || split_part(stem, '+', 2) || '#' || surf ELSE '1/' || coalesce(stem, lower(surf)) || '#' || surf END AS written, CASE WHEN stem IS NULL AND NOT regexp_matches(surf, '^\\p{Lu}') THEN 1 ELSE 0 END AS unknown FROM t),
g AS (SELECT conv_id, turn, string_agg(written, ' ' ORDER BY pos) AS tokens, CAST(sum(CASE WHEN length(surf) >= 8 THEN 2 ELSE 1 END) AS BIGINT) AS n, CAST(sum(unknown) AS BIGINT) AS bad FROM p GROUP BY conv_id, turn)"""


def _stemmed(spark, d):
    turns = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.replace("text", F.lit("\n"), F.lit(" ")).alias("text"))
    surf = turns.select(F.explode(F.split("text", " ")).alias("surf")).distinct().where(F.length("surf") >= 5)
    long = F.concat(F.lower(F.substring("surf", 1, 3)), F.lit("+"), F.lower(F.substring("surf", 4, 1000)))
    return S.stem_tokens(turns, surf.withColumn("stem", F.when(F.length("surf") >= 8, long).otherwise(F.lower(F.substring("surf", 1, 4)))), "k", "text")


@query("stem_tokens", f"WITH {SPLIT} SELECT conv_id, turn, tokens, n, bad FROM g")
def stem_tokens(spark, d):
    return _stemmed(spark, d).select("k.*", "tokens", "n", "bad")


@query("stem_quality", f'WITH {SPLIT} SELECT count(*) AS total, count(*) FILTER (WHERE bad = 0) AS "none", count(*) FILTER (WHERE bad = 1) AS one, count(*) FILTER (WHERE bad > 1) AS more FROM g')
def stem_quality(spark, d):
    return S.quality(_stemmed(spark, d))


KINDS = ["target", "comment", "approve", "flag", "unflag"]
RUN = """e AS (SELECT c_custkey AS entry_id, c_name AS head, c_mktsegment AS target, CAST(c_custkey % 3 AS INTEGER) AS status FROM customer),
r AS (SELECT event_id AS req_id, user_id AS entry_id, event_id % 7 AS user_id, ['target', 'comment', 'approve', 'flag', 'unflag'][event_id % 5 + 1] AS kind, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE user_id IN (SELECT c_custkey FROM customer)),
s AS (SELECT entry_id, target, status, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS req_id, CAST(NULL AS BIGINT) AS user_id, 0 AS chg, '' AS trg_before, 99 AS status_before, true AS accepted FROM e
UNION ALL SELECT x.entry_id, CASE WHEN kind = 'target' AND ok THEN text ELSE target END, CASE WHEN asked IS NOT NULL AND ok THEN asked ELSE status END, x.n, x.rid, x.uid, CASE WHEN kind = 'target' THEN 2 WHEN asked IS NOT NULL THEN 4 ELSE 3 END, CASE WHEN kind = 'target' AND ok THEN target ELSE '' END, CASE WHEN asked IS NOT NULL AND ok THEN status ELSE 99 END, ok
FROM (SELECT s.entry_id, s.target, s.status, r.n, r.req_id AS rid, r.user_id AS uid, r.kind, r.text, CASE r.kind WHEN 'approve' THEN 1 WHEN 'flag' THEN 2 WHEN 'unflag' THEN 0 END AS asked,
CASE r.kind WHEN 'unflag' THEN s.status = 2 WHEN 'approve' THEN s.status <> 1 WHEN 'flag' THEN s.status <> 2 WHEN 'target' THEN r.text <> s.target ELSE true END AS ok FROM s JOIN r ON r.entry_id = s.entry_id AND r.n = s.n + 1) x)"""


def _batch(spark, d):
    entries = table(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"), F.col("c_name").alias("head"), F.col("c_mktsegment").alias("target"), (F.col("c_custkey") % 3).cast("int").alias("status"))
    kind = F.get(F.array(*map(F.lit, KINDS)), (F.col("event_id") % 5).cast("int"))
    requests = table(spark, d, "events").select(F.col("event_id").alias("req_id"), F.col("user_id").cast("long").alias("entry_id"), (F.col("event_id") % 7).alias("user_id"), kind.alias("kind"), F.col("event_type").alias("text"))
    return entries, requests


@query("edit_changes", f"WITH RECURSIVE {RUN} SELECT entry_id, req_id, user_id, chg, trg_before, status_before, accepted FROM s WHERE n > 0")
def edit_changes(spark, d):
    """What a batch of edits and status changes adds to the history, with those that an entry's status doesn't allow."""
    return E.changes(*_batch(spark, d))


@query("edited_entries", f"WITH RECURSIVE {RUN} SELECT entry_id, head, arg_max(s.target, s.n) AS target, arg_max(s.status, s.n) AS status FROM s JOIN (SELECT entry_id, head FROM e) USING (entry_id) GROUP BY entry_id, head")
def edited_entries(spark, d):
    return E.edited(*_batch(spark, d))


@query("head_changes", """WITH r AS (SELECT o_orderkey AS req_id, o_custkey AS entry_id, 'Customer#' || lpad(CAST(o_orderkey % 400 AS VARCHAR), 9, '0') AS head FROM orders)
SELECT req_id, entry_id, c_name AS hw_before, head, NOT EXISTS (SELECT 1 FROM customer x WHERE x.c_name = head) AND req_id = min(req_id) OVER (PARTITION BY head) AS accepted FROM r JOIN customer ON c_custkey = entry_id""")
def head_changes(spark, d):
    head = F.concat(F.lit("Customer#"), F.lpad((F.col("o_orderkey") % 400).cast("string"), 9, "0"))
    requests = table(spark, d, "orders").select(F.col("o_orderkey").alias("req_id"), F.col("o_custkey").alias("entry_id"), head.alias("head"))
    return E.head_changes(_batch(spark, d)[0], requests)


ADDED = """a AS (SELECT head, min(req_id) AS req_id FROM (SELECT o_orderkey AS req_id, 'Customer#' || lpad(CAST(o_orderkey % 4000 AS VARCHAR), 9, '0') AS head FROM orders) WHERE head NOT IN (SELECT c_name FROM customer) GROUP BY head),
n AS (SELECT (SELECT max(c_custkey) FROM customer) + row_number() OVER (ORDER BY req_id) AS entry_id, req_id, head FROM a)"""


def _added(spark, d):
    head = F.concat(F.lit("Customer#"), F.lpad((F.col("o_orderkey") % 4000).cast("string"), 9, "0"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("req_id"), head.alias("head"), F.col("o_orderstatus").alias("target"))
    return E.added(_batch(spark, d)[0], rows)


@query("bulk_add", f"WITH {ADDED} SELECT entry_id, req_id, head, o_orderstatus AS target FROM n JOIN orders ON o_orderkey = req_id")
def bulk_add(spark, d):
    """Rows with a head that no entry has, the first of each, with ids after the largest."""
    return _added(spark, d)


@query("bulk_changes", f"WITH {ADDED} SELECT NULL::BIGINT AS entry_id, true AS parent, 5 AS bulk_ref, 3 AS user_id, 'bulk' AS note, 99 AS chg, count(*) AS n_new FROM n UNION ALL SELECT entry_id, false, 5, 3, '', 0, -1 FROM n")
def bulk_changes(spark, d):
    return E.bulk_changes(_added(spark, d), 5, 3, "bulk")


NEAR = """l AS (SELECT p_partkey, length(replace(p_name, ' ', '')) AS n, p_size FROM part), k AS (SELECT CASE WHEN p_size % 5 = 0 THEN 0 ELSE 1 END AS status FROM l WHERE n <= 16)"""


@query("prepared_entries", f"WITH {NEAR} SELECT status, count(*) AS entries, (SELECT count(*) FROM k) AS codes, CAST(0 AS BIGINT) AS clashes FROM k GROUP BY status")
def prepared_entries(spark, d):
    """Entry lines of parts, repeats among them, as first versions: by status how many, and all their codes, none of them used twice."""
    head = F.replace("p_name", F.lit(" "), F.lit(""))
    line = F.concat(head, F.lit(" "), head, F.lit(" [xx] /"), "p_brand", F.when(F.col("p_size") % 5 == 0, " (u.E.)").otherwise(""), F.lit("/"))
    made = saved(E.prepared(table(spark, d, "part").select(line.alias("text")), "2017-05-02T22:41:05Z", "u", "first"), new_folder(spark, "prepared"))
    codes = made.groupBy("code").agg(F.count("*").alias("n")).agg(F.count("*").alias("codes"), F.sum((F.col("n") > 1).cast("long")).alias("clashes"))
    return made.groupBy("status").agg(F.count("*").alias("entries")).join(F.broadcast(codes))  # one row


@query("reserved_ids", "SELECT count(*) AS added, count(*) AS ids, CAST(0 AS BIGINT) AS taken FROM orders")
def reserved_ids(spark, d):
    """Ids for rows that nobody has, in a space that the entries and the rows fill to seven eighths."""
    entries = table(spark, d, "customer").select(F.col("c_custkey").alias("entry_id"))
    rows = table(spark, d, "orders").select("o_orderkey")
    space = (entries.count() + rows.count()) * 8 // 7
    got = saved(E.reserved(entries, rows, F.col("o_orderkey"), space), new_folder(spark, "reserved"))
    taken = got.join(entries, "entry_id", "left_semi").agg(F.count("*").alias("taken"))
    return got.agg(F.count("*").alias("added"), F.count_distinct("entry_id").alias("ids")).join(F.broadcast(taken))  # one row
