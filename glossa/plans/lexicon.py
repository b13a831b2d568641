"""Queries of the lexicon operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.text import words
from glossa.operators import lexicon as L
from glossa.operators.ranks import ranked_by
from glossa.operators.tokens import frequencies, tokens
from glossa.plans.catalog import query
from glossa.plans.text import W
from glossa.sources.store import new_folder, saved
from glossa.sources.tables import table


@query("membership_flags", """WITH k AS (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels UNION SELECT item_id FROM benchmark)
SELECT doc_id, doc_id IN (SELECT doc_id FROM documents) AS in_docs, doc_id IN (SELECT doc_id FROM labels) AS in_labels, doc_id IN (SELECT item_id FROM benchmark) AS in_items, coalesce((SELECT quality FROM labels l WHERE l.doc_id = k.doc_id), 99999) AS rank FROM k""")
def membership_flags(spark, d):
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    flags = L.membership({"docs": docs, "labels": labels, "items": table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"))}, "doc_id")
    return L.with_rank(flags, labels.withColumnRenamed("quality", "rank"), "doc_id")


@query("semi_anti_split", "SELECT c_custkey, c_name, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') AS known FROM customer")
def semi_anti_split(spark, d):
    customer = table(spark, d, "customer").select("c_custkey", "c_name")
    seen = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    return customer.join(seen, "c_custkey", "left_semi").withColumn("known", F.lit(True)).unionByName(customer.join(seen, "c_custkey", "left_anti").withColumn("known", F.lit(False)))


@query("substring_join", "WITH s AS (SELECT DISTINCT p_name AS seed FROM part), h AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS head FROM part) SELECT seed, head FROM s JOIN h ON contains(seed, head) AND head <> ''")
def substring_join(spark, d):
    parts = table(spark, d, "part")
    heads = parts.select(F.explode(F.split("p_name", " ")).alias("head")).where("head <> ''")
    return L.contained(parts.select(F.col("p_name").alias("seed")).distinct(), heads, "seed", "head")


SCOPE = f"""f AS (SELECT word, count(*) AS n FROM (SELECT unnest({W}) AS word FROM documents) GROUP BY word), b AS (SELECT DISTINCT unnest({W}) AS word FROM benchmark),
h AS (SELECT word AS head FROM f WHERE word NOT IN (SELECT word FROM b)), s AS (SELECT word AS seed, row_number() OVER (ORDER BY n DESC, word) AS number FROM f QUALIFY number % 49 = 1),
m AS (SELECT number, CASE WHEN length(head) < length(seed) THEN 1 ELSE 2 END AS kind, head FROM s JOIN h ON seed <> head AND (contains(seed, head) OR contains(head, seed))),
a AS (SELECT head, min(number) AS number, arg_min(kind, number * 10 + kind) AS kind FROM m GROUP BY head),
r AS (SELECT number, 0 AS kind, seed AS head FROM s UNION ALL SELECT number, kind, head FROM a WHERE NOT EXISTS (SELECT 1 FROM s WHERE seed = head AND s.number <= a.number))"""


def _scope(spark, d):
    """Seeds: every 49th word of the documents by frequency, from the first on, numbered by rank; heads: words that the benchmark doesn't have."""
    freq = saved(frequencies(table(spark, d, "documents")), new_folder(spark, "freq"))
    items = table(spark, d, "benchmark").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    ranked = ranked_by(freq, F.desc("freq"), F.asc("word"), name="number", kind="long")
    seeds = ranked.where("number % 49 = 1").select("number", F.col("word").alias("seed"))
    return seeds, freq.join(items, "word", "left_anti").select(F.col("word").alias("head")), items.select(F.col("word").alias("head"))


@query("lexicon_scope", f"WITH {SCOPE} SELECT CAST(number AS BIGINT) AS number, CAST(kind AS INTEGER) AS kind, head FROM r")
def lexicon_scope(spark, d):
    """Which headwords come into a lexicon's scope by which seed: the seed, words inside it, words around it, in the seeds' order."""
    seeds, heads, _ = _scope(spark, d)
    return L.scope(seeds, heads)


@query("lexicon_scope_counts", f"""WITH {SCOPE} SELECT count(*) FILTER (WHERE kind = 0) AS seeds, count(*) FILTER (WHERE kind = 1) AS parts, count(*) FILTER (WHERE kind = 2) AS longer, count(DISTINCT head) AS heads,
(SELECT count(*) FROM s JOIN b ON seed <> word AND contains(seed, word)) AS parts_elsewhere FROM r""")
def lexicon_scope_counts(spark, d):
    seeds, heads, others = _scope(spark, d)
    return L.scope_counts(L.scope(seeds, heads), seeds, others)


HINTS = f"h AS (SELECT DISTINCT doc_id, word FROM (SELECT doc_id, unnest({W}) AS word FROM documents))"


def _hints(spark, d):
    """The distinct words of each document, its list of hints; made distinct inside the row."""
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word"))


@query("hint_filter", f"WITH {HINTS}, c AS (SELECT word FROM h GROUP BY word HAVING count(*) <= 20) SELECT doc_id, word FROM h WHERE word IN (SELECT word FROM c)")
def hint_filter(spark, d):
    return L.rare(_hints(spark, d), "word", 20).select("doc_id", "word")


FREQUENT = f"f AS (SELECT word FROM (SELECT unnest({W}) AS word FROM documents) GROUP BY word HAVING count(*) > 2000)"
FIRST = f"d AS (SELECT doc_id, {W} AS w FROM documents), i AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d)"


@query("first_hypothesis_filter", f"WITH {FREQUENT}, {FIRST}, b AS (SELECT DISTINCT doc_id FROM d SEMI JOIN f ON f.word = w[1]) SELECT doc_id, CAST(pos AS INTEGER) AS pos, word FROM i ANTI JOIN b USING (doc_id) ANTI JOIN f USING (word)")
def first_hypothesis_filter(spark, d):
    docs = table(spark, d, "documents")
    frequent = frequencies(docs).where("freq > 2000")
    return L.first_ok(tokens(docs, "doc_id"), "doc_id", "pos", "word", frequent).select("doc_id", "pos", "word")


LISTS = f"""l AS (SELECT doc_id, lang, {W} AS ws, list_distinct({W}) AS ds, list_sort(list_distinct({W})) AS ss FROM documents), t AS (SELECT lang, unnest(ws) AS word, len(ws) - unnest(range(len(ws))) AS points FROM l
UNION ALL SELECT lang, unnest(ss), len(ss) - unnest(range(len(ss))) FROM l UNION ALL SELECT lang, unnest(list_reverse(ss)), len(ss) - unnest(range(len(ss))) FROM l)"""


@query("rank_fusion", f"WITH {LISTS} SELECT lang, word, CAST(sum(points) AS BIGINT) AS score FROM t GROUP BY lang, word")
def rank_fusion(spark, d):
    """For each language, words by the sum over three lists of each document of (length - place): as they stand, and in either order of the alphabet."""
    docs = table(spark, d, "documents").select("lang", words(F.col("text")).alias("w")).withColumn("s", F.array_sort(F.array_distinct("w")))
    lists = [docs.select("lang", F.size(c).alias("n"), F.posexplode(c).alias("place", "word")) for c in ("w", "s")]
    back = docs.select("lang", F.size("s").alias("n"), F.posexplode(F.reverse("s")).alias("place", "word"))
    return L.fused([x.select("lang", "word", (F.col("place") - F.col("n")).alias("place")) for x in (*lists, back)], "lang", "word", "place", 0)


@query("rank_buckets", "SELECT o_orderkey // 1000 AS bucket, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM orders GROUP BY 1")
def rank_buckets(spark, d):
    return L.buckets(table(spark, d, "orders"), F.col("o_orderkey"), F.col("o_orderstatus") == "F", many=None)


@query("sense_counts", f"SELECT n_lines, count(*) AS n FROM (SELECT len(string_split(text, chr(10))) AS n_lines FROM documents) GROUP BY n_lines")
def sense_counts(spark, d):
    """Counts of counts: how many documents have so many lines."""
    return table(spark, d, "documents").select(F.size(F.split("text", "\n")).cast("long").alias("n_lines")).groupBy("n_lines").agg(F.count("*").alias("n"))


@query("corpus_stats", f"WITH w AS (SELECT len({W}) AS n FROM documents) SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS tokens, CAST(max(n) AS BIGINT) AS longest, round(avg(n), 4) AS mean FROM w")
def corpus_stats(spark, d):
    n = table(spark, d, "documents").select(F.size(words(F.col("text"))).cast("long").alias("n"))
    return n.agg(F.count("*").alias("docs"), F.sum("n").alias("tokens"), F.max("n").alias("longest"), F.round(F.avg("n"), 4).alias("mean"))


@query("tag_counts", r"SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) AS tag FROM pages) GROUP BY tag")
def tag_counts(spark, d):
    return table(spark, d, "pages").select(F.explode(F.regexp_extract_all("html", F.lit("<([a-z0-9]+)[ >]"), 1)).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


@query("count_bands", "WITH c AS (SELECT o_custkey, CAST(count(*) * 97 AS BIGINT) AS n FROM orders GROUP BY o_custkey) SELECT o_custkey, n, CAST(CASE WHEN n <= 500 THEN n WHEN n <= 2000 THEN n - n % 100 WHEN n <= 10000 THEN n - n % 500 ELSE n - n % 1000 END AS BIGINT) AS shown FROM c")
def count_bands(spark, d):
    from glossa.functions.text import result_count

    n = table(spark, d, "orders").groupBy("o_custkey").agg((F.count("*") * 97).alias("n"))
    return n.withColumn("shown", result_count(F.col("n")))
