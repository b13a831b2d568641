"""Queries that search positional indexes and posting tables kept in generations, built from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.operators import lookup as L
from glossa.operators import positional as P
from glossa.operators import tokens as K
from glossa.operators.generations import Generations
from glossa.plans import dictionary as D
from glossa.plans.catalog import query
from glossa.plans.text import W
from glossa.sources.store import new_folder, saved
from glossa.sources.tables import table

PHRASES = ("of the", "the", "the and of", "with the", "the the")


def _index(spark, d) -> P.PositionalIndex:
    index = P.PositionalIndex(spark, new_folder(spark, "positions"))
    index.add(table(spark, d, "documents"), "doc_id", "text", fresh=True)
    return index


def _starts(words: str, place: str = "w[i + {0}] = '{1}'") -> str:
    q = words.split()
    return f"list_filter(range(0, len(w) - {len(q) - 1}), lambda i: " + " AND ".join(place.format(k + 1, x) for k, x in enumerate(q)) + ")"


@query("indexed_phrase", f"WITH w AS (SELECT doc_id, {W} AS w FROM documents), h AS (" + " UNION ALL ".join(f"SELECT '{p}' AS query, doc_id, len(w) AS n, {_starts(p)} AS s FROM w" for p in PHRASES) + ") SELECT query, doc_id, CAST(s[1] AS INTEGER) AS first_word, CAST(len(s) AS INTEGER) AS hits, CAST(n AS INTEGER) AS n_words FROM h WHERE len(s) > 0")
def indexed_phrase(spark, d):
    """Several phrases by the positional index: where each starts first, how often it stands in a text, and the text's length."""
    index = _index(spark, d)
    found = None
    for p in PHRASES:
        rows = index.phrase(p.split()).select(F.lit(p).alias("query"), F.col("key").alias("doc_id"), "starts")
        found = rows if found is None else found.union(rows)
    return found.join(index.lengths().withColumnRenamed("key", "doc_id"), "doc_id").select("query", "doc_id", F.get("starts", F.lit(0)).alias("first_word"), F.size("starts").alias("hits"), "n_words")


RUNS = {"widget": D._han("widget", D.SIMP), "brand": "七 brand 13"}


@query("indexed_characters", f"WITH {D.E}, t AS (SELECT entry_id, simp || ' ' || p_brand AS text, simp FROM e JOIN part ON p_partkey = entry_id) SELECT 'widget' AS query, entry_id, CAST(strpos(simp, '{RUNS['widget']}') - 1 AS INTEGER) AS start FROM t WHERE contains(simp, '{RUNS['widget']}') UNION ALL SELECT 'brand', entry_id, CAST(length(simp) - 1 AS INTEGER) FROM t WHERE ends_with(text, '七 Brand#13')")
def indexed_characters(spark, d):
    """Runs of characters and words by an index whose terms are single characters, and words of letters or digits."""
    brands = table(spark, d, "part").select(F.col("p_partkey").alias("entry_id"), "p_brand")
    texts = D.entries(spark, d).join(brands, "entry_id").select("entry_id", F.concat_ws(" ", "simp", "p_brand").alias("text"))
    index = P.PositionalIndex(spark, new_folder(spark, "characters"), P.character_terms)
    index.add(texts, "entry_id", "text", fresh=True)
    each = (index.phrase(list(run.replace(" ", "")) if name == "widget" else run.split()).select(F.lit(name).alias("query"), F.col("key").alias("entry_id"), F.get("starts", F.lit(0)).alias("start")) for name, run in RUNS.items())
    first, second = each
    return first.union(second)


PAGE, SIZE, STEMS = 1, 20, ("of", "ther")
SURFACE = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(STEMS))
STEMMED = " AND ".join(f"left(w[i + {k + 1}], 4) = '{x}'" for k, x in enumerate(STEMS))


@query("indexed_concordance", f"""WITH w AS (SELECT doc_id, {W} AS w, regexp_extract_all(lower(text), '[^a-zà-ÿ]*[a-zà-ÿ]+') AS x FROM documents),
h AS (SELECT *, list_filter(range(0, len(w) - 1), lambda i: {SURFACE})[1] AS a, list_filter(range(0, len(w) - 1), lambda i: {STEMMED})[1] AS b FROM w),
r AS (SELECT doc_id, x, w, CASE WHEN a IS NULL THEN 1 ELSE 0 END AS priority, coalesce(a, b) AS s, row_number() OVER (ORDER BY CASE WHEN a IS NULL THEN 1 ELSE 0 END, doc_id) AS rank, count(*) OVER () AS n FROM h WHERE b IS NOT NULL)
SELECT doc_id, CAST(priority AS INTEGER) AS priority, CAST(rank AS INTEGER) AS rank, n > {(PAGE + 1) * SIZE} AS more, CAST(coalesce(list_sum(list_transform(x[1:s + 1], lambda y: length(y))), 0) - length(w[s + 1]) AS INTEGER) AS "from", CAST(list_sum(list_transform(x[1:s + 2], lambda y: length(y))) AS INTEGER) AS "to"
FROM r WHERE rank > {PAGE * SIZE} AND rank <= {(PAGE + 1) * SIZE}""")
def indexed_concordance(spark, d):
    """The second page of texts with two words in a row, then of texts with forms of their stems, and where to highlight.

    A stem's forms are the words with its first four letters; they are looked up in the words of the corpus, and only the texts of the
    page are fetched.
    """
    docs, index = table(spark, d, "documents"), _index(spark, d)
    known = K.frequencies(docs).where(F.substring("word", 1, 4).isin(*STEMS)).select("word").collect()  # the forms of two stems
    forms = [[r["word"] for r in known if r["word"][:4] == s] or [s] for s in STEMS]
    page = P.concordance(index, list(STEMS), forms, PAGE, SIZE)
    met = docs.select("doc_id", "text").join(F.broadcast(page), F.col("doc_id") == F.col("key"))  # a page
    return met.select("doc_id", "priority", "rank", "more", P.span(F.col("text"), F.col("start"), F.col("length")).alias("at")).select("doc_id", "priority", "rank", "more", "at.from", "at.to")


FINAL = "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'changed ' || text ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0"


@query("index_generations", f"WITH w AS (SELECT doc_id, {W} AS w FROM ({FINAL})), t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS pos FROM w) SELECT term, count(DISTINCT doc_id) AS texts, count(*) AS places, CAST(sum(pos) AS BIGINT) AS sum_of_places FROM t GROUP BY term")
def index_generations(spark, d):
    """Postings of all documents after three batches (two thirds, changes with the rest, removals) and a compaction."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    index = P.PositionalIndex(spark, new_folder(spark, "generations"))
    index.add(docs.where("doc_id % 3 <> 2"), "doc_id", "text", fresh=True)
    index.add(docs.where("doc_id % 5 = 0 OR doc_id % 3 = 2").withColumn("text", F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("changed "), "text")).otherwise(F.col("text"))), "doc_id", "text")
    index.remove(docs.where("doc_id % 7 = 0"), "doc_id")
    index.table.compact(1)
    return index.table.rows().where(F.col("term") != P.LENGTH).groupBy("term").agg(F.count("*").alias("texts"), F.sum(F.size("positions")).cast("long").alias("places"), F.sum(F.aggregate("positions", F.lit(0).cast("long"), lambda s, x: s + x)).alias("sum_of_places"))


@query("hanzi_generations", f"WITH {D.HANZI} SELECT hanzi, entry_id, in_simp, in_trad FROM hp WHERE entry_id % 4 <> 1")
def hanzi_generations(spark, d):
    """The dictionary's character postings, kept in generations, after entries are filed, filed again, and taken out."""
    entries = D.entries(spark, d)
    posts = saved(L.hanzi_postings(entries).select(F.col("hanzi").alias("term"), F.col("entry_id").alias("key"), "in_simp", "in_trad"), new_folder(spark, "hanzi"))
    held = Generations(spark, new_folder(spark, "hanzi"), "term string, key long, in_simp boolean, in_trad boolean", 16)
    n = entries.count()
    held.add(posts, n)
    held.add(posts.where("key % 2 = 0"), n, posts.where("key % 2 = 0").select("key"))
    held.remove(posts.where("key % 4 = 1").select("key"))
    held.compact(1)
    return held.rows().select(F.col("term").alias("hanzi"), F.col("key").alias("entry_id"), "in_simp", "in_trad")
