"""Queries of the search operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions.text import words
from glossa.operators import index as I
from glossa.operators import tokens as K
from glossa.plans.catalog import query
from glossa.plans.text import W
from glossa.sources.store import new_folder
from glossa.sources.tables import table

P = f"' ' || array_to_string({W}, ' ') || ' '"


@query("postings_build", f"""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), e AS (SELECT doc_id, unnest(ls) AS text, unnest(range(len(ls))) AS line_ix FROM l)
SELECT DISTINCT doc_id, CAST(line_ix AS INTEGER) AS line_ix, unnest({W}) AS word FROM e""")
def postings_build(spark, d):
    return I.postings(table(spark, d, "documents")).select("doc_id", "line_ix", "word")


@query("conj_candidates", f"SELECT doc_id FROM (SELECT doc_id, {W} AS w FROM documents) WHERE list_contains(w, 'the') AND list_contains(w, 'of') AND list_contains(w, 'with')")
def conj_candidates(spark, d):
    return I.having_all(I.postings(table(spark, d, "documents")), ["the", "of", "with"])


@query("phrase_lookup", f"""WITH p AS (SELECT doc_id, {P} AS p FROM documents), t AS (SELECT count(*) AS total FROM p WHERE contains(p, ' of the '))
SELECT doc_id, CAST(len(list_filter(string_split(split_part(p, ' of the ', 1), ' '), lambda w: w <> '')) AS INTEGER) AS first_word,
CAST(len(list_filter(string_split(p, ' '), lambda w: w <> '')) AS INTEGER) AS n_words FROM p WHERE contains(p, ' of the ')""")
def phrase_lookup(spark, d):
    return I.phrase(table(spark, d, "documents"), "of the")


@query("cascade_lookup", f"""WITH p AS (SELECT doc_id, text, {P} AS p FROM documents), m AS (
SELECT 1 AS mode, doc_id FROM p WHERE text = 'the and of' UNION ALL SELECT 2, doc_id FROM p WHERE contains(p, ' the and of ') UNION ALL SELECT 3, doc_id FROM p WHERE contains(p, ' the ') OR contains(p, ' and ') OR contains(p, ' of '))
SELECT mode, doc_id FROM m WHERE mode = (SELECT min(mode) FROM m)""")
def cascade_lookup(spark, d):
    """Exact text, else phrase, else any word: the first mode that finds something gives the rows."""
    docs = table(spark, d, "documents")
    exact = docs.where("text = 'the and of'").select(F.lit(1).alias("mode"), "doc_id")
    run = I.phrase(docs, "the and of").select(F.lit(2).alias("mode"), "doc_id")
    some = docs.where(F.arrays_overlap(words(F.col("text")), F.array(F.lit("the"), F.lit("and"), F.lit("of")))).select(F.lit(3).alias("mode"), "doc_id")
    found = exact.union(run).union(some)
    return found.join(F.broadcast(found.agg(F.min("mode").alias("mode"))), "mode")  # one row


@query("prefix_hints", f"""WITH f AS (SELECT word, count(*) AS freq FROM (SELECT unnest({W}) AS word FROM documents) GROUP BY word),
g AS (SELECT word, translate(word, 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿőű', 'aaaaaaceeeeiiiinooooouuuuyyou') AS folded, freq FROM f)
SELECT word, folded, freq FROM g WHERE starts_with(folded, 'ela') ORDER BY folded, word LIMIT 10""")
def prefix_hints(spark, d):
    held = I.prefix_table(K.frequencies(table(spark, d, "documents")), new_folder(spark, "prefixes"))
    return I.prefix_hints(held, "éla", 10)


def _stem_dictionary(docs, heads: list[str]):
    """A word's stem: the most frequent word with its first four letters, of equal ones the first; for words of given heads."""
    own = F.filter(words(F.col("text")), lambda w: F.substring(w, 1, 4).isin(*heads))
    freq = docs.select(F.explode(own).alias("word")).groupBy("word").agg(F.count("*").alias("freq")).withColumn("head", F.substring("word", 1, 4))
    best = freq.groupBy("head").agg(F.min(F.struct((-F.col("freq")).alias("f"), F.col("word").alias("stem")))["stem"].alias("stem"))
    return freq.join(best, "head").select("word", "stem")


STEMS = f"""t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {W} AS w FROM documents)),
f AS (SELECT word, left(word, 4) AS head, count(*) AS freq FROM t GROUP BY word), b AS (SELECT head, word AS stem FROM f QUALIFY row_number() OVER (PARTITION BY head ORDER BY freq DESC, word) = 1),
s AS (SELECT doc_id, pos, stem FROM t JOIN b ON b.head = left(t.word, 4))"""


@query("stem_rewrite_search", f"WITH {STEMS} SELECT a.doc_id, CAST(count(*) AS BIGINT) AS hits FROM s a JOIN s b ON b.doc_id = a.doc_id AND b.pos = a.pos + 1, (SELECT stem FROM b WHERE head = 'the') x, (SELECT stem FROM b WHERE head = 'ther') y WHERE a.stem = x.stem AND b.stem = y.stem GROUP BY a.doc_id")
def stem_rewrite_search(spark, d):
    """Documents with the stems of two query words in a row."""
    docs = table(spark, d, "documents")
    dictionary = _stem_dictionary(docs, ["the", "ther"])
    known = {r["word"][:4]: r["stem"] for r in dictionary.where("word = stem").collect()}  # a row for each word of the query
    if len(known) < 2:
        return docs.select("doc_id", F.lit(0).cast("long").alias("hits")).limit(0)
    return I.stem_runs(docs, dictionary, [known["the"], known["ther"]])


@query("concordance_union", f"""WITH {STEMS}, p AS (SELECT doc_id, {P} AS p FROM documents), q AS (SELECT doc_id, ' ' || string_agg(stem, ' ' ORDER BY pos) || ' ' AS q FROM s GROUP BY doc_id),
u AS (SELECT doc_id, 0 AS priority FROM p WHERE contains(p, ' the of ') UNION ALL SELECT doc_id, 1 FROM q WHERE contains(q, ' the of '))
SELECT doc_id, min(priority) AS priority FROM u GROUP BY doc_id ORDER BY priority, doc_id LIMIT 100""")
def concordance_union(spark, d):
    """Surface hits, then stem hits not seen before; the first page of 100."""
    docs = table(spark, d, "documents")
    surface = I.phrase(docs, "the of").select("doc_id", F.lit(0).alias("priority"))
    stem = I.stem_runs(docs, _stem_dictionary(docs, ["the", "of"]), ["the", "of"]).select("doc_id", F.lit(1).alias("priority"))
    return surface.union(stem).groupBy("doc_id").agg(F.min("priority").alias("priority")).orderBy("priority", "doc_id").limit(100)


HEADS = "SELECT DISTINCT substr(p_name, i, n) AS head FROM part, (SELECT unnest(range(1, 200)) AS i), (SELECT unnest([2, 3, 5]) AS n) WHERE i + n - 1 <= length(p_name)"


@query("longest_cover", f"""WITH h AS ({HEADS}), c AS (SELECT p_partkey, i - 1 AS start, n AS length, substr(p_name, i, n) AS head FROM part, (SELECT unnest(range(1, 40)) AS i), (SELECT unnest(range(1, 6)) AS n) WHERE i + n - 1 <= length(p_name)),
b AS (SELECT p_partkey, start, length, head FROM c JOIN h USING (head) QUALIFY row_number() OVER (PARTITION BY p_partkey, start ORDER BY length DESC) = 1),
f AS (SELECT *, coalesce(max(start + length) OVER (PARTITION BY p_partkey ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM b)
SELECT p_partkey, CAST(start AS INTEGER) AS start, CAST(length AS INTEGER) AS length, head FROM f WHERE start + length > far""")
def longest_cover(spark, d):
    parts = table(spark, d, "part").select("p_partkey", "p_name")
    cut = parts.select("p_partkey", "p_name", F.explode(F.sequence(F.lit(1), F.length("p_name"))).alias("i")).select("p_partkey", "p_name", "i", F.explode(F.array(F.lit(2), F.lit(3), F.lit(5))).alias("n"))
    heads = cut.where("i + n - 1 <= length(p_name)").select(F.expr("substring(p_name, i, n)").alias("head")).distinct()
    return I.longest_covers(parts, heads, "p_partkey", "p_name", 5)


@query("fmm_segment")
def fmm_segment(spark, d):
    """Forward maximum matching of all documents against the words of the names of parts, and some syllables."""
    names = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("head")).distinct()
    few = spark.createDataFrame([(w,) for w in ("the", "tion", "ing", "er", "on")], "head string")
    return I.segments(table(spark, d, "documents"), names.unionByName(few), "doc_id", "text")


@query("highlight_bridge", f"""WITH t AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM (SELECT doc_id, {W} AS w FROM documents)),
s AS (SELECT *, CASE WHEN length(word) >= 6 THEN length(word) * 0.01 END AS score FROM t),
n AS (SELECT *, lag(score) OVER (PARTITION BY doc_id ORDER BY pos) AS before, lead(score) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM s)
SELECT doc_id, CAST(pos AS INTEGER) AS pos, CASE WHEN score IS NOT NULL THEN 'lit' ELSE 'bridge' END AS kind, round(coalesce(score, least(before, after)), 4) AS score FROM n
WHERE (score IS NOT NULL AND NOT (before IS NULL AND after IS NULL AND word IN ('should', 'worthless'))) OR (score IS NULL AND before IS NOT NULL AND after IS NOT NULL)""")
def highlight_bridge(spark, d):
    """Lit tokens, without isolated ones of a stop list, and the gaps between two lit ones with the lower score.

    Neighbours are taken inside the row's array, so no window sorts the tokens.
    """
    w = words(F.col("text"))
    score = F.transform(w, lambda x: F.when(F.length(x) >= 6, F.length(x) * 0.01))
    each = table(spark, d, "documents").select("doc_id", w.alias("w"), score.alias("s"))
    rows = F.transform("s", lambda x, i: F.struct(i.alias("pos"), F.get("w", i).alias("word"), x.cast("double").alias("own"), F.get("s", i - 1).cast("double").alias("before"), F.get("s", i + 1).cast("double").alias("after")))
    t = each.select("doc_id", F.explode(rows).alias("t")).select("doc_id", "t.*")
    lit = F.col("own").isNotNull()
    alone = F.col("before").isNull() & F.col("after").isNull() & F.col("word").isin("should", "worthless")
    gap = ~lit & F.col("before").isNotNull() & F.col("after").isNotNull()
    return t.where((lit & ~alone) | gap).select("doc_id", "pos", F.when(lit, "lit").otherwise("bridge").alias("kind"), F.round(F.coalesce("own", F.least("before", "after")), 4).alias("score"))
