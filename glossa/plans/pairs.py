"""Queries on parallel segments, collocations and vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import text as T
from glossa.operators import pairs as P
from glossa.operators import vectors as V
from glossa.plans.catalog import query
from glossa.sources.store import new_folder, saved
from glossa.sources.tables import table

PAIRS = "p AS (SELECT a.conv_id, a.turn, a.text AS src, b.text AS trg FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant')"


@query("parallel_pairs", f"WITH {PAIRS} SELECT conv_id, turn, src, trg FROM p")
def parallel_pairs(spark, d):
    return P.turn_pairs(table(spark, d, "conversations"))


@query("ratio_filter", rf"""WITH {PAIRS}, n AS (SELECT *, length(src) AS n, length(trg) AS m, greatest(length(regexp_replace(src, '[^\p{{P}}]', '', 'g')) / length(src), length(regexp_replace(trg, '[^\p{{P}}]', '', 'g')) / length(trg)) AS share FROM p WHERE length(src) > 0 AND length(trg) > 0)
SELECT conv_id, turn, CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m FROM n WHERE CASE WHEN n <= 200 THEN m >= 0.5 * n AND m <= 7 * n AND share <= 0.3 WHEN n <= 600 THEN m >= 0.4 * n AND m <= 5 * n AND share <= 0.2 ELSE m >= 0.3 * n AND m <= 4 * n AND share <= 0.1 END""")
def ratio_filter(spark, d):
    """The banded ratio filter, with bands for whole turns."""
    pairs = P.turn_pairs(table(spark, d, "conversations"))
    n, m = F.length("src"), F.length("trg")
    share = F.greatest(T.punctuation(F.col("src")) / n, T.punctuation(F.col("trg")) / m)
    ok = F.when(n <= 200, (m >= 0.5 * n) & (m <= 7 * n) & (share <= 0.3)).when(n <= 600, (m >= 0.4 * n) & (m <= 5 * n) & (share <= 0.2)).otherwise((m >= 0.3 * n) & (m <= 4 * n) & (share <= 0.1))
    return pairs.where((n > 0) & (m > 0)).where(ok).select("conv_id", "turn", n.alias("n"), m.alias("m"))


COUNTS = f"""{PAIRS}, s AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(src), '[a-zà-ÿ]+')) AS w FROM p), t AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(trg), '[a-zà-ÿ]+')) AS w FROM p),
sf AS (SELECT w, count(*) AS f FROM s GROUP BY w HAVING count(*) >= 5), tf AS (SELECT w, count(*) AS f FROM t GROUP BY w HAVING count(*) >= 3),
c AS (SELECT s.w AS src, t.w AS trg, count(*) AS n, any_value(sf.f) AS src_freq, any_value(tf.f) AS trg_freq FROM s JOIN sf ON sf.w = s.w JOIN t ON t.conv_id = s.conv_id AND t.turn = s.turn JOIN tf ON tf.w = t.w GROUP BY 1, 2)"""


@query("colloc_counts", f"WITH {COUNTS} SELECT src, trg, n, src_freq, trg_freq FROM c")
def colloc_counts(spark, d):
    return P.counted(P.turn_pairs(table(spark, d, "conversations")), 5, 3).select("src", "trg", F.col("n").cast("long").alias("n"), "src_freq", "trg_freq")


X = "CASE WHEN {0} > 0 THEN ({0}) * ln({0}) END"
LL = " ".join(f"{sign} {X.format(e)}" for sign, e in (("", "a"), ("+", "b"), ("+", "k"), ("+", "d"), ("-", "a + b"), ("-", "a + k"), ("-", "b + d"), ("-", "k + d"), ("+", "a + b + k + d")))
SCORES = f"""{COUNTS}, z AS (SELECT CAST(count(*) AS DOUBLE) AS total FROM p), v AS (SELECT src, trg, n, CAST(n AS DOUBLE) AS a, src_freq - CAST(n AS DOUBLE) AS b, trg_freq - CAST(n AS DOUBLE) AS k,
ln(total / (CAST(src_freq AS DOUBLE) * trg_freq) * n) AS mi, total FROM c, z), w AS (SELECT *, total - b - k + a AS d FROM v), r AS (SELECT src, trg, n, 2 * ({LL}) AS ll, mi FROM w)"""


@query("colloc_ll_mi", f"WITH {SCORES} SELECT src, trg, n, round(ll, 4) AS ll, round(mi, 4) AS mi FROM r WHERE ll >= 100 OR mi >= 1")
def colloc_ll_mi(spark, d):
    pairs = P.turn_pairs(table(spark, d, "conversations"))
    # written down, as a sort reads its rows twice: for the bounds of its ranges, and to deal them
    found = saved(P.scored(pairs, P.counted(pairs, 5, 3), 100.0, 1.0).withColumn("n", F.col("n").cast("long")), new_folder(spark, "scored"))
    return found.orderBy(F.desc("ll"), F.desc("mi"), "src", "trg")


@query("colloc_capped", f"""WITH {COUNTS}, g AS (SELECT src, trg FROM c WHERE n >= 3), a AS (SELECT src FROM g GROUP BY src HAVING count(*) <= 40), b AS (SELECT trg FROM g GROUP BY trg HAVING count(*) <= 20)
SELECT src, count(*) AS n_items, string_agg(trg, ' ' ORDER BY trg) AS items FROM g WHERE src IN (SELECT src FROM a) AND trg IN (SELECT trg FROM b) GROUP BY src""")
def colloc_capped(spark, d):
    counts = P.counted(P.turn_pairs(table(spark, d, "conversations")), 5, 3).where("n >= 3").select("src", "trg")
    return P.capped(counts, "src", "trg", 40, 20)


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


SIMS = "s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)"


@query("cosine_topk", f"WITH {SIMS}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) AS rank FROM s) SELECT query_id, id, round(sim, 5) AS sim, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5")
def cosine_topk(spark, d):
    v = _vectors(spark, d)
    return V.matches(v.where("id % 20 = 0"), v, k=5).select("query_id", "id", F.round("sim", 5).alias("sim"), "rank")


@query("cosine_pairs", f"WITH {SIMS} SELECT query_id, id, round(sim, 5) AS sim FROM s WHERE sim >= 0.35")
def cosine_pairs(spark, d):
    v = _vectors(spark, d)
    return V.matches(v.where("id % 20 = 0"), v, least=0.35).select("query_id", "id", F.round("sim", 5).alias("sim"))


@query("inverse_rank", f"""WITH {SIMS}, r AS (SELECT query_id AS target_id, id AS source_id, sim, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, id) - 1 AS given FROM s), k AS (SELECT * FROM r WHERE given < 10),
o AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY given, sim DESC, target_id) - 1 AS place FROM k) SELECT source_id, CAST(place AS INTEGER) AS place, target_id, CAST(given AS INTEGER) AS given, round(sim, 5) AS sim FROM o WHERE place < 10""")
def inverse_rank(spark, d):
    v = _vectors(spark, d)
    return V.inverse_rank(v.where("id % 20 = 0"), v, 10).select("source_id", "place", "target_id", "given", F.round("sim", 5).alias("sim"))


NEXT = "n AS (SELECT a.label = b.label AS same_label, a.vec_id AS id, CAST(a.embedding AS DOUBLE[]) AS a, CAST(b.embedding AS DOUBLE[]) AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _next(spark, d):
    v = _vectors(spark, d)
    a, b = v.select("id", F.col("v").alias("a"), F.col("label").alias("la")), v.select((F.col("id") - 1).alias("id"), F.col("v").alias("b"), F.col("label").alias("lb"))
    return a.join(b, "id").select("id", "a", "b", (F.col("la") == F.col("lb")).alias("same_label"))


@query("avg_similarity", f"WITH {NEXT} SELECT same_label, count(*) AS n, round(avg(list_cosine_similarity(a, b)), 5) AS mean_sim FROM n GROUP BY same_label")
def avg_similarity(spark, d):
    """Mean cosine of a list of pairs, each vector with the next one."""
    return _next(spark, d).groupBy("same_label").agg(F.count("*").alias("n"), F.round(F.avg(V.cosine(F.col("a"), F.col("b"))), 5).alias("mean_sim"))


@query("dim_mask_similarity", f"WITH {NEXT}, m AS (SELECT id, a, b, [x for x, i in a if i % 2 = 1] AS c, [x for x, i in b if i % 2 = 1] AS e FROM n) SELECT id, round(list_cosine_similarity(a, b), 5) AS full_sim, round(list_cosine_similarity(c, e), 5) AS half_sim FROM m")
def dim_mask_similarity(spark, d):
    """Cosine on all dimensions and on every other one."""
    mask = F.transform("a", lambda x, i: F.when(i % 2 == 0, 1.0).otherwise(0.0))
    return _next(spark, d).select("id", F.round(V.cosine(F.col("a"), F.col("b")), 5).alias("full_sim"), F.round(V.cosine(F.col("a"), F.col("b"), mask), 5).alias("half_sim"))


@query("dropped_dimensions")
def dropped_dimensions(spark, d):
    """Dimensions of the embeddings, in the order in which they are dropped to part near pairs (each row and its nearest) from chance pairs."""
    rows = _vectors(spark, d).select("id", "v")
    size = rows.select(F.size("v").alias("n")).first()["n"]
    own, other = rows.select(F.col("id").alias("query_id"), F.col("v").alias("a")), rows.select("id", F.col("v").alias("b"))
    near = V.matches(rows, rows, k=1).join(own, "query_id").join(other, "id")
    pairs = near.select("a", "b", F.lit(True).alias("good")).union(V.negative_pairs(rows).select("a", "b", F.lit(False)))
    dropped = V.reduce_dimensions(pairs, size, 8, only_gains=True)
    return spark.createDataFrame(list(enumerate(dropped)), "place int, dimension int")
