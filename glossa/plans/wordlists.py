"""Queries of aligned segments, translation logs and lexicon building."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import corpus as C
from glossa.functions.text import words
from glossa.operators import aligned as A
from glossa.operators import wordlists as X
from glossa.operators.tokens import running
from glossa.plans.catalog import query
from glossa.plans.dictionary import ALPHABET, E, SIMP, TRAD, entries
from glossa.sources.tables import table

TURNS = "SELECT conv_id * 100 + turn AS segment_id, replace(replace(text, chr(10), ' '), '.', ' .') AS src FROM conversations"


def _segments(spark, d):
    """Segments of the turns: both sides are the turn, the second lower-cased; token i is aligned with i, and with i + 1 at a lower score."""
    text = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("."), F.lit(" ."))
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("segment_id"), text.alias("src"), F.lower(text).alias("trg"))
    place = C.bpe_map(F.col("src"), F.col("src"))
    t = t.withColumn("m", place).where("m IS NOT NULL")
    spans = F.transform("m", lambda x: F.struct(x["start"].alias("a"), x["length"].alias("b")))
    same = F.transform("m", lambda x, i: F.struct(i.alias("ix1"), i.alias("ix2"), F.round(F.lit(0.5) / (i + 1), 6).alias("score")))
    after = F.transform("m", lambda x, i: F.struct(i.alias("ix1"), (i + 1).alias("ix2"), F.round(F.lit(0.2) / (i + 1), 6).alias("score")))
    return t.select("segment_id", "src", "trg", spans.alias("src_map"), spans.alias("trg_map"), F.concat(same, F.filter(after, lambda x: x["ix2"] < F.size("m"))).alias("align"), F.transform("m", lambda x: x["token"]).alias("src_tokens"))


TOKENS = rf"""s AS ({TURNS}), w AS (SELECT segment_id, src, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT segment_id, src, string_split(src, ' ') AS ws FROM s)),
p AS (SELECT *, coalesce(sum(length(w) + 1) OVER (PARTITION BY segment_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos0 FROM w),
t AS (SELECT segment_id, src, regexp_replace(w, '[.,]$', '') AS token, CAST(pos0 AS INTEGER) AS a, length(regexp_replace(w, '[.,]$', '')) AS b, row_number() OVER (PARTITION BY segment_id ORDER BY i) - 1 AS ix FROM p WHERE w <> '' AND NOT regexp_matches(w, '^\p{{P}}'))"""


@query("token_maps", f"WITH {TOKENS} SELECT segment_id, token, a AS start, CAST(b AS INTEGER) AS length FROM t")
def token_maps(spark, d):
    """Where tokens stand in their surface text."""
    s = _segments(spark, d)
    return s.select("segment_id", F.explode(F.arrays_zip("src_tokens", "src_map")).alias("t")).select("segment_id", F.col("t.src_tokens").alias("token"), F.col("t.src_map.a").alias("start"), F.col("t.src_map.b").alias("length"))


LIT = f"""{TOKENS}, q AS (SELECT *, strpos(src, 'the of') - 1 AS q0 FROM t WHERE contains(src, 'the of')), c AS (SELECT segment_id, ix FROM q WHERE (a <= q0 AND a + b > q0) OR (a <= q0 + 5 AND a + b > q0 + 5)),
g AS (SELECT segment_id, ix AS ix2, round(0.5 / (ix + 1), 6) AS score FROM c UNION ALL SELECT segment_id, ix + 1, round(0.2 / (ix + 1), 6) FROM c),
b AS (SELECT g.segment_id, ix2, max(score) AS score FROM g GROUP BY g.segment_id, ix2), l AS (SELECT b.segment_id, b.ix2 AS ix, t.a AS start, t.b AS length, b.score, lower(t.token) AS token FROM b JOIN t ON t.segment_id = b.segment_id AND t.ix = b.ix2),
k AS (SELECT * FROM l WHERE NOT (length <= 2 AND token IN ('a', 'az', 'és') AND NOT EXISTS (SELECT 1 FROM l x WHERE x.segment_id = l.segment_id AND abs(x.ix - l.ix) = 1)))"""


@query("lit_tokens", f"WITH {LIT} SELECT segment_id, CAST(ix AS INTEGER) AS ix, start, CAST(length AS INTEGER) AS length, score FROM k")
def lit_tokens(spark, d):
    """Target tokens that a query's source tokens light up."""
    return A.lit_tokens(_segments(spark, d), "the of")


@query("lit_spans", f"""WITH {LIT}, n AS (SELECT *, lead(ix) OVER w AS nix, lead(start) OVER w AS nstart, lead(score) OVER w AS nscore FROM k WINDOW w AS (PARTITION BY segment_id ORDER BY ix))
SELECT segment_id, start, CAST(start + length AS INTEGER) AS "end", score FROM k UNION ALL SELECT segment_id, CAST(start + length AS INTEGER), nstart, least(score, nscore) FROM n WHERE nix = ix + 1 AND nstart > start + length""")
def lit_spans(spark, d):
    """Lit tokens and the gaps between neighbours."""
    return A.lit_spans(A.lit_tokens(_segments(spark, d), "the of"))


@query("concordance_page", f"WITH s AS ({TURNS}), h AS (SELECT segment_id FROM s WHERE contains(src, 'the')), p AS (SELECT segment_id FROM h ORDER BY segment_id LIMIT 10 OFFSET 5) SELECT segment_id, (SELECT count(*) FROM h) > 15 AS more FROM p")
def concordance_page(spark, d):
    """A page of hits of a run of characters, and whether more follow."""
    hits = _segments(spark, d).where(F.contains("src", F.lit("the"))).select("segment_id")
    return A.page_of(hits, "segment_id", 5, 10)


@query("match_count", f"WITH s AS ({TURNS}) SELECT count(*) AS n FROM s WHERE contains(src, 'the')")
def match_count(spark, d):
    return _segments(spark, d).where(F.contains("src", F.lit("the"))).agg(F.count("*").alias("n"))


LOG = r"""w AS (SELECT conv_id, turn, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM conversations),
h AS (SELECT conv_id * 100 + turn AS s, unnest([0, 1, 2, 3]) AS k, unnest([ws[1] || ' ' || ws[2], 'az ' || ws[3], ws[1] || ' ' || ws[2] || '!', ws[4] || '9']) AS raw FROM w),
c AS (SELECT s, k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw, '\p{P}', '', 'g'), '\s+', ' ', 'g'), '^ ', ''), '^a ', ''), '^az ', '') AS text, raw FROM h WHERE NOT regexp_matches(raw, '\p{Nd}')),
o AS (SELECT s, text, min(k) AS k FROM c WHERE text <> '' GROUP BY s, text), n AS (SELECT conv_id * 100 + turn AS s, row_number() OVER (ORDER BY conv_id, turn) AS sentence, array_to_string(ws[1:2], '') AS source FROM w WHERE len(ws) > 3)"""


def _log(spark, d):
    """Lines of a translation log: for each turn its first words as the sentence, and four hypotheses."""
    ws = F.filter(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), lambda x: x != "")
    t = table(spark, d, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("s"), ws.alias("ws")).where(F.size("ws") > 3)
    w = lambda i: F.get("ws", F.lit(i))
    lines = F.array(
        F.concat(F.lit("[1] SENT 7: "), w(0), F.lit(" "), w(1)), F.concat(F.lit("[1] [-0.0] "), w(0), F.lit(" "), w(1)), F.concat(F.lit("[1] [-1.0] az "), w(2)), F.concat(F.lit("[1] [-2.0] "), w(0), F.lit(" "), w(1), F.lit("!")), F.concat(F.lit("[1] [-3.0] "), w(3), F.lit("9")),
    )
    return t.select("s", F.posexplode(lines).alias("k", "text")).select((F.col("s") * 8 + F.col("k")).alias("line"), "text")


@query("hypotheses", f"WITH {LOG} SELECT sentence, source, CAST(row_number() OVER (PARTITION BY sentence ORDER BY k) - 1 AS INTEGER) AS place, -CAST(k AS DOUBLE) AS score, text FROM o JOIN n USING (s)")
def hypotheses(spark, d):
    """Hypotheses of a translation log, cleaned and without repeats."""
    return X.hypotheses(_log(spark, d))


@query("hypothesis_counts", f"WITH {LOG}, f AS (SELECT text, count(*) AS n FROM o JOIN n USING (s) GROUP BY text) SELECT text, n, n * len(string_split(text, ' ')) AS words FROM f")
def hypothesis_counts(spark, d):
    return X.hypothesis_counts(X.hypotheses(_log(spark, d)))


@query("dictionaries_side_by_side", """WITH a AS (SELECT p_name AS head, string_agg(DISTINCT p_brand, ' @@ ' ORDER BY p_brand) AS first FROM part WHERE p_size % 2 = 0 GROUP BY p_name), b AS (SELECT p_name AS head, string_agg(DISTINCT p_type, ' @@ ' ORDER BY p_type) AS second FROM part WHERE p_size % 3 = 0 GROUP BY p_name),
n AS (SELECT p_name AS head, string_agg(word, ' ' ORDER BY place) AS near FROM (SELECT p_name, p_brand || '-' || p_partkey AS word, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice DESC, p_brand || '-' || p_partkey) AS place FROM part) WHERE place <= 3 GROUP BY p_name)
SELECT coalesce(a.head, b.head) AS head, first, second, near FROM a FULL JOIN b ON a.head = b.head LEFT JOIN n ON n.head = coalesce(a.head, b.head)""")
def dictionaries_side_by_side(spark, d):
    p = table(spark, d, "part").withColumn("head", F.col("p_name"))
    near = p.select("head", F.concat("p_brand", F.lit("-"), F.col("p_partkey").cast("string")).alias("word"), F.col("p_retailprice").alias("sim"))
    return X.side_by_side(p.where("p_size % 2 = 0").select("head", F.col("p_brand").alias("entry")), p.where("p_size % 3 = 0").select("head", F.col("p_type").alias("entry")), near, "head", 3)


def _info(spark):
    rows = [(s, [t] if t != s else [], [f"r{i}", f"x{i % 3}"]) for i, (s, t) in enumerate(zip(SIMP, TRAD))] + [(t, [], [f"r{i}"]) for i, (s, t) in enumerate(zip(SIMP, TRAD)) if t != s]
    return spark.createDataFrame(rows, "hanzi string, trad array<string>, pinyin array<string>")


@query("head_suggestions", f"""WITH {E}, c AS (SELECT entry_id AS id, entry_id % 2 = 0 AS known, unnest(string_split(l, '')) AS c, unnest(range(length(l))) AS place FROM e)
SELECT id, CAST(place AS INTEGER) AS place, CASE WHEN known THEN translate(c, '{ALPHABET}', '{TRAD}') ELSE CASE WHEN translate(c, '{ALPHABET}', '{TRAD}') = translate(c, '{ALPHABET}', '{SIMP}') THEN '' ELSE translate(c, '{ALPHABET}', '{TRAD}') END END AS trads,
(CASE WHEN known THEN 'k,' ELSE '' END) || 'r' || (strpos('{ALPHABET}', c) - 1) || ',x' || ((strpos('{ALPHABET}', c) - 1) % 3) AS readings, known FROM c WHERE known OR id NOT IN (SELECT x.entry_id FROM e x JOIN e y ON y.simp = x.simp WHERE y.entry_id % 2 = 0)""")
def head_suggestions(spark, d):
    """What a new headword's characters could be in the other script and how they could read; every second one is known."""
    e = entries(spark, d)
    ids = e.select(F.col("entry_id").alias("id"), F.concat("simp", F.when(F.col("entry_id") % 2 == 0, "").otherwise("")).alias("q"), (F.col("entry_id") % 2 == 0).alias("even"))
    heads = e.where("entry_id % 2 = 0").select("simp", "trad", F.transform("pinyin", lambda s: F.lit("k")).alias("pinyin")).distinct()
    odd = ids.where("NOT even").join(heads.select(F.col("simp").alias("q")), "q", "left_anti")
    out = X.suggestions(F.col("q"), heads, _info(spark), ids.where("even").select("id", "q").unionByName(odd.select("id", "q")))
    return out.select("id", "place", F.array_join("trads", ",").alias("trads"), F.array_join("readings", ",").alias("readings"), "known")


@query("head_variants", f"WITH {E} SELECT DISTINCT simp, trad FROM e")
def head_variants(spark, d):
    """Headwords without repeats; made-up ones whose forms don't belong together go."""
    e = entries(spark, d).select("simp", "trad")
    wrong = e.select("simp", F.translate("trad", "天地", "地天").alias("trad")).where("trad <> simp AND NOT trad = translate(simp, '', '')")
    return X.head_variants(e.unionByName(wrong.where(F.col("trad").rlike("[天地]"))), _info(spark))


@query("compared_heads", "SELECT p_partkey AS id, p_size % 2 = 0 AND EXISTS (SELECT 1 FROM part y WHERE y.p_name = x.p_name AND y.p_brand = x.p_brand AND y.p_type = x.p_type AND y.p_size % 2 = 0) OR EXISTS (SELECT 1 FROM part y WHERE y.p_name = x.p_name AND y.p_brand = x.p_brand AND y.p_type = x.p_type AND y.p_size % 2 = 0) AS in_reference, EXISTS (SELECT 1 FROM part y WHERE y.p_name = x.p_name AND y.p_size % 2 = 0) AS simp_known FROM part x")
def compared_heads(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("simp"), F.col("p_brand").alias("trad"), F.col("p_type").alias("pinyin"), "p_size")
    return X.compared_heads(p.drop("p_size"), p.where("p_size % 2 = 0"))


@query("chunk_tokens", "SELECT p_partkey, replace(p_name, 'l', ' l') || CASE WHEN p_size % 2 = 0 THEN '' ELSE ' ' || p_size END AS tokens FROM part")
def chunk_tokens(spark, d):
    """Chunks replaced by their tokens, here with a space before each l; numbers have none and stay."""
    p = table(spark, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_size") % 2 == 0, "").otherwise(F.concat(F.lit("  "), F.col("p_size").cast("string")))).alias("t"))
    chunks = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("chunk")).distinct().withColumn("tokens", F.replace("chunk", F.lit("l"), F.lit(" l")))
    return X.tokenised(p, chunks, "p_partkey", "t")


@query("npmi_phrases", """WITH w AS (SELECT regexp_extract_all(lower(text), '[a-zà-ÿ]+') AS w FROM documents), p AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS p FROM w WHERE len(w) > 1), b AS (SELECT p[1] AS a, p[2] AS b, count(*) AS n FROM p GROUP BY 1, 2),
u AS (SELECT word, count(*) AS f FROM (SELECT unnest(w) AS word FROM w) GROUP BY word), t AS (SELECT CAST(sum(f) AS DOUBLE) AS total FROM u), s AS (SELECT b.a, b.b, n, ln(n / total / (x.f / total * (y.f / total))) / -ln(n / total) AS npmi FROM b JOIN u x ON x.word = b.a JOIN u y ON y.word = b.b, t WHERE n >= 5)
SELECT a, b, n, round(npmi, 6) AS npmi FROM s WHERE npmi > 0.5""")
def npmi_phrases(spark, d):
    from glossa.operators.tokens import phrases

    return phrases(table(spark, d, "documents"), 5, 0.5)
