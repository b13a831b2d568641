"""Queries of the dictionary's indexes and look-ups, on entries made from parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import pinyin as Y
from glossa.functions import target as T
from glossa.operators import lookup as L
from glossa.plans.catalog import ORACLES, query
from glossa.sources.store import new_folder, saved
from glossa.sources.tables import table

# Fixed values of the entries that are made: a character and a syllable for each letter and digit.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
SIMP = "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏闰余零一二三四五六七八九"
TRAD = "天地玄黃宇宙洪荒日月盈昃辰宿列張寒來暑往秋收冬藏閏餘零一二三四五六七八九"
SYLLABLES = "a ba ca da e fa ga ha yi ji ka la ma na o pa qi ran sa ta wu lv wa xi ya za ling yao er san si wang liu chi bai jiu".split()
STOPS = ["the", "widget"]


def entries(spark, d):
    """entry_id, simp, trad, pinyin, senses, freq of each part."""
    letters = F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_size").cast("string"))
    at = lambda c: F.instr(F.lit(ALPHABET), c)
    first, second = F.substring_index("p_name", " ", 1), F.substring_index("p_name", " ", -1)
    size = F.col("p_size").cast("string")
    senses = F.array(
        F.concat(F.lower("p_type"), F.lit(" "), F.replace("p_name", F.lit(" "), F.lit("|"))), F.concat("p_name", F.lit("; "), size, F.lit("th, the "), second), F.lit("SZ:x"),
        F.concat(F.lit("The "), second, F.lit(": 苹果 ("), "p_brand", F.lit(")")), F.concat(second, F.lit("; "), first, F.lit(" "), size),
    )
    cut = table(spark, d, "part").select("p_partkey", letters.alias("l"), senses.alias("senses"), (F.col("p_size") * 7 % 11).cast("int").alias("freq"))
    sylls = F.transform(F.filter(F.split("l", ""), lambda c: c != ""), lambda c: F.struct(F.get(F.array(*map(F.lit, SYLLABLES)), at(c) - 1).alias("text"), (at(c) % 5).alias("tone")))
    return cut.select(F.col("p_partkey").alias("entry_id"), F.translate("l", ALPHABET, SIMP).alias("simp"), F.translate("l", ALPHABET, TRAD).alias("trad"), sylls.alias("pinyin"), "senses", "freq")


SYLL = "[" + ", ".join(f"'{s}'" for s in SYLLABLES) + "]"
E = f"""e AS (SELECT p_partkey AS entry_id, l, translate(l, '{ALPHABET}', '{SIMP}') AS simp, translate(l, '{ALPHABET}', '{TRAD}') AS trad, p_size * 7 % 11 AS freq,
[lower(p_type) || ' ' || replace(p_name, ' ', '|'), p_name || '; ' || p_size || 'th, the ' || split_part(p_name, ' ', 2), 'SZ:x', 'The ' || split_part(p_name, ' ', 2) || ': 苹果 (' || p_brand || ')', split_part(p_name, ' ', 2) || '; ' || split_part(p_name, ' ', 1) || ' ' || p_size] AS senses
FROM (SELECT *, replace(p_name, ' ', '') || p_size AS l FROM part))"""
SEP = r"""[\s,;:.?!\-/''"()\[\]]"""
HAN = r"[\x{3400}-\x{4DFF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"
NUM = r"^([0-9\-.:,^%]+|[0-9]+(th|nd|rd|st|s|m))$"
TOK = rf"""{E}, s AS (SELECT entry_id, unnest(senses) AS sense, unnest(range(len(senses))) AS sense_ix FROM e),
q AS (SELECT entry_id, sense_ix, regexp_extract_all(sense, '{HAN}+|[^{SEP[1:-1]}{HAN[1:-1]}]+|{SEP}+') AS ps FROM s WHERE NOT starts_with(sense, 'SZ:')),
p AS (SELECT entry_id, sense_ix, unnest(ps) AS p, unnest(range(len(ps))) AS i FROM q),
t AS (SELECT *, coalesce(sum(length(p)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, lag(p) OVER w AS prev FROM p WINDOW w AS (PARTITION BY entry_id, sense_ix ORDER BY i)),
k AS (SELECT *, sum(CASE WHEN starts_with(prev, ';') THEN 1 ELSE 0 END) OVER (PARTITION BY entry_id, sense_ix ORDER BY i) AS grp, regexp_matches(p, '{NUM}') AS num, regexp_matches(p, '{HAN}') AS han FROM t WHERE NOT regexp_matches(p, '^{SEP}')),
m0 AS (SELECT entry_id, sense_ix, row_number() OVER (PARTITION BY entry_id, sense_ix ORDER BY i) - 1 AS ix, p AS surf, CAST(start AS INTEGER) AS start, CASE WHEN han THEN 0 ELSE row_number() OVER (PARTITION BY entry_id, sense_ix, grp ORDER BY i) - 1 END AS sub,
CASE WHEN num THEN 'NNN' WHEN han THEN 'ZHO' ELSE lower(replace(replace(p, '|', ''), 'ß', 'ss')) END AS norm, CASE WHEN NOT num AND NOT han AND contains(p, '|') THEN length(p) - strpos(reverse(p), '|') END AS cut FROM k),
m AS (SELECT *, lower(left(surf, cut)) AS first, lower(substr(surf, cut + 2)) AS second FROM m0)"""
WORDS = f"""{TOK}, h AS (SELECT DISTINCT norm AS word, entry_id, sense_ix FROM m WHERE norm NOT IN ('NNN', 'ZHO')
UNION SELECT first, entry_id, sense_ix FROM m WHERE cut IS NOT NULL AND first NOT IN ('the', 'widget') UNION SELECT second, entry_id, sense_ix FROM m WHERE cut IS NOT NULL AND second NOT IN ('the', 'widget'))"""
PREFIX = f"""{TOK}, x AS (SELECT surf AS word FROM m WHERE norm NOT IN ('NNN', 'ZHO') AND cut IS NULL UNION ALL SELECT replace(surf, '|', '') FROM m WHERE cut IS NOT NULL UNION ALL SELECT left(surf, cut) FROM m WHERE cut IS NOT NULL UNION ALL SELECT substr(surf, cut + 2) FROM m WHERE cut IS NOT NULL)"""


@query("target_tokens", f"WITH {TOK} SELECT entry_id, CAST(sense_ix AS INTEGER) AS sense_ix, surf, norm, start, CAST(sub AS INTEGER) AS sub, CAST(cut AS INTEGER) AS cut, first, second FROM m")
def target_tokens(spark, d):
    """Tokens of all senses but the special ones."""
    each = entries(spark, d).select("entry_id", F.posexplode("senses").alias("sense_ix", "sense")).where(~L.special(F.col("sense")))
    return each.select("entry_id", "sense_ix", F.explode(T.tokens(F.col("sense"))).alias("t")).select("entry_id", "sense_ix", "t.*")


HANZI = f"""{E}, hp AS (SELECT entry_id, c AS hanzi, contains(simp, c) AS in_simp, contains(trad, c) AS in_trad, len(list_distinct(string_split(simp, ''))) AS simp_count, len(list_distinct(string_split(trad, ''))) AS trad_count
FROM (SELECT entry_id, simp, trad, unnest(list_distinct(string_split(simp || trad, ''))) AS c FROM e))"""


@query("hanzi_postings", f"WITH {HANZI} SELECT hanzi, entry_id, in_simp, in_trad, CAST(simp_count AS INTEGER) AS simp_count, CAST(trad_count AS INTEGER) AS trad_count FROM hp")
def hanzi_postings(spark, d):
    return L.hanzi_postings(entries(spark, d))


SYLLS = f"""{E}, y0 AS (SELECT entry_id, unnest(string_split(l, '')) AS c, unnest(range(1, length(l) + 1)) AS i FROM e), y AS (SELECT entry_id, i, {SYLL}[strpos('{ALPHABET}', c)] AS text, strpos('{ALPHABET}', c) % 5 AS tone FROM y0)"""


@query("syllable_postings", f"WITH {SYLLS}, u AS (SELECT DISTINCT text AS syllable, tone, entry_id FROM y) SELECT syllable, CAST(tone AS INTEGER) AS tone, entry_id, CAST(count(*) OVER (PARTITION BY entry_id) AS INTEGER) AS n FROM u")
def syllable_postings(spark, d):
    return L.syllable_postings(entries(spark, d))


@query("sense_postings", f"WITH {WORDS} SELECT word, entry_id, CAST(sense_ix AS INTEGER) AS sense_ix FROM h")
def sense_postings(spark, d):
    return L.word_postings(entries(spark, d), STOPS)


@query("prefix_counts", f"WITH {PREFIX} SELECT word, count(*) AS count FROM x GROUP BY word")
def prefix_counts(spark, d):
    return L.prefix_counts(entries(spark, d))


def _changed(spark, d):
    """Entries with even ids before and after a change of their first sense."""
    old = entries(spark, d).where("entry_id % 2 = 0")
    return old, old.withColumn("senses", F.concat(F.array(F.lit("brand|new thing")), F.slice("senses", 2, 10)))


CHANGED = "CASE WHEN entry_id % 2 = 0 THEN list_concat(['brand|new thing'], senses[2:]) ELSE senses END"


@query("index_upkeep", f"WITH {WORDS.replace('SELECT entry_id, unnest(senses) AS sense, unnest(range(len(senses))) AS sense_ix FROM e', f'SELECT entry_id, unnest({CHANGED}) AS sense, unnest(range(len(senses))) AS sense_ix FROM e')} SELECT word, entry_id, CAST(sense_ix AS INTEGER) AS sense_ix FROM h")
def index_upkeep(spark, d):
    """Word postings after entries are taken out of the index and filed again; equal to an index built anew."""
    old, new = _changed(spark, d)
    return L.reindexed(L.word_postings(entries(spark, d), STOPS), old, L.word_postings(new, STOPS)).select("word", "entry_id", "sense_ix")


@query("prefix_upkeep", f"WITH {PREFIX.replace('SELECT entry_id, unnest(senses) AS sense, unnest(range(len(senses))) AS sense_ix FROM e', f'SELECT entry_id, unnest({CHANGED}) AS sense, unnest(range(len(senses))) AS sense_ix FROM e')} SELECT word, count(*) AS count FROM x GROUP BY word")
def prefix_upkeep(spark, d):
    """Prefix counts with what the old entries held taken off and what the new ones hold added."""
    old, new = _changed(spark, d)
    return L.recounted(L.prefix_counts(entries(spark, d)), L.prefix_counts(old, -1), L.prefix_counts(new))


def _han(word: str, forms: str) -> str:
    return word.translate(str.maketrans(ALPHABET, forms))


WIDGET = _han("widget", TRAD)
PY = "list_transform(range(1, length(l) + 1), lambda i: [{0}[strpos('{1}', substr(l, CAST(i AS INTEGER), 1))], CAST(strpos('{1}', substr(l, CAST(i AS INTEGER), 1)) % 5 AS VARCHAR)])".format(SYLL, ALPHABET)


@query("hanzi_lookup", f"WITH {E}, f AS (SELECT entry_id, simp, {PY} AS py, CASE WHEN contains(simp, '{WIDGET}') THEN strpos(simp, '{WIDGET}') ELSE strpos(trad, '{WIDGET}') END - 1 AS start FROM e) SELECT entry_id, CAST(start AS INTEGER) AS start, 6 AS length, CAST(row_number() OVER (ORDER BY start, py, length(simp), entry_id) AS INTEGER) AS rank FROM f WHERE start >= 0")
def hanzi_lookup(spark, d):
    """Entries with the characters of one word, given in the traditional form and with a space."""
    known = entries(spark, d)
    return L.hanzi_lookup(known, L.hanzi_postings(known), WIDGET[:3] + " " + WIDGET[3:])


@query("hanzi_candidates", f"WITH {HANZI} SELECT entry_id FROM hp WHERE hanzi IN ('{_han('l', SIMP)}', '{_han('t', SIMP)}', '{_han('1', SIMP)}') GROUP BY entry_id HAVING count(*) FILTER (WHERE in_simp) = 3 OR count(*) FILTER (WHERE in_trad) = 3")
def hanzi_candidates(spark, d):
    return L.hanzi_candidates(L.hanzi_postings(entries(spark, d)), _han("lt1", SIMP))


def _syllabary():
    return [(s, s[0] in "aeo") for s in sorted(set(SYLLABLES), key=lambda s: (-len(s), s))]


@query("pinyin_lookup", f"WITH {SYLLS}, r AS (SELECT a.entry_id, min(a.i) AS i FROM y a JOIN y b ON b.entry_id = a.entry_id AND b.i = a.i + 1 JOIN y c ON c.entry_id = a.entry_id AND c.i = a.i + 2 WHERE a.text = 'wa' AND b.text = 'yi' AND c.text = 'da' AND c.tone = 4 GROUP BY a.entry_id) SELECT entry_id, CAST(i - 1 AS INTEGER) AS start, CAST(length(l) AS INTEGER) AS n_syllables, CAST(row_number() OVER (ORDER BY length(l), i, {PY}, entry_id) AS INTEGER) AS rank FROM r JOIN e USING (entry_id)")
def pinyin_lookup(spark, d):
    """Entries with three syllables in a row, of which one has a tone."""
    known = entries(spark, d)
    return L.pinyin_lookup(known, L.syllable_postings(known), Y.parse_query("wayi da4", _syllabary()))


@query("target_lookup", f"""WITH {TOK}, r AS (SELECT a.entry_id, a.sense_ix, a.ix, a.start + CASE WHEN a.second = 'economy' THEN a.cut ELSE 0 END AS start, b.start + CASE WHEN b.first = 'cold' THEN b.cut ELSE length(b.surf) END AS fin FROM m a JOIN m b ON b.entry_id = a.entry_id AND b.sense_ix = a.sense_ix AND b.ix = a.ix + 1
WHERE (a.norm = 'economy' OR a.second = 'economy') AND (b.norm = 'cold' OR b.first = 'cold')), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY sense_ix, ix) = 1)
SELECT entry_id, CAST(sense_ix AS INTEGER) AS sense_ix, CAST(start AS INTEGER) AS start, CAST(fin AS INTEGER) AS "end", CAST(row_number() OVER (ORDER BY freq DESC, entry_id) AS INTEGER) AS rank FROM f JOIN e USING (entry_id)""")
def target_lookup(spark, d):
    """Entries with a phrase whose last word may be the first half of a compound."""
    known = entries(spark, d)
    return L.target_lookup(known, L.word_postings(known, STOPS), "Economy, cold", STOPS)


@query("target_stop_word", f"""WITH {TOK}, r AS (SELECT a.entry_id, a.sense_ix, a.ix, a.start, length(a.surf) AS n FROM m a LEFT JOIN m b ON b.entry_id = a.entry_id AND b.sense_ix = a.sense_ix AND b.ix = a.ix + 1 WHERE a.norm = 'widget' AND a.sub = 0 AND (b.ix IS NULL OR b.sub = 0)), f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY entry_id ORDER BY sense_ix, ix) = 1)
SELECT entry_id, CAST(sense_ix AS INTEGER) AS sense_ix, CAST(start AS INTEGER) AS start, CAST(start + n AS INTEGER) AS "end", CAST(row_number() OVER (ORDER BY freq DESC, entry_id) AS INTEGER) AS rank FROM f JOIN e USING (entry_id)""")
def target_stop_word(spark, d):
    """A stop word alone finds the senses of which it is a whole sub-sense."""
    known = entries(spark, d)
    return L.target_lookup(known, L.word_postings(known, STOPS), "widget", STOPS)


LONG = _han("xcoldwidget24smallbolt7bolt", SIMP)


@query("annotate", f"""WITH {E}, c AS (SELECT i - 1 AS start, n AS length, substr('{LONG}', i, n) AS head FROM (SELECT unnest(range(1, {len(LONG) + 1})) AS i), (SELECT unnest(range(1, 17)) AS n) WHERE i + n - 1 <= {len(LONG)}),
h AS (SELECT entry_id, simp AS head, 'simp' AS script FROM e UNION ALL SELECT entry_id, trad, 'trad' FROM e), x AS (SELECT * FROM h JOIN c USING (head)), b AS (SELECT start, max(length) AS length FROM x GROUP BY start),
f AS (SELECT *, coalesce(max(start + length) OVER (ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS far FROM b)
SELECT CAST(x.start AS INTEGER) AS start, CAST(x.length AS INTEGER) AS length, min(script) AS script, entry_id FROM x JOIN f ON f.start = x.start AND f.length = x.length WHERE f.start + f.length > far GROUP BY x.start, x.length, entry_id""")
def annotate(spark, d):
    """Headwords inside a longer run of characters that is none itself."""
    return L.annotated(entries(spark, d), LONG)


CASCADE = {"1": WIDGET[:3] + " " + WIDGET[3:], "2": "wayi da4", "3": LONG, "4": "economy"}


@query("lookup_cascade", f"SELECT 1 AS query, 1 AS mode, entry_id FROM ({ORACLES['hanzi_lookup']}) UNION ALL SELECT 2, 2, entry_id FROM ({ORACLES['pinyin_lookup']}) UNION ALL SELECT DISTINCT 3, 3, entry_id FROM ({ORACLES['annotate']}) UNION ALL SELECT 4, 4, entry_id FROM (WITH {TOK} SELECT DISTINCT entry_id FROM m WHERE norm = 'economy' OR first = 'economy' OR second = 'economy')")
def lookup_cascade(spark, d):
    """Characters, syllables, headwords inside, target words: the first that finds something. Each of four queries is found in a mode of its own."""
    known = saved(entries(spark, d).repartition("entry_id"), new_folder(spark, "entries"))
    # four queries read the indexes
    hanzi, sylls, posts = (saved(p, new_folder(spark, "postings")) for p in (L.hanzi_postings(known), L.syllable_postings(known), L.word_postings(known, STOPS)))
    found = None
    for name, q in CASCADE.items():
        latin = q.isascii()
        by_pinyin = L.pinyin_lookup(known, sylls, Y.parse_query(q, _syllabary())) if latin else known.limit(0)
        inside = known.limit(0) if latin else L.annotated(known, q)
        rows = L.cascade(L.hanzi_lookup(known, hanzi, q), by_pinyin, inside, L.target_lookup(known, posts, q, STOPS)).select(F.lit(int(name)).alias("query"), "mode", "entry_id").distinct()
        found = rows if found is None else found.union(rows)
    return found
