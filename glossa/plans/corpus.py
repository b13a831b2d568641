"""Queries of corpus cleaning, dictionary texts and formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from glossa.functions import corpus as C
from glossa.functions import target as T
from glossa.operators import tokens as K
from glossa.operators.ranks import ranked_by
from glossa.plans.catalog import query
from glossa.plans.dictionary import ALPHABET, E, SIMP, TRAD, entries
from glossa.plans.text import W, merge_sql
from glossa.sources.tables import table

# Characters that meet the merge rules, and some that don't.
FIRST, SECOND = "我们的不这一天吗你", "们国的不个了天是好台"


def sql_list(items) -> str:
    return "[" + ", ".join("'" + str(i).replace("'", "''") + "'" for i in items) + "]"


def _limited(x: str) -> str:
    return "(" + " OR ".join(f"({x} = '{c}' AND NOT list_contains({sql_list(allowed.split() or [''])}, a || b))" for c, allowed in C.LIMITS.items()) + ")"


@query("merge_blocked", f"""WITH t AS (SELECT event_id, {sql_list(FIRST)}[event_id % {len(FIRST)} + 1] AS a, {sql_list(SECOND)}[event_id // {len(FIRST)} % {len(SECOND)} + 1] || CASE WHEN event_id % 5 = 0 THEN 'x' ELSE '' END AS b FROM events)
SELECT event_id, a, b, (length(a) = 1 AND (a IN ('们', '的') OR {_limited('a')})) OR (length(b) = 1 AND (b IN ('不', '这', '那', '哪') OR {_limited('b')})) OR (list_contains({sql_list(C.DETERMINERS)}, left(a, 1)) AND list_contains({sql_list(C.CLASSIFIERS)}, left(b, 1))) AS blocked FROM t""")
def merge_blocked(spark, d):
    n, m = len(FIRST), len(SECOND)
    a = F.get(F.array(*map(F.lit, FIRST)), (F.col("event_id") % n).cast("int"))
    b = F.concat(F.get(F.array(*map(F.lit, SECOND)), F.pmod(F.expr(f"event_id div {n}"), F.lit(m)).cast("int")), F.when(F.col("event_id") % 5 == 0, "x").otherwise(""))
    return table(spark, d, "events").select("event_id", a.alias("a"), b.alias("b")).withColumn("blocked", C.merge_blocked(F.col("a"), F.col("b")))


# Characters for the letters and digits of names, those of the merge rules among them.
MERGE_CHARS = "是的我们不天这个了地你好一本那家他中她人吗很有真只自国为目但部解就结口除"
BLOCKED = f"(length(a) = 1 AND (a IN ('们', '的') OR {_limited('a')})) OR (length(b) = 1 AND (b IN ('不', '这', '那', '哪') OR {_limited('b')})) OR (list_contains({sql_list(C.DETERMINERS)}, left(a, 1)) AND list_contains({sql_list(C.CLASSIFIERS)}, left(b, 1)))"
HANZI_MERGES, HANZI_LAST = merge_sql("t", [(3, -2.0), (3, -1.0), (2, 0.0)], BLOCKED)


@query("merge_best_first", f"""WITH c AS (SELECT p_partkey AS k, string_split(translate(replace(p_name, ' ', '') || p_size, '{ALPHABET}', '{MERGE_CHARS}'), '') AS w FROM part), t AS (SELECT k, unnest(range(len(w))) AS pos, unnest(w) AS tok FROM c),
{HANZI_MERGES} SELECT k AS p_partkey, string_agg(tok, ' ' ORDER BY pos) AS tokens FROM {HANZI_LAST} GROUP BY k""")
def merge_best_first(spark, d):
    """Characters of names joined in three passes, best pairs first, under the rules that keep some pairs apart."""
    text = F.translate(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_size").cast("string")), ALPHABET, MERGE_CHARS)
    rows = table(spark, d, "part").select("p_partkey", F.filter(F.split(text, ""), lambda c: c != "").alias("tokens"))
    merged = K.merged_tokens(rows, "p_partkey", [(3, -2.0), (3, -1.0), (2, 0.0)], C.merge_blocked)
    return merged.select("p_partkey", F.array_join("tokens", " ").alias("tokens"))


@query("bad_stems", "WITH t AS (SELECT o_orderkey, o_orderkey % 9 AS n, o_orderkey // 9 % 5 AS bad FROM orders) SELECT o_orderkey, n = 0 OR bad >= 3 OR (n <= 3 AND bad > 0) OR (n > 3 AND bad * 3 >= n) AS dropped FROM t")
def bad_stems(spark, d):
    n, bad = F.col("o_orderkey") % 9, F.expr("(o_orderkey div 9) % 5")
    return table(spark, d, "orders").select("o_orderkey", C.bad_stems(n, bad).alias("dropped"))


@query("formats", """WITH t AS (SELECT o_orderkey, CAST(o_orderkey * 7919 AS BIGINT) AS n, ['en', 'de', 'hu', 'jian', 'fan', 'zz'][o_orderkey % 6 + 1] AS code, o_orderdate AS day FROM orders)
SELECT o_orderkey, CASE WHEN n < 10000 THEN CAST(n AS VARCHAR) ELSE (n // 1000) || CASE WHEN code IN ('de', 'hu') THEN ',' ELSE '.' END || (n % 1000 // 100) || 'k' END AS count_text,
CASE WHEN n >= 1000000 THEN (n // 1000000) || '.' || (n % 1000000 // 100000) || 'MB' WHEN n >= 1000 THEN (n // 1000) || '.' || (n % 1000 // 100) || 'KB' ELSE n || ' byte' END AS size_text,
CASE code WHEN 'en' THEN 'E' WHEN 'de' THEN 'D' WHEN 'hu' THEN 'H' WHEN 'jian' THEN 'J' WHEN 'fan' THEN 'F' ELSE 'X' END AS letter,
CASE WHEN code IN ('en', 'de', 'hu') THEN code END AS lang, CASE WHEN code IN ('en', 'de', 'hu') THEN CASE WHEN n % 3 = 0 THEN '' ELSE 'read/' || n END END AS rel,
year(day) || '年' || month(day) || '月' || day(day) || '日' AS day_text, CAST(least(n, 65535) AS BIGINT) AS clamped FROM t""")
def formats(spark, d):
    n = (F.col("o_orderkey") * 7919).cast("long")
    code = F.get(F.array(*map(F.lit, ["en", "de", "hu", "jian", "fan", "zz"])), (F.col("o_orderkey") % 6).cast("int"))
    path = C.path_language(F.concat(code, F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("/read/"), n.cast("string")))))
    return table(spark, d, "orders").select(
        "o_orderkey", C.short_count(n, code.isin("de", "hu")).alias("count_text"), C.size_text(n).alias("size_text"), C.language_letter(code).alias("letter"), path["lang"].alias("lang"), path["rel"].alias("rel"),
        C.chinese_date(F.col("o_orderdate")).alias("day_text"), C.clamped(n).alias("clamped"),
    )


RAW = "p_brand || ' x' || chr(160) || '[py]  /<' || p_type || '>,' || p_name || ' [old] ( a b  ) &quot/ (u.E.) ' || p_size || ' / “q” /'"


@query("cleansed_lines", f"""WITH r AS (SELECT p_partkey, {RAW} AS line FROM part), a AS (SELECT *, replace(replace(replace(replace(replace(replace(line, chr(160), ' '), '“', '"'), '”', '"'), '(u.E.)', ''), '&gt', '>'), '&quot', '"') AS x FROM r),
b AS (SELECT *, regexp_replace(x, '<([^>/]+)>', '(\\1)', 'g') AS y FROM a), c AS (SELECT *, split_part(y, '/', 1) || regexp_replace(substr(y, strpos(y, '/')), '\\[([^\\]/]+)\\]', '(\\1)', 'g') AS z FROM b),
d AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(z, ',(\\p{{L}})', ', \\1', 'g'), ' {{2,}}', ' ', 'g'), '\\( *([^)]+)\\)', '(\\1)', 'g'), ' +\\)', ')', 'g') AS w FROM c)
SELECT p_partkey, split_part(w, '/', 1) || replace(replace(substr(w, strpos(w, '/')), '/ ', '/'), ' /', '/') AS cleansed, true AS changed FROM d""")
def cleansed_lines(spark, d):
    """Lines with every fault that cleansing mends; a changed line would be a new version."""
    line = F.concat("p_brand", F.lit(" x [py]  /<"), "p_type", F.lit(">,"), "p_name", F.lit(" [old] ( a b  ) &quot/ (u.E.) "), F.col("p_size").cast("string"), F.lit(" / “q” /"))
    parts = table(spark, d, "part").select("p_partkey", line.alias("line")).withColumn("cleansed", C.cleansed(F.col("line")))
    return parts.select("p_partkey", "cleansed", (F.col("cleansed") != F.col("line")).alias("changed"))


@query("entry_lines", """WITH h AS (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN 'X' || doc_id || ' [z' || doc_id % 6 || ']' WHEN 1 THEN 'X' || lang || ' ' || source || ' [z' || doc_id || ' y]' WHEN 2 THEN lang || ' ' || source || ' []' ELSE lang || ' ' || lang || ' [' || source || ']' END AS head FROM documents)
SELECT doc_id, CASE WHEN doc_id % 4 IN (1, 3) THEN head || ' /' || array_to_string(list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), '/', chr(92)), chr(10)), lambda x: x <> ''), '/') || '/' END AS line FROM h""")
def entry_lines(spark, d):
    """Entry lines from headwords and texts with a sense on each line; a headword out of form gives none."""
    n, k = F.col("doc_id"), F.col("doc_id") % 4
    text = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts))
    head = F.when(k == 0, text("X", n, " [z", n % 6, "]")).when(k == 1, text("X", F.col("lang"), " ", F.col("source"), " [z", n, " y]")).when(k == 2, text(F.col("lang"), " ", F.col("source"), " []")).otherwise(text(F.col("lang"), " ", F.col("lang"), " [", F.col("source"), "]"))
    return table(spark, d, "documents").select("doc_id", C.entry_line(head, F.col("text")).alias("line"))


CLASSIFIED = {"trad": "個本條張隻輛顆門頭臺", "simp": "个本条张只辆颗门头台", "pinyin": "ge4 ben3 tiao2 zhang1 zhi1 liang4 ke1 men2 tou2 tai2".split()}
ITEMS = "i AS (SELECT p_partkey, unnest(range(p_partkey % 4 + 1)) AS k FROM part), j AS (SELECT p_partkey, k, (p_partkey * 3 + k * 7) % 10 + 1 AS nth, (p_partkey + k * p_size) % 4 AS form FROM i JOIN part USING (p_partkey))"
MEASURES = f"{ITEMS}, m AS (SELECT p_partkey, substr('{CLASSIFIED['trad']}', nth, 1) AS trad, substr('{CLASSIFIED['simp']}', nth, 1) AS simp, form, {sql_list(CLASSIFIED['pinyin'])}[nth] AS pinyin FROM j WHERE form < 3)"


@query("measure_words", f"WITH {MEASURES} SELECT p_partkey, trad, CASE WHEN form = 0 THEN simp ELSE trad END AS simp, CASE WHEN form = 2 THEN '' ELSE pinyin END AS pinyin FROM m")
def measure_words(spark, d):
    """Measure words out of lists of one to four: in both forms, in one, without a reading, and pieces that are none."""
    k = F.sequence(F.lit(0), (F.col("p_partkey") % 4).cast("int"))

    def one(i):
        at, form = ((F.col("p_partkey") * 3 + i * 7) % 10 + 1).cast("int"), F.pmod(F.col("p_partkey") + i * F.col("p_size"), F.lit(4))
        trad, simp = (F.substring(F.lit(CLASSIFIED[c]), at, F.lit(1)) for c in ("trad", "simp"))
        read = F.concat(F.lit("["), F.get(F.array(*map(F.lit, CLASSIFIED["pinyin"])), at - 1), F.lit("]"))
        return F.when(form == 0, F.concat(trad, F.lit("|"), simp, read)).when(form == 1, F.concat(trad, read)).when(form == 2, F.concat(trad, F.lit("[]"))).otherwise(F.concat(trad, trad, read))

    sense = F.concat(F.lit("SZ:"), F.array_join(F.transform(k, one), ","))
    return table(spark, d, "part").select("p_partkey", F.explode(C.measure_words(sense)).alias("m")).select("p_partkey", "m.*")


@query("highlight_bands", "SELECT l_orderkey, l_linenumber, CASE WHEN s >= 0.015 THEN 'hi' WHEN s >= 0.0075 THEN 'mid' WHEN s >= 0.00075 THEN 'lo' ELSE 'none' END AS zh, CASE WHEN s >= 0.03 THEN 'hi' WHEN s >= 0.01 THEN 'mid' WHEN s >= 0.001 THEN 'lo' ELSE 'none' END AS trg FROM (SELECT *, l_quantity / 1500 - 0.001 AS s FROM lineitem)")
def highlight_bands(spark, d):
    s = F.col("l_quantity") / 1500 - 0.001
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", C.band(s, "zh").alias("zh"), C.band(s, "trg").alias("trg"))


KNOWN, SIMPLE = SIMP + TRAD, SIMP
ONLY_TRAD = [c for c in TRAD if c not in SIMP]


@query("script_detection", f"WITH {E} SELECT entry_id, len(list_filter(string_split(trad, ''), lambda c: list_contains({sql_list(ONLY_TRAD)}, c))) > 0 AS traditional FROM e WHERE regexp_matches(trad, '[\\x{{4E00}}-\\x{{9FFF}}]')")
def script_detection(spark, d):
    """Whether a text has a character that is no simplified one, by a join with the character table; texts without hanzi go."""
    from glossa.operators.aligned import traditional

    info = spark.createDataFrame([(c, c in SIMP) for c in sorted(set(KNOWN))], "hanzi string, can_be_simp boolean")
    return traditional(entries(spark, d), "entry_id", "trad", info)


@query("head_checks", f"""WITH {E}, h AS (SELECT entry_id, trad || CASE entry_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' b' WHEN 2 THEN '龘' ELSE 'A9' END AS head FROM e)
SELECT entry_id, array_to_string(list_filter(['foreign', 'space', 'traditional', 'unknown'], lambda f: (f = 'space' AND entry_id % 4 = 1) OR (f = 'foreign' AND entry_id % 4 = 1) OR (f = 'unknown' AND entry_id % 4 = 2) OR (f = 'traditional' AND len(list_filter(string_split(head, ''), lambda c: list_contains({sql_list(ONLY_TRAD)}, c))) > 0)), ',') AS faults,
length(left(head, 6)) <= 6 AND len(list_filter(string_split(left(head, 6), ''), lambda c: NOT list_contains({sql_list(sorted(set(SIMP)))}, c))) = 0 AS addable FROM h""")
def head_checks(spark, d):
    """What keeps a text from being a simplified headword, and whether its first six characters could be one."""
    extra = F.when(F.col("entry_id") % 4 == 0, "").when(F.col("entry_id") % 4 == 1, " b").when(F.col("entry_id") % 4 == 2, "龘").otherwise("A9")
    head = F.concat("trad", extra)
    known, simple = (F.array(*map(F.lit, sorted(set(x)))) for x in (KNOWN, SIMPLE))
    return entries(spark, d).select("entry_id", F.array_join(C.head_faults(head, known, simple), ",").alias("faults"), C.addable(F.substring(head, 1, 6), simple).alias("addable"))


@query("pruned_texts", rf"""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '\p{{Nd}}') THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\p{{P}}', '', 'g'), '\s+', ' ', 'g'), '^ ', ''), '^a ', ''), '^az ', '') END AS plain,
url_encode(text) AS encoded, len({W}) AS n FROM conversations""")
def pruned_texts(spark, d):
    from glossa.functions.text import words

    t = table(spark, d, "conversations")
    encoded = F.replace(F.url_encode("text"), F.lit("+"), F.lit("%20"))
    return t.select("conv_id", "turn", T.without_punctuation(F.col("text")).alias("plain"), encoded.alias("encoded"), F.size(words(F.col("text"))).cast("long").alias("n"))


@query("sentence_tokens", r"""WITH w AS (SELECT conv_id, turn, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM (SELECT conv_id, turn, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM conversations)),
b AS (SELECT *, regexp_replace(regexp_replace(w, '^\p{P}+', ''), '\p{P}+$', '') AS bare, regexp_matches(w, '[-.?!]$') AS ends FROM w)
SELECT conv_id, turn, CAST(count(*) FILTER (WHERE bare <> '') AS BIGINT) AS n_words, CAST(count(*) FILTER (WHERE ends) AS BIGINT) AS n_ends FROM b GROUP BY conv_id, turn""")
def sentence_tokens(spark, d):
    """Words without punctuation, with an empty one after each that ends a sentence."""
    t = T.trimmed_tokens(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", t.alias("t")).select("conv_id", "turn", F.size(F.filter("t", lambda x: x != "")).cast("long").alias("n_words"), F.size(F.filter("t", lambda x: x == "")).cast("long").alias("n_ends"))


@query("char_places", r"""WITH c AS (SELECT conv_id, turn, unnest(string_split(text, '')) AS c, unnest(range(length(text))) AS i FROM conversations), b AS (SELECT *, regexp_matches(c, '^[\p{P}\s]$') AS blank FROM c),
k AS (SELECT *, coalesce(lag(blank) OVER (PARTITION BY conv_id, turn ORDER BY i), true) AS after FROM b), f AS (SELECT * FROM k WHERE NOT (blank AND after) QUALIFY NOT (blank AND row_number() OVER (PARTITION BY conv_id, turn ORDER BY i DESC) = 1))
SELECT conv_id, turn, count(*) AS n, CAST(sum(i) AS BIGINT) AS places FROM f GROUP BY conv_id, turn""")
def char_places(spark, d):
    """How many characters the pruned text has, and the sum of their places in the text."""
    p = T.pruned_places(F.col("text"))
    each = table(spark, d, "conversations").select("conv_id", "turn", p.alias("p")).where(F.size("p") > 0)
    return each.select("conv_id", "turn", F.size("p").cast("long").alias("n"), F.aggregate("p", F.lit(0).cast("long"), lambda s, x: s + x).alias("places"))


@query("erhua", """WITH l AS (SELECT p_partkey, lower(replace(p_type || p_name, ' ', '')) AS l FROM part), x AS (SELECT p_partkey, unnest(string_split(l, '')) AS c, unnest(range(length(l))) AS i FROM l), y AS (SELECT *, c = 'r' AND (p_partkey + i) % 5 = 0 AND i > 0 AS joined FROM x),
g AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY p_partkey ORDER BY i) AS g FROM y), r AS (SELECT p_partkey, g, string_agg(c, '' ORDER BY i) AS text, min(i) AS a, max(i) AS b FROM g GROUP BY p_partkey, g)
SELECT p_partkey, string_agg(text, ' ' ORDER BY g) AS shown, string_agg(a || '-' || b, ',' ORDER BY g) AS places FROM r GROUP BY p_partkey""")
def erhua(spark, d):
    """A neutral r is shown with the syllable before it; places map the run as given to the run as shown. Letters of names stand for syllables, their tones go round."""
    letters = F.filter(F.split(F.lower(F.replace(F.concat("p_type", "p_name"), F.lit(" "), F.lit(""))), ""), lambda c: c != "")
    run = F.transform(letters, lambda c, i: F.struct(c.alias("text"), ((F.col("p_partkey") + i) % 5).cast("int").alias("tone")))
    return table(spark, d, "part").select("p_partkey", C.merged_erhua(run).alias("m")).select("p_partkey", F.array_join(F.transform("m", lambda x: x["text"]), " ").alias("shown"), F.array_join(F.transform("m", lambda x: F.concat_ws("-", x["from"].cast("string"), x["to"].cast("string"))), ",").alias("places"))


@query("headword_export", f"WITH {E}, h AS (SELECT entry_id, simp || CASE WHEN entry_id % 3 = 0 THEN 'a1' ELSE '' END AS head FROM e) SELECT entry_id, head, array_to_string(string_split(head, ''), ' ') AS spaced FROM h WHERE NOT regexp_matches(head, '[0-9a-zA-Z]')")
def headword_export(spark, d):
    """Headwords without ASCII letters and digits, and with their characters apart."""
    heads = entries(spark, d).select("entry_id", F.concat("simp", F.when(F.col("entry_id") % 3 == 0, "a1").otherwise("")).alias("head"))
    return heads.where(C.without_latin(F.col("head"))).withColumn("spaced", C.spaced(F.col("head")))


BAD = r"[^\x{3400}-\x{4DFF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}A-Za-z0-9]"


@query("sentence_chunks", f"""WITH {E}, c AS (SELECT entry_id, simp || '！ ' || l || ' ?  ' || trad AS t FROM e), p AS (SELECT entry_id, list_filter(list_transform(regexp_split_to_array(t, ' +'), lambda x: regexp_replace(x, '{BAD}', '', 'g')), lambda x: x <> '') AS cs FROM c)
SELECT entry_id, unnest(cs) AS chunk, unnest(list_transform(cs, lambda x: array_to_string(string_split(x, ''), ' '))) AS spaced FROM p""")
def sentence_chunks(spark, d):
    """Pieces between spaces without bad characters, and with their characters apart."""
    letters = F.translate("simp", SIMP, ALPHABET)
    text = F.concat("simp", F.lit("！ "), letters, F.lit(" ?  "), "trad")
    return entries(spark, d).select("entry_id", F.explode(C.chunks(text)).alias("chunk")).withColumn("spaced", C.spaced(F.col("chunk")))


@query("entry_limits", "SELECT doc_id, length(text) AS n FROM documents WHERE length(text) <= 1024 AND length(left(text, CAST(doc_id % 20 AS INTEGER))) <= 16")
def entry_limits(spark, d):
    """Rows within the limits of a headword and a target text."""
    docs = table(spark, d, "documents")
    return docs.where(C.fits_limits(F.substring("text", F.lit(1), (F.col("doc_id") % 20).cast("int")), F.col("text"))).select("doc_id", F.length("text").cast("long").alias("n"))


@query("cased_stems", f"WITH f AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM conversations), s AS (SELECT w, CASE WHEN length(w) > 4 THEN lower(left(w, 4)) END AS stem FROM f) SELECT w, CASE WHEN stem IS NULL THEN w WHEN upper(left(w, 1)) = left(w, 1) AND lower(left(w, 1)) <> left(w, 1) THEN upper(left(stem, 1)) || substr(stem, 2) ELSE stem END AS stemmed FROM s")
def cased_stems(spark, d):
    """Words with their stem in the word's case; short ones have none."""
    w = table(spark, d, "conversations").select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-zÀ-ÿ]+"), 0)).alias("w")).distinct()
    return w.select("w", C.stem_in_case(F.col("w"), F.when(F.length("w") > 4, F.lower(F.substring("w", 1, 4)))).alias("stemmed"))


@query("sense_checks", f"WITH {E}, s AS (SELECT entry_id, unnest(senses) AS sense, unnest(range(len(senses))) AS sense_ix FROM e) SELECT entry_id, CAST(sense_ix AS INTEGER) AS sense_ix, contains(sense, ',') AS has_comma, sense AS plain FROM s")
def sense_checks(spark, d):
    """Senses with a comma, which should perhaps be two, and the plain text that their parts make."""
    from glossa.sources.entries import sense

    each = entries(spark, d).select("entry_id", F.posexplode("senses").alias("sense_ix", "text")).withColumn("s", sense(F.col("text")))
    return each.select("entry_id", "sense_ix", F.contains("text", F.lit(",")).alias("has_comma"), F.concat("s.domain", "s.equiv", "s.note").alias("plain"))


@query("repository_lines", f"""WITH {E}, r AS (SELECT entry_id, l, CASE WHEN entry_id % 11 = 0 THEN left(simp, 1) ELSE simp END AS simp, CASE WHEN entry_id % 7 = 0 THEN 1 ELSE 0 END AS more, entry_id % 5 = 0 AS open, entry_id % 13 = 0 AS headless FROM e)
SELECT CASE WHEN headless THEN 'header' WHEN length(simp) <> length(l) THEN 'lengths of traditional and simplified differ' WHEN more = 1 THEN 'characters and syllables don''t match' WHEN open THEN 'no slash at the end' ELSE 'kept' END AS outcome, count(*) AS n, CAST(sum(length(l)) AS BIGINT) AS characters FROM r GROUP BY 1""")
def repository_lines(spark, d):
    """Dictionary lines of all entries, some of them spoilt in one way or more: how many are kept, and why the others aren't."""
    from glossa.sources.entries import parse_lines

    n = F.col("entry_id")
    sylls = F.array_join(F.transform("pinyin", lambda s: F.concat(s["text"], (s["tone"] + 1).cast("string"))), " ")
    simp = F.when(n % 11 == 0, F.substring("simp", 1, 1)).otherwise(F.col("simp"))
    line = F.concat(F.when(n % 13 == 0, "").otherwise(F.concat("trad", F.lit(" "))), simp, F.lit(" ["), sylls, F.when(n % 7 == 0, " le5").otherwise(""), F.lit("] /"), F.array_join("senses", "\\"), F.when(n % 5 == 0, "").otherwise("/"))
    parsed = parse_lines(entries(spark, d).select(F.length("simp").alias("size"), line.alias("text")))
    return parsed.groupBy(F.coalesce("error", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("n"), F.sum("size").cast("long").alias("characters"))


@query("readable_characters", "SELECT hanzi, n FROM (SELECT p_brand AS hanzi, count(*) FILTER (WHERE p_size % 7 = 0) AS n FROM part GROUP BY p_brand) WHERE n > 0")
def readable_characters(spark, d):
    """Characters with a reading; the others go. Here brands stand for characters, and some parts for readings."""
    found = table(spark, d, "part").groupBy(F.col("p_brand").alias("hanzi")).agg(F.count(F.when(F.col("p_size") % 7 == 0, 1)).alias("n"))
    return found.where("n > 0")


@query("prefix_ranks", "WITH c AS (SELECT split_part(p_name, ' ', 1) AS prefix, count(*) AS n FROM part GROUP BY 1) SELECT prefix, n, CAST(row_number() OVER (ORDER BY n DESC, prefix) AS INTEGER) AS rank FROM c")
def prefix_ranks(spark, d):
    """First words of names by how often they occur."""
    n = table(spark, d, "part").groupBy(F.substring_index("p_name", " ", 1).alias("prefix")).agg(F.count("*").alias("n"))
    return ranked_by(n, F.desc("n"), F.asc("prefix"))


@query("pre_counts", "WITH t AS (SELECT user_id, max(event_id) AS top_id, count(*) - 1 AS earlier FROM events GROUP BY user_id) SELECT event_id, e.user_id, CASE WHEN event_id = top_id THEN earlier ELSE -1 END AS count_a FROM events e JOIN t ON t.user_id = e.user_id")
def pre_counts(spark, d):
    """Counts of earlier changes written to each user's newest row from a grouped table, and -1 to the others."""
    events = table(spark, d, "events").select("event_id", "user_id")
    top = events.groupBy("user_id").agg(F.max("event_id").alias("top_id"), (F.count("*") - 1).alias("earlier"))
    return events.join(top, "user_id").select("event_id", "user_id", F.when(F.col("event_id") == F.col("top_id"), F.col("earlier")).otherwise(-1).cast("long").alias("count_a"))


@query("truecased", r"""WITH t AS (SELECT unnest(regexp_extract_all(text, '(?:^|[^.!?\s])\s+([A-Za-zÀ-ÿ]+)', 1)) AS form FROM documents), c AS (SELECT lower(form) AS key, form, count(*) AS n FROM t GROUP BY 1, 2),
u AS (SELECT key, max(n) AS n FROM c WHERE form <> key GROUP BY key), l AS (SELECT l.key FROM c l LEFT JOIN u ON u.key = l.key WHERE l.form = l.key AND l.n >= 2 * coalesce(u.n, 0)),
s AS (SELECT doc_id, regexp_extract(text, '^([A-Za-zÀ-ÿ]+)', 1) AS first FROM documents) SELECT doc_id, first, CASE WHEN lower(first) IN (SELECT key FROM l) THEN lower(first) ELSE first END AS shown FROM s WHERE first <> ''""")
def truecased(spark, d):
    """First words of texts, in lower case where that is how they stand inside sentences."""
    from glossa.plans.text import truecase_forms

    lowered = truecase_forms(spark, d).where("lowered").select(F.col("word").alias("key"), F.lit(True).alias("low"))
    first = table(spark, d, "documents").select("doc_id", F.regexp_extract("text", "^([A-Za-zÀ-ÿ]+)", 1).alias("first")).where("first <> ''").withColumn("key", F.lower("first"))
    return first.join(lowered, "key", "left").select("doc_id", "first", F.when(F.col("low"), F.col("key")).otherwise(F.col("first")).alias("shown"))


@query("step_sample", "SELECT event_id, rank FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS rank FROM events) WHERE rank % 49 = 3 AND (rank - 3) // 49 < 15")
def step_sample(spark, d):
    """Every 49th row from the third on, the first 15 of them."""
    from glossa.operators.tokens import sampled

    return sampled(table(spark, d, "events").select("event_id"), "event_id", 49, 15, 3).select("event_id", F.col("rank").cast("long").alias("rank"))


@query("kept_words", f"WITH f AS (SELECT word, count(*) AS freq FROM (SELECT unnest({W}) AS word FROM documents) GROUP BY word) SELECT word, freq FROM f WHERE freq >= 20 AND word IN (SELECT DISTINCT unnest({W}) FROM conversations)")
def kept_words(spark, d):
    """Words that are frequent enough and in a vocabulary, here that of the conversations."""
    from glossa.functions.text import words
    from glossa.operators.tokens import frequencies

    known = table(spark, d, "conversations").select(F.explode(words(F.col("text"))).alias("word")).distinct()
    return frequencies(table(spark, d, "documents")).where("freq >= 20").join(known, "word", "left_semi")


@query("measure_word_counts", f"WITH {MEASURES} SELECT CASE WHEN form = 0 THEN simp ELSE trad END AS simp, count(*) AS n FROM m GROUP BY 1")
def measure_word_counts(spark, d):
    return measure_words(spark, d).groupBy("simp").agg(F.count("*").alias("n"))


@query("entry_sense_counts", r"SELECT n_senses, count(*) AS n FROM (SELECT len(list_filter(regexp_split_to_array(text, '[.!?;]+\s*'), lambda x: x <> '')) AS n_senses FROM conversations) GROUP BY n_senses")
def entry_sense_counts(spark, d):
    """How many entries have so many senses; turns stand for entries, their sentences for senses."""
    senses = F.filter(F.split("text", r"[.!?;]+\s*"), lambda x: x != "")
    return table(spark, d, "conversations").groupBy(F.size(senses).cast("long").alias("n_senses")).agg(F.count("*").alias("n"))


@query("packed_prefixes", "SELECT p_partkey, (CAST(ascii(substr(p_name, 1, 1)) AS BIGINT) << 48) + (CAST(ascii(substr(p_name, 2, 1)) AS BIGINT) << 32) + (CAST(ascii(substr(p_name, 3, 1)) AS BIGINT) << 16) + ascii(substr(p_name, 4, 1)) AS packed FROM part")
def packed_prefixes(spark, d):
    from glossa.functions.text import packed_prefix

    return table(spark, d, "part").select("p_partkey", packed_prefix(F.col("p_name")).alias("packed"))


@query("rank_coverage", """WITH h AS (SELECT o_orderkey AS head, o_custkey AS a, o_orderkey % 700 AS b, CASE WHEN o_orderstatus = 'F' THEN o_orderkey END AS c FROM orders), r AS (SELECT 'a' AS source, a AS rank FROM h UNION ALL SELECT 'b', b FROM h UNION ALL SELECT 'c', c FROM h)
SELECT source, rank // 1000 AS bucket, count(*) AS n FROM r WHERE rank IS NOT NULL GROUP BY 1, 2""")
def rank_coverage(spark, d):
    """How many headwords each of three ranked lists has, by buckets of a thousand ranks."""
    o = table(spark, d, "orders")
    lists = {"a": o.select(F.col("o_custkey").alias("rank")), "b": o.select((F.col("o_orderkey") % 700).alias("rank")), "c": o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("rank"))}
    from functools import reduce

    stacked = reduce(lambda x, y: x.unionByName(y), (df.select(F.lit(k).alias("source"), "rank") for k, df in lists.items()))
    return stacked.groupBy("source", F.expr("rank div 1000").alias("bucket")).agg(F.count("*").alias("n"))
