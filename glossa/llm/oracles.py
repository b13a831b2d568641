"""DuckDB SQL for the operators that SQL can express."""

QUALITY = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d
), spots AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g FROM spots
), twice AS (
  SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), uniq AS (
  SELECT DISTINCT host, text, lines FROM w
), each AS (
  SELECT host, text, unnest(lines) AS line FROM uniq
), norm AS (
  SELECT host, text, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[\x20\x09-\x0D]+', ' ', 'g')) AS line,
    len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words
  FROM each
), common AS (
  SELECT host, line FROM norm GROUP BY host, line HAVING count(DISTINCT text) >= 20
), removed AS (
  SELECT host, text, sum(words) AS n FROM norm JOIN common USING (host, line) GROUP BY host, text
), counted AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(len(words) - coalesce(removed.n, 0) AS BIGINT) AS n_left_words
  FROM w LEFT JOIN covered ON covered.doc_id = w.doc_id LEFT JOIN removed ON removed.host = w.host AND removed.text = w.text
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left_words >= 50 AND n_left_words >= 0.3 * n_words AS kept
FROM counted
"""

JACCARD = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), spots AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM w WHERE len(words) > 0
), grams AS (
  SELECT DISTINCT doc_id, array_to_string(words[i:i + 2], ' ') AS g FROM spots
), sizes AS (
  SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y
), links AS (
  SELECT x, y FROM shared JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * k >= 90 * (s.n + t.n - k)
), edges AS (
  SELECT x AS u, y AS v FROM links UNION SELECT y, x FROM links
), reach AS (
  SELECT u, v FROM edges UNION SELECT r.u, e.v FROM reach r JOIN edges e ON e.u = r.v
)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(lo, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN (SELECT u, min(v) AS lo FROM reach GROUP BY u) r ON r.u = w.doc_id
"""

WARC = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, upper(sha1(coalesce(html, ''))) AS h FROM pages
), t AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS top,
    list_transform(range(8), lambda k: substr(h, CAST(1 + 5 * k AS INTEGER), 5)) AS fives
  FROM p
), n AS (
  SELECT *, list_transform(fives, lambda x: list_sum(list_transform(range(5), lambda j: (strpos('0123456789ABCDEF', substr(x, CAST(j + 1 AS INTEGER), 1)) - 1) * CAST(pow(16, 4 - j) AS BIGINT)))) AS numbers FROM t
)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(numbers, lambda v: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ((CAST(v AS BIGINT) >> s) & 31) AS INTEGER), 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM n
"""

SUFFIXES = r"""
WITH d AS (
  SELECT doc_id, encode(coalesce(text, '')) AS b, strlen(coalesce(text, '')) AS n FROM documents
), w AS (
  SELECT doc_id, b, unnest(range(0, n - 399)) AS s FROM d WHERE n >= 400
), h AS (
  SELECT doc_id, s, md5(array_slice(b, s + 1, s + 400)) AS h FROM w
), dup AS (
  SELECT doc_id, s FROM h QUALIFY count(*) OVER (PARTITION BY h) > 1
), starts AS (
  SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 400 THEN 0 ELSE 1 END AS fresh FROM dup
), runs AS (
  SELECT doc_id, min(s) AS lo, max(s) + 400 AS hi FROM (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS run FROM starts) GROUP BY doc_id, run
), gone AS (
  SELECT doc_id, CAST(sum(hi - lo) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
), edges AS (
  SELECT doc_id, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS x, lo AS y FROM runs
  UNION ALL SELECT doc_id, max(hi), NULL FROM runs GROUP BY doc_id
  UNION ALL SELECT doc_id, 0, NULL FROM d WHERE doc_id NOT IN (SELECT doc_id FROM runs)
), kept AS (
  SELECT d.doc_id, sha256(unhex(coalesce(string_agg(hex(array_slice(b, x + 1, coalesce(y, n))), '' ORDER BY x) FILTER (WHERE x < coalesce(y, n)), ''))) AS kept_sha256 FROM d JOIN edges USING (doc_id) GROUP BY d.doc_id
), t AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), spots AS (
  SELECT doc_id, words, unnest(range(0, len(words) - 49)) AS s FROM t WHERE len(words) >= 50
), word_dup AS (
  SELECT doc_id, s FROM (SELECT doc_id, s, md5(array_to_string(words[s + 1:s + 50], ' ')) AS h FROM spots) QUALIFY count(*) OVER (PARTITION BY h) > 1
), shared AS (
  SELECT doc_id, CAST(sum(least(50, coalesce(after - s, 50))) AS BIGINT) AS n_repeated_words FROM (SELECT doc_id, s, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS after FROM word_dup) GROUP BY doc_id
)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256, coalesce(n_repeated_words, 0) AS n_repeated_words
FROM d JOIN kept USING (doc_id) LEFT JOIN gone USING (doc_id) LEFT JOIN shared USING (doc_id)
"""


def licences() -> str:
    """SQL of the licence scan, with the operator's sentences and rules as literals."""
    from glossa.llm import licenses as li

    text = lambda s: "'" + s.replace("'", "''") + "'"
    known = li.pieces()
    keys = "MAP {" + ", ".join(f"{text(' | '.join(run))}: {text(letter)}" for letter, run in known) + "}"
    longest = max(len(run) for _, run in known)
    tries = ", ".join(f"k[array_to_string(p[i:i + {n - 1}], ' | ')]" for n in range(longest, 0, -1))
    ends = r"regexp_replace({0}, '([.!?;:])[\x20\x09-\x0D]+', '\1' || chr(1), 'g')"
    cut = r"list_filter(list_transform(regexp_split_to_array({0}, '{1}'), lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '')"
    letters = f"array_to_string(list_transform(range(1, len(p) + 1), lambda i: coalesce({tries}, '')), '')"
    families: dict[str, list] = {}
    for name, family, rule in li.RULES:
        families.setdefault(family, []).append((name, li.pattern_of(rule)))
    case = lambda c, rules: "CASE " + " ".join(f"WHEN regexp_matches({c}, {text(p)}) THEN {i}" for i, (_, p) in rules) + " END"
    order = [name for name, _, _ in li.RULES]
    best = ", ".join(f"least({case('text_ids', [(order.index(n), (n, p)) for n, p in rules])}, {case('line_ids', [(order.index(n), (n, p)) for n, p in rules])})" for rules in families.values())
    names = "[" + ", ".join(map(text, order)) + "]"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT doc_id, CASE WHEN regexp_matches(t, '(?i){li.STEMS}') THEN t ELSE '' END AS t, {keys} AS k FROM d),
c AS (SELECT doc_id, k, {cut.format(ends.format("t"), chr(92) + "x01|" + chr(92) + "n+")} AS a, {cut.format(ends.format("t"), chr(92) + "x01|" + chr(92) + "n[" + chr(92) + "x20" + chr(92) + "t]*" + chr(92) + "n[" + chr(92) + "x20" + chr(92) + "x09-" + chr(92) + "x0D]*")} AS b FROM g),
l AS (SELECT doc_id, (SELECT {letters} FROM (SELECT a AS p)) AS line_ids, (SELECT {letters} FROM (SELECT b AS p)) AS text_ids FROM c),
f AS (SELECT *, list_filter([{best}], lambda x: x IS NOT NULL) AS found FROM l)
SELECT doc_id, CAST(greatest(length(line_ids) - length(replace(line_ids, '<', '')), length(text_ids) - length(replace(text_ids, '<', ''))) AS BIGINT) AS n_sentences, line_ids, text_ids, array_to_string(list_sort(list_transform(found, lambda x: {names}[x + 1])), ',') AS licences FROM f
"""

#: Equal texts share a window; the row with the largest doc_id stays.
EXACT = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""

#: Levels of each language's tree, then of the tree over their roots, by recursion; crc32 bit by bit; a fold along each row's siblings.
MERKLE = """WITH RECURSIVE
v AS (SELECT *, CAST(doc_id AS VARCHAR) AS i FROM documents),
c AS (SELECT *, (xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(i, ''), lambda x: CAST(ascii(x) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda y, k: xor(y >> 1, (y & 1) * 3988292384))), 4294967295)) % 7 = 0 AS hit FROM v),
e AS (SELECT doc_id, lang, hit, n_chars, coalesce(strlen(i) || ':' || i, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM c),
l AS (SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
  CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS changed FROM e),
d AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
tree AS (SELECT lang, 0 AS lev, pos, leaf AS h, n FROM d
  UNION ALL SELECT lang, lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lev, pos // 2, n),
sub AS (SELECT lang, lev AS depth, h AS subroot FROM tree WHERE n = 1),
s AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM sub),
over AS (SELECT 0 AS lev, pos, subroot AS h, n FROM s
  UNION ALL SELECT lev + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM over WHERE n > 1 GROUP BY lev, pos // 2, n),
top AS (SELECT lev AS height, h AS root FROM over WHERE n = 1),
up AS (SELECT doc_id, leaf, d.lang, subroot, depth, s.pos AS place, 0 AS lev, d.pos, '' AS proof, coalesce(changed, leaf) AS h FROM d JOIN s ON s.lang IS NOT DISTINCT FROM d.lang
  UNION ALL SELECT doc_id, leaf, u.lang, subroot, depth, place, u.lev + 1, u.pos // 2, proof || coalesce(t.h, ''), sha256(CASE WHEN u.pos % 2 = 1 THEN t.h || u.h ELSE u.h || coalesce(t.h, '') END)
  FROM up u LEFT JOIN tree t ON t.lang IS NOT DISTINCT FROM u.lang AND t.lev = u.lev AND t.pos = xor(u.pos, 1) WHERE u.lev < depth),
further AS (SELECT doc_id, leaf, subroot, 0 AS lev, place AS pos, proof, h FROM up WHERE lev = depth
  UNION ALL SELECT doc_id, leaf, subroot, u.lev + 1, u.pos // 2, proof || coalesce(t.h, ''), sha256(CASE WHEN u.pos % 2 = 1 THEN t.h || u.h ELSE u.h || coalesce(t.h, '') END)
  FROM further u LEFT JOIN over t ON t.lev = u.lev AND t.pos = xor(u.pos, 1) WHERE u.lev < (SELECT height FROM top))
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified FROM further, top WHERE lev = height"""
