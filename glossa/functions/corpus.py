"""Expressions of corpus cleaning and of the dictionary's texts: merge rules, cleansing, measure words, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import HANZI, let

# Characters that can't end or start a merged word, what single characters may merge to, determiners and classifiers.
NO_END, NO_START = "不这那哪", "们的"
LIMITS = {
    "吗": "", "很": "", "我": "我国 我家 我们 忘我 自我", "你": "你好 你们 迷你", "他": "他们 他人 吉他 其他", "她": "她们", "的": "的话 的确 别的 目的 是的 似的 有的 真的",
    "是": "是不是 是的 是非 是否 不是 但是 倒是 而是 凡是 还是 或是 即是 就是 可是 老是 算是 要是 于是 真是 只是 总是", "了": "了结 了解 罢了 除了 得了 对了 极了 完了 为了",
}
DETERMINERS = "这那哪一"
CLASSIFIERS = "把包杯本部串床顶堵对份封副个根罐户家架间件届斤句卷棵课口块辆轮匹瓶起群首双艘台套条头位张只枝支坐"
# Scores from which a highlight is low, middle and high, of Chinese and of target text.
BANDS = {"zh": (0.00075, 0.0075, 0.015), "trg": (0.001, 0.01, 0.03)}
LETTERS = {"en": "E", "de": "D", "hu": "H", "jian": "J", "fan": "F"}


def merge_blocked(a: Column, b: Column) -> Column:
    """Whether two neighbouring tokens must not become one."""
    merged = F.concat(a, b)

    def single(x, banned):
        limited = F.lit(False)
        for c, allowed in LIMITS.items():
            limited = limited | ((x == c) & ~merged.isin(*(allowed.split() or [""])))
        return (F.length(x) == 1) & (x.isin(*banned) | limited)

    pair = F.substring(a, 1, 1).isin(*DETERMINERS) & F.substring(b, 1, 1).isin(*CLASSIFIERS)
    return single(a, NO_START) | single(b, NO_END) | pair


def bad_stems(n: Column, bad: Column) -> Column:
    """Whether too many of a segment's n tokens have no stem."""
    return (n == 0) | (bad >= 3) | ((n <= 3) & (bad > 0)) | ((n > 3) & (bad * 3 >= n))


def without_latin(head: Column) -> Column:
    return ~head.rlike("[0-9a-zA-Z]")


def spaced(text: Column) -> Column:
    """Characters with a space between them."""
    return F.array_join(F.filter(F.split(text, ""), lambda c: c != ""), " ")


def chunks(text: Column, bad: str = r"[^\x{3400}-\x{4DFF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}A-Za-z0-9]") -> Column:
    """Pieces between spaces, without bad characters; empty ones go."""
    return F.filter(F.transform(F.split(text, " +"), lambda c: F.regexp_replace(c, bad, "")), lambda c: c != "")


def fits_limits(simp: Column, target: Column) -> Column:
    return (F.length(simp) <= 16) & (F.length(target) <= 1024)


def clamped(freq: Column) -> Column:
    return F.least(F.coalesce(freq, F.lit(0)), F.lit(65535))


def cleansed(line: Column) -> Column:
    """A dictionary line put right: odd spaces and quotes, entities, brackets of other kinds, spaces around commas, parentheses and senses."""
    for old, new in ((" ", " "), ("\t", " "), ("“", '"'), ("”", '"'), ("(u.E.)", ""), ("&gt", ">"), ("&quot", '"')):
        line = F.replace(line, F.lit(old), F.lit(new))
    line = F.regexp_replace(line, r"<([^>/]+)>", "($1)")
    head, body = F.substring_index(line, "/", 1), F.regexp_extract(line, r"(?s)^[^/]*(/.*)$", 1)
    line = F.concat(head, F.regexp_replace(body, r"\[([^\]/]+)\]", "($1)"))
    for pattern, new in ((r",(\p{L})", ", $1"), (" {2,}", " "), (r"\( *([^)]+)\)", "($1)"), (r" +\)", ")")):
        line = F.regexp_replace(line, pattern, new)
    head, body = F.substring_index(line, "/", 1), F.regexp_extract(line, r"(?s)^[^/]*(/.*)$", 1)
    return F.concat(head, F.replace(F.replace(body, F.lit("/ "), F.lit("/")), F.lit(" /"), F.lit("/")))


def entry_line(head: Column, target: Column) -> Column:
    """The line of an entry from its headword and a text with a sense a line; slashes inside senses become backslashes."""
    senses = F.filter(F.transform(F.split(F.replace(target, F.lit("\r\n"), F.lit("\n")), "\n"), lambda s: F.replace(s, F.lit("/"), F.lit("\\"))), lambda s: s != "")
    return F.when(head.rlike(r"^[^ ]+ [^ ]+ \[[^\]]+\]$"), F.concat(head, F.lit(" /"), F.array_join(senses, "/"), F.lit("/")))


def measure_words(sense: Column) -> Column:
    """trad, simp and pinyin of each measure word of a sense such as SZ:個|个[ge4],本[ben3]."""
    items = F.regexp_extract_all(F.regexp_replace(sense, "^[^:]*:", ""), F.lit(r"(?:^|,)([^,\[\]|](?:\|[^,\[\]|])?\[[^\]]*\])"), 1)
    one = lambda x: F.struct(F.substring(x, 1, 1).alias("trad"), F.when(F.substring(x, 2, 1) == "|", F.substring(x, 3, 1)).otherwise(F.substring(x, 1, 1)).alias("simp"), F.regexp_extract(x, r"\[([^\]]*)\]", 1).alias("pinyin"))
    return F.transform(items, one)


def merged_erhua(pinyin: Column) -> Column:
    """text and tone of each shown syllable, and from and to, its places in the given run: r with the neutral tone joins the one before."""
    is_r = lambda s: (s["text"] == "r") & (s["tone"] == 0)

    def step(acc, x):
        last = F.try_element_at(acc, F.lit(-1))
        joined = F.struct(F.concat(last["text"], F.lit("r")).alias("text"), last["tone"].alias("tone"), last["from"].alias("from"), x["i"].alias("to"))
        new = F.struct(x["s"]["text"].alias("text"), x["s"]["tone"].alias("tone"), x["i"].alias("from"), x["i"].alias("to"))
        return F.when(is_r(x["s"]) & last.isNotNull(), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(joined))).otherwise(F.concat(acc, F.array(new)))

    numbered = F.transform(pinyin, lambda s, i: F.struct(s.alias("s"), i.alias("i")))
    return F.aggregate(numbered, F.array().cast("array<struct<text:string,tone:int,from:int,to:int>>"), step)


def band(score: Column, side: str) -> Column:
    """none, lo, mid or hi of a highlight's score."""
    low, middle, top = BANDS[side]
    return F.when(score >= top, "hi").when(score >= middle, "mid").when(score >= low, "lo").otherwise("none")


def short_count(n: Column, comma: Column) -> Column:
    """Counts from 10,000 on as thousands with one place after the point, or a comma."""
    return F.when(n < 10_000, n.cast("string")).otherwise(F.concat((n / 1000).cast("long").cast("string"), F.when(comma, ",").otherwise("."), (F.pmod(n, F.lit(1000)) / 100).cast("long").cast("string"), F.lit("k")))


def size_text(n: Column) -> Column:
    part = lambda unit, name: F.concat((n / unit).cast("long").cast("string"), F.lit("."), (F.pmod(n, F.lit(unit)) / (unit // 10)).cast("long").cast("string"), F.lit(name))
    return F.when(n >= 1_000_000, part(1_000_000, "MB")).when(n >= 1000, part(1000, "KB")).otherwise(F.concat(n.cast("string"), F.lit(" byte")))


def language_letter(code: Column) -> Column:
    out = F.lit("X")
    for name, letter in LETTERS.items():
        out = F.when(code == name, letter).otherwise(out)
    return out


def path_language(path: Column) -> Column:
    """lang and rel of a path such as hu/read/about; null where it starts with no language."""
    ok = path.rlike("^(en|de|hu)(/|$)")
    return F.when(ok, F.struct(F.substring(path, 1, 2).alias("lang"), F.substring(path, F.lit(4), F.length(path)).alias("rel")))


def chinese_date(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("年"), F.month(day).cast("string"), F.lit("月"), F.dayofmonth(day).cast("string"), F.lit("日"))


def head_faults(head: Column, known: Column, simple: Column) -> Column:
    """What is wrong with a simplified headword: space, foreign, unknown, traditional; known and simple are arrays of characters."""
    chars = F.filter(F.split(head, ""), lambda c: c != "")

    def fault(c):
        hanzi = c.rlike(f"^{HANZI}$")
        free = c.rlike("^[A-Z0-9]$")
        return F.when(c.rlike(r"^[\p{P}\s]$"), "space").when(~hanzi & ~free, "foreign").when(hanzi & ~F.array_contains(known, c), "unknown").when(hanzi & ~F.array_contains(simple, c), "traditional")

    return F.array_sort(F.array_distinct(F.filter(F.transform(chars, fault), lambda f: f.isNotNull())))


def addable(head: Column, simple: Column) -> Column:
    """Whether a query may become a headword: at most six characters, all of them simplified ones."""
    return (F.length(head) <= 6) & F.forall(F.filter(F.split(head, ""), lambda c: c != ""), lambda c: F.array_contains(simple, c))


def stem_in_case(token: Column, stem: Column) -> Column:
    """The stem, with a capital where the token has one."""
    upper = (F.upper(F.substring(token, 1, 1)) == F.substring(token, 1, 1)) & (F.lower(F.substring(token, 1, 1)) != F.substring(token, 1, 1))
    return F.when(stem.isNull(), token).when(upper, F.concat(F.upper(F.substring(stem, 1, 1)), F.substring(stem, F.lit(2), F.length(stem)))).otherwise(stem)


def bpe_map(surface: Column, tokens: Column) -> Column:
    """(token, start, length) of BPE tokens in their surface text, found one after the other; null where one isn't found.

    Tokens that start with punctuation are left out; joiners and a full stop or comma at the end come off.
    """
    clean = F.filter(F.split(tokens, " "), lambda t: (t != "") & ~t.rlike(r"^\p{P}"))
    bare = F.transform(clean, lambda t: F.regexp_replace(F.replace(t, F.lit("￭"), F.lit("")), "[.,]$", ""))
    begin = F.struct(F.lit(1).alias("at"), F.lit(True).alias("ok"), F.array().cast("array<struct<token:string,start:int,length:int>>").alias("out"))

    def found(acc, t, at):
        ok = acc["ok"] & (t != "") & (at > 0)
        return F.when(ok, F.struct((at + F.length(t)).alias("at"), F.lit(True).alias("ok"), F.concat(acc["out"], F.array(F.struct(t.alias("token"), (at - 1).alias("start"), F.length(t).alias("length")))).alias("out"))).otherwise(F.struct(acc["at"].alias("at"), F.lit(False).alias("ok"), acc["out"].alias("out")))

    # text and place are bound, as they may be long expressions
    step = lambda text: lambda acc, t: let(_located(text, t, acc["at"]), lambda at: found(acc, t, at))
    return let(surface, lambda text: F.aggregate(bare, begin, step(text), lambda acc: F.when(acc["ok"] & (F.size(acc["out"]) > 0), acc["out"])))


def _located(text: Column, part: Column, start: Column) -> Column:
    """Place (from 1) of part in text, from a start on; 0 without one."""
    return F.call_function("locate", part, text, start)


def stem_map(surface: Column, tokens: Column) -> Column:
    """(stem, start, length) of stem tokens `pieces/stem#surface`: a compound's stems share its surface, the last one taking what is left."""
    parsed = F.transform(F.split(tokens, " "), lambda t: F.struct(F.substring(t, 1, 1).try_cast("int").alias("n"), F.regexp_extract(t, "^[0-9]/([^#]*)#", 1).alias("stem"), F.regexp_extract(t, "#(.*)$", 1).alias("surf")))
    begin = F.struct(F.lit(1).alias("at"), F.lit(0).alias("left"), F.lit(0).alias("used"), F.array().cast("array<struct<stem:string,start:int,length:int>>").alias("out"))

    def step(acc, t):
        fresh = acc["left"] == 0
        at = F.when(fresh, _located(surface, t["surf"], acc["at"])).otherwise(acc["at"])
        left = F.when(fresh, t["n"]).otherwise(acc["left"])
        used = F.when(fresh, 0).otherwise(acc["used"])
        length = F.when(left > 1, F.least(F.length(t["stem"]), F.length(t["surf"]) - used)).otherwise(F.length(t["surf"]) - used)
        return F.struct((at + length).alias("at"), (left - 1).alias("left"), (used + length).alias("used"), F.concat(acc["out"], F.array(F.struct(t["stem"].alias("stem"), (at - 1).alias("start"), length.alias("length")))).alias("out"))

    return F.aggregate(F.filter(parsed, lambda t: t["n"].isNotNull()), begin, step, lambda acc: F.when(F.size(acc["out"]) > 0, acc["out"]))
