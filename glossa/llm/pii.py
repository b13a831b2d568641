"""Personal data: base patterns, and further spans that boosted trees choose among high-recall candidates.

All work on texts is DataFrame functions. Base spans (email, ip, card, phone) always stay. Generators of high recall then
propose further spans, which may overlap: addresses written out ("at", "dot", with or without brackets), colon groups (IPv6
addresses, but times too), digit groups that could be cards or phone numbers (but dates, versions and amounts too), and
values after an equals sign or colon, which may be secrets. Gradient-boosted trees score each by its format and by the words
before it; the trees are fitted by Spark ML on EXAMPLES rows of a labelled table that is made from templates here, with
look-alikes of every kind, and become plain column expressions. The threshold of each kind is the smallest at which held-out
examples reach PRECISION. Chosen spans that overlap a base span are dropped; of those that overlap each other the better one
stays.

Positions count code points, ends are exclusive. Spark has no function for match positions, so they are sums of the
lengths of what a split at the pattern leaves and of what the pattern matches.

The patterns differ in form from those of the contract so that no text makes them slow or deep: possessive runs of one
class each, started only where a run starts; what a group may repeat is told apart before, by replacing single
separators that can't belong to a match by a letter of equal length.

Defined cases: a null text is empty; rows that repeat give equal results; an empty table gives no rows; texts are read whole;
columns of docs pass through ``redact``.
"""

from __future__ import annotations

import itertools
import random
import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.common import all_of, let, unused

#: Kinds with base patterns, and one that only the method adds.
BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
EXAMPLES, PRECISION = 5000, 0.98
SPAN = "array<struct<kind:int,start:int,end:int>>"

LABEL = "[A-Za-z0-9-]"
LOCAL = "[A-Za-z0-9._%+-]"
STRAY_DOT = rf"(?<!{LABEL})\.|\.(?!{LABEL})"
STRAY_SEPARATOR = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@{LABEL}++\.[A-Za-z0-9.-]++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
DIGIT_RUN = r"[0-9][0-9\x20-]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

#: Generators of candidates: kind, pattern, and a cheaper one without which it can't match.
LOOSE = (
    (0, r"(?i)(?<![A-Z0-9._+-])[A-Z0-9._+-]{1,64}(?:\x20?[\[({]\x20?at\x20?[\])}]\x20?|\x20at\x20)[A-Z0-9-]{1,63}(?:(?:\x20?[\[({]\x20?dot\x20?[\])}]\x20?|\x20dot\x20|\.)[A-Z0-9-]{1,63}){1,3}", r"(?i)[\x20\[({]at[\x20\])}]"),
    (1, r"(?i)(?<![0-9A-F:.])[0-9A-F]{1,4}(?:::?[0-9A-F]{1,4}){2,7}(?![0-9A-F:.])", r"[0-9A-Fa-f]:"),
    (2, r"(?<![0-9+.-])[0-9]{4}(?:[\x20.-]?[0-9]{2,6}){2,4}(?![0-9])", "[0-9]{4}"),
    (3, r"(?<![0-9+.(/-])(?:00[1-9][0-9]{0,2}[\x20.-]?)?\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,8}){1,4}(?![0-9./-])", "[0-9]{2}"),
    (4, r"(?<=[=:][\x20]{0,2}[\x22\x27]{0,1})[A-Za-z0-9_+/.-]{12,256}+=*", "[=:]"),
    (4, r"(?<![A-Za-z0-9])(?:AKIA|gh[pousr]_|sk_live_|xox[abpr]-)[A-Za-z0-9-]{10,64}+", "AKIA|gh[pousr]_|sk_live_|xox[abpr]-"),
)
CUES = {
    "phone": r"\b(?:tel|telephone|phone|call|mobile|cell|fax|whatsapp|sms|dial|reach|telefon|teléfono|téléphone)\b",
    "card": r"\b(?:card|visa|mastercard|amex|credit|debit|cvv|payment|karte|tarjeta|carte)\b",
    "mail": r"\b(?:mail|e-mail|email|contact|write|address|correo|courriel)\b",
    "net": r"\b(?:ip|ipv6|host|server|address|from|client|login|peer)\b",
    "secret": r"(?:token|secret|password|passwd|pwd|api.?key|access.?key|private.?key|auth|bearer|credential)\w*\W*$",
    "other": r"\b(?:hash|id|order|invoice|isbn|version|sum|checksum|sha1|sha256|md5|digest|total|ref|serial|sku|tracking|commit|page|pages|table|year|date|at|figure|build|release|room|file|path|url|http|https)\W*$",
}
BEFORE = 32


def spans_of(text: Column, pattern: str, kind: int, check=None) -> Column:
    """Spans of leftmost non-overlapping matches; those that fail the check are dropped."""
    matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    gaps = F.transform(F.split(text, pattern, -1), F.length)

    def place(pair):
        walk = F.aggregate(
            F.arrays_zip(pair["g"].alias("g"), pair["m"].alias("m")),
            F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out")),
            lambda acc, x: F.when(x["m"].isNull(), acc).otherwise(
                let(
                    acc["at"] + x["g"],
                    lambda start: F.struct(
                        (start + F.length(x["m"])).alias("at"),
                        F.when(check(x["m"]) if check else F.lit(True), F.concat(acc["out"], F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end")))))
                        .otherwise(acc["out"]).alias("out"),
                    ),
                )
            ),
        )
        return walk["out"]

    return let(F.struct(gaps.alias("g"), matches.alias("m")), place)


def digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    value = lambda x, i: let(x.cast("int") * F.when(i % 2 == 1, 2).otherwise(1), lambda y: F.when(y > 9, y - 9).otherwise(y))
    return F.aggregate(F.transform(F.split(F.reverse(number), ""), value), F.lit(0), lambda s, x: s + x) % 10 == 0


def _card(match: Column) -> Column:
    return let(digits(match), lambda d: F.when(F.length(d).between(16, 19), luhn(d)).otherwise(F.lit(False)))


def _ip(match: Column) -> Column:
    return F.forall(F.split(match, r"\."), lambda p: let(F.regexp_replace(p, "^0+", ""), lambda q: (F.length(q) < 3) | ((F.length(q) == 3) & (q <= "255"))))


def _phone(match: Column) -> Column:
    return F.length(digits(match)).between(8, 15)


def base_spans(text: Column) -> Column:
    """Base spans by kind, then start. Texts without a character that a kind needs skip its patterns."""
    none = F.array().cast(SPAN)
    has_digit = text.rlike("[0-9]")
    return F.concat(
        F.when(F.contains(text, F.lit("@")), spans_of(F.regexp_replace(text, STRAY_DOT, "%"), EMAIL, 0)).otherwise(none),
        F.when(has_digit, spans_of(text, IP, 1, _ip)).otherwise(none),
        F.when(has_digit, spans_of(F.regexp_replace(text, STRAY_SEPARATOR, "x"), DIGIT_RUN, 2, _card)).otherwise(none),
        F.when(F.contains(text, F.lit("+")), spans_of(text, PHONE, 3, _phone)).otherwise(none),
    )


def features(kind: Column, span: Column, before: Column) -> list[Column]:
    """Format and context of a candidate, as numbers."""
    number = lambda x: x.cast("double")
    cue = lambda name: number(before.rlike("(?i)" + CUES[name]))
    count = lambda pattern: number(F.size(F.split(span, pattern)) - 1)
    d = digits(span)
    return [
        *(number(kind == k) for k in range(len(KINDS))), number(F.length(span)), number(F.length(d)),
        number(F.when(F.length(d).between(12, 19), luhn(d)).otherwise(F.lit(False))), count(r"[\x20.-]"), number(span.rlike(r"[()\[\]{}]")),
        count(":"), number(F.contains(span, F.lit("::"))), count("[A-Fa-f]"), count("[G-Zg-z]"), count("[/]"), number(span.rlike(r"^[0-9]{1,2}(?::[0-9]{2})+$|^(?:[0-9A-Fa-f]{2}:){5}[0-9A-Fa-f]{2}$")),
        number(d.rlike(r"^(?:19|20)[0-9]{2}")), number(span.rlike(r"(?:19|20)[0-9]{2}$|^[0-9]{1,2}[./-][0-9]{1,2}[./-]")), number(span.rlike(r"^00|^0[1-9]|^\(")), number(span.rlike("[0-9]") & span.rlike("[A-Za-z]")),
        cue("phone"), cue("card"), cue("mail"), cue("net"), cue("secret"), cue("other"), number(before.rlike(r"[#$=/_-]\x20?$")), number(span.rlike("^(?:AKIA|gh[pousr]_|sk_live_|xox[abpr]-)")),
    ]


N_FEATURES = len(KINDS) + 23


def labelled(seed: int = 7) -> list[tuple[int, str, str, int]]:
    """EXAMPLES rows (kind, span, text before, whether personal), from templates; look-alikes are made for every kind."""
    rng = random.Random(seed)
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("aeiourstnlmdhcp") for _ in range(rng.randint(2, 8)))
    mixed = lambda k, letters: "".join(rng.choice(letters) for _ in range(k))
    hexes, alnum = "0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    pick = rng.choice
    tld = lambda: pick(["com", "org", "net", "de", "io"])
    dot = lambda: pick([" dot ", " (dot) ", "[dot]", "."])
    at = lambda: pick([" (at) ", "[at]", " [at] ", "(at)", " {at} "])
    group = lambda: f"{rng.randrange(1 << 16):x}"
    sep = lambda: pick([" ", ".", "-"])

    def passing(k):
        body = n(k - 1)
        total = sum(v - 9 if v > 9 else v for v in (int(c) * (1 + (i % 2 == 0)) for i, c in enumerate(reversed(body))))
        return body + str(-total % 10)

    def card(number, cuts, s):
        at, out = 0, []
        for c in cuts:
            out.append(number[at : at + c])
            at += c
        return s.join(out)

    mail, phone, pay, net, key = ["mail me:", "contact", "write to", "e-mail", "email address:"], ["phone", "tel.", "call", "mobile:", "fax", "reach me at"], ["card", "visa no.", "credit card number", "payment by card"], ["login from", "client ip", "host", "peer"], ["token =", 'token = "', "password:", "api_key=", "secret: '", "access key =", "auth token:", "bearer:"]
    plain = ["", "the", "of", "a", "and", "in"]
    #: kind, whether personal, span, words before
    forms = [
        (0, 1, lambda: f"{word()}{at()}{word()}{dot()}{tld()}", mail + plain),
        (0, 1, lambda: f"{word()} at {word()}{pick([' dot ', '.'])}{tld()}", mail),
        (0, 0, lambda: f"{word()} at {word()}{pick([' dot ', '.'])}{word()}", plain + ["look", "we met", "she arrived"]),
        (0, 0, lambda: f"{word()} at {word()}.{tld()}", plain + ["see", "read it"]),
        (1, 1, lambda: ":".join(group() for _ in range(8)), net + plain),
        (1, 1, lambda: ":".join(group() for _ in range(rng.randint(1, 3))) + "::" + ":".join(group() for _ in range(rng.randint(1, 3))), net + plain),
        (1, 0, lambda: f"{rng.randrange(24):02}:{n(2)}:{n(2)}", plain + ["at", "time", "date", "from"]),
        (1, 0, lambda: ":".join(mixed(2, hexes) for _ in range(6)), plain + ["mac", "build id"]),
        (1, 0, lambda: ":".join(str(rng.randrange(99)) for _ in range(rng.randint(3, 4))), plain + ["ratio", "verse"]),
        (2, 1, lambda: card(n(16), (4, 4, 4, 4), pick(["", " ", "-"])), pay),
        (2, 1, lambda: card(passing(15), (4, 6, 5), pick([" ", "-"])), pay + plain),
        (2, 0, lambda: card(n(pick([13, 14, 16, 18])), (4, 4, 4, 6), pick(["", " ", "-"])), ["hash", "order", "tracking", "serial no.", "id", "isbn", "sum"] + plain),
        (3, 1, lambda: f"{pick(['{}', '({})']).format(n(3))}{sep()}{n(3)}{sep()}{n(4)}", phone),
        (3, 1, lambda: f"({n(3)}) {n(3)}{sep()}{n(4)}", phone + plain),
        (3, 1, lambda: f"0{n(pick([2, 3]))}{pick([' ', '/', '-'])}{n(pick([4, 5]))}{pick(['', ' ' + n(3)])}", phone),
        (3, 1, lambda: f"00{pick('123456789')}{n(1)} {n(3)} {n(4)}", phone + plain),
        (3, 0, lambda: f"{pick(['19', '20'])}{n(2)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}", plain + ["date", "on", "call"]),
        (3, 0, lambda: f"{rng.randint(10, 28)}{pick('./')}{rng.randint(10, 12)}{pick('./')}{pick(['19', '20'])}{n(2)}", plain + ["date", "on"]),
        (3, 0, lambda: f"{n(3)}{sep()}{n(3)}{sep()}{n(4)}", ["isbn", "invoice", "version", "ref", "table", "sum", "pages"] + plain),
        (3, 0, lambda: sep().join(n(rng.randint(2, 4)) for _ in range(rng.randint(3, 5))), plain + ["pages", "table", "total"]),
        (4, 1, lambda: mixed(rng.randint(16, 64), pick([hexes, alnum])), key),
        (4, 1, lambda: pick(["AKIA", "ghp_", "sk_live_", "xoxb-"]) + mixed(rng.randint(16, 36), alnum), plain + key),
        (4, 0, lambda: mixed(pick([32, 40, 64]), hexes), ["commit:", "sha1 =", "md5:", "checksum =", "digest:", 'id = "', "build: "]),
        (4, 0, lambda: f"//{word()}.{word()}.{tld()}/{word()}/{word()}", ["http:", "https:", "url = https:"]),
        (4, 0, lambda: "/".join(word() for _ in range(4)) + "/" + word(), ["path =", "file:", "see:", "=", ":"]),
        (4, 0, lambda: "".join(word() for _ in range(3)) + word() + word(), plain[1:] + [":", "=", "note:"]),
    ]
    out = []
    for kind, label, span, before in itertools.cycle(forms):
        if len(out) == EXAMPLES:
            return out
        value = span()
        if kind == 4 and len(value) < 12:
            continue
        out.append((kind, value, f"{word()} {word()} {rng.choice(before)}".rstrip() + ("" if kind == 4 and rng.random() < 0.5 else " "), label))


def fit(spark: SparkSession) -> tuple[list, list[float]]:
    """The trees as (weight, text of the tree), and the threshold of each kind."""
    rows = spark.createDataFrame(labelled(), "kind int, span string, before string, label int").repartition(1)
    rows = rows.select("kind", "label", array_to_vector(F.array(*features(F.col("kind"), F.col("span"), F.col("before")))).alias("features"), (F.pmod(F.xxhash64("span", "before"), F.lit(4)) == 0).alias("held")).cache()
    model = GBTClassifier(maxIter=12, maxDepth=4, stepSize=0.4, seed=5).fit(rows.where("NOT held"))
    trees = list(zip(model.treeWeights, [t.toDebugString for t in model.trees], strict=True))
    scored = model.transform(rows.where("held")).select("kind", "label", "probability").collect()
    rows.unpersist()
    limits = []
    for k in range(len(KINDS)):
        own = sorted((float(r["probability"][1]), r["label"]) for r in scored if r["kind"] == k)
        ok = [p for i, (p, _) in enumerate(own) if sum(y for _, y in own[i:]) >= PRECISION * len(own[i:])]
        limits.append(max(0.5, min(ok, default=1.1)))
    return trees, limits


def tree_column(text: str, inputs: list[Column]) -> Column:
    """A tree of Spark ML, by its printed form, as nested conditions."""
    lines = [x.strip() for x in text.splitlines() if re.search(r"If|Else|Predict", x)]

    def node(i: int):
        if lines[i].startswith("Predict"):
            return F.lit(float(lines[i].split(":")[1])), i + 1
        feature, limit = re.match(r"If \(feature (\d+) <= ([-+.\dE]+)\)", lines[i]).groups()
        low, i = node(i + 1)
        high, i = node(i + 1)
        return F.when(inputs[int(feature)] <= float(limit), low).otherwise(high), i

    return node(0)[0]


def score(trees: list, inputs: Column) -> Column:
    at = [inputs[i] for i in range(N_FEATURES)]
    margin = F.lit(0.0)
    for weight, text in trees:
        margin = margin + weight * tree_column(text, at)
    return 1 / (1 + F.exp(-2 * margin))


def added_spans(text: Column, base: Column, trees: list, limits: list[float]) -> Column:
    """Spans chosen among the candidates, by start."""
    none = F.array().cast(SPAN)
    found = F.concat(*(F.when(text.rlike(some), spans_of(text, pattern, kind)).otherwise(none) for kind, pattern, some in LOOSE))
    free = lambda b: F.filter(found, lambda c: ~F.exists(b, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])))
    limit = F.array(*(F.lit(x) for x in limits))

    def rate(c):
        start = F.greatest(c["start"] - BEFORE, F.lit(0))
        inputs = F.array(*features(c["kind"], F.substring(text, c["start"] + 1, c["end"] - c["start"]), F.substring(text, start + 1, c["start"] - start)))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), let(inputs, lambda x: score(trees, x)).alias("p"))

    rated = lambda cs: F.array_sort(F.filter(F.transform(cs, rate), lambda c: c["p"] >= limit[c["kind"]]))
    kept = "array<struct<start:int,end:int,kind:int,p:double>>"

    def choose(acc, c):
        last = F.try_element_at(acc, F.lit(-1))
        apart = last.isNull() | (last["end"] <= c["start"])
        better = F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(c))
        return F.when(apart, F.concat(acc, F.array(c))).when(last["p"] < c["p"], better).otherwise(acc)

    chosen = let(base, lambda b: let(free(b), lambda cs: F.aggregate(rated(cs), F.array().cast(kept), choose)))
    plain = F.transform(chosen, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return F.when(text.rlike(r"(?i)[0-9]|[\x20\[({]at[\x20\])}]|[=:][\x20\x22\x27]{0,3}[A-Z]"), plain).otherwise(none)


def written(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def spans(text: Column, spark: SparkSession) -> tuple[Column, Column]:
    """Base spans, and all spans as a function of (text, base spans); both by kind, then start."""
    trees, limits = fit(spark)
    return base_spans(text), lambda t, base: F.array_sort(F.concat(base, added_spans(t, base, trees, limits)))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans, n_secret, n_spans (all spans)."""
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    base, every = spans(F.col("text"), docs.sparkSession)
    found = known.withColumn("base", base).withColumn("spans", every(F.col("text"), F.col("base")))
    count = lambda k, c: F.size(F.filter(c, lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select("doc_id", *(count(k, "base") for k in range(len(BASE))), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count(4, "spans"), F.size("spans").cast("long").alias("n_spans"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with each found span replaced by its kind in brackets; overlapping spans become one, of the first one's kind.

    Working columns take names that docs doesn't have.
    """
    old, base_name, spans_name, new_name = unused(docs, "old", "base", "spans", "new")
    base, every = spans(F.col(old), docs.sparkSession)
    found = docs.withColumn(old, F.coalesce("text", F.lit(""))).withColumn(base_name, base).withColumn(spans_name, every(F.col(old), F.col(base_name)))
    merged = F.aggregate(
        F.array_sort(F.transform(spans_name, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))),
        F.array().cast("array<struct<start:int,end:int,kind:int>>"),
        lambda acc, s: let(
            F.try_element_at(acc, F.lit(-1)),
            lambda last: F.when(last.isNull() | (last["end"] <= s["start"]), F.concat(acc, F.array(s))).otherwise(
                F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["kind"].alias("kind"))))
            ),
        ),
    )
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    text = F.col(old)

    def rebuilt(cut):
        piece = lambda s, i: F.concat(let(F.coalesce(F.get(cut, i - 1)["end"], F.lit(0)), lambda at: F.substring(text, at + 1, s["start"] - at)), names[s["kind"]])
        return F.concat(F.array_join(F.transform(cut, piece), ""), F.substring(text, F.try_element_at(cut, F.lit(-1))["end"] + 1, F.length(text)))

    some = F.size(spans_name) > 0
    out = found.withColumn(new_name, F.when(some, let(merged, rebuilt))).withColumn("text", F.when(some, F.col(new_name)).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(some, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*all_of(docs))
