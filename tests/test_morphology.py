"""The stemmer against words worked out by hand, and against a plain run of the rules, morpheme by morpheme."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.functions import morphology as M
from glossa.operators import stemming as S
from glossa.plans import stems as P

DIR = "/root/testdata/sf0.001"


def ana(*morphs):
    """An analysis of (surface, lexical, tag) with letters paired from the left."""
    out = []
    for s, l, tag in morphs:
        out += [f"{s[i : i + 1]}:{l[i : i + 1]}" for i in range(max(len(s), len(l)))] + [f":[{tag}]"]
    return " ".join(out)


def same(text, tag):
    return (text, text, tag)


DASH = same("-", "Hyph:Hyph")
# analysis, stem as a dictionary has it, compound, incorrect
BY_HAND = [
    (ana(same("ház", "/N"), same("ak", "Pl"), same("", "Nom")), "ház", False, False),
    (ana(("almá", "alma", "/N"), same("t", "Acc")), "alma", False, False),  # the lexical form of the last stem
    (ana(same("nagy", "/Adj"), ("kutyá", "kutya", "/N"), same("k", "Pl")), "nagy+kutya", True, False),
    (ana(("kutyá", "kutya", "/N"), same("ház", "/N")), "kutyá+ház", True, False),  # inner stems keep their surface
    (ana(same("leg", "/Supl"), same("nagy", "/Adj"), same("obb", "_Comp/Adj")), "nagy", False, False),  # a prefix and a comparison are no stem
    (ana(same("el", "/Prev"), same("megy", "/V"), same("", "Prs")), "el+megy", False, False),
    (ana(same("olvas", "/V"), same("ás", "_Ger/N"), same("t", "Acc")), "olvasás", False, False),
    (ana(same("hús", "/N"), same("darabol", "/V"), same("ó", "_ImpfPtcp/Adj")), "hús+daraboló", True, False),
    (ana(same("Árpád", "/N"), DASH, same("ház", "/N")), "Árpád+-ház", True, False),
    (ana(same("piros", "/Adj"), DASH), "piros", False, False),  # a hyphen at the end is no stem
    (ana(same("jár", "/V"), same("t", "Pst"), DASH, same("kel", "/V"), same("t", "Pst")), None, False, None),
    (ana(same("fut", "/N|lat"), same("ok", "Pl")), "fut", False, False),
    ("k:k :[6-3`/N]", "k", False, False),
    ("a:a :* b:b :[/N]", "a*b", False, False),
    ("x:x y:y", "", False, False),
    ("", "", False, False),
]


def plain(text):
    """(stem, pieces, tags, compound, incorrect): one morpheme after the other, on a list of dictionaries."""
    morphs, lex, surf = [], "", ""
    for part in text.split():
        s, _, right = part.partition(":")
        if right.startswith("["):
            morphs.append({"lex": lex, "surf": surf, "tag": right[1:-1].rsplit("`", 1)[-1]})
            lex = surf = ""
        else:
            lex, surf = lex + right, surf + s
    made = lambda t: "/" + t.rsplit("/", 1)[1] if t.startswith("_") and "/" in t else None
    stemlike = lambda t: t in M.HYPHENS or (t[:1] == "/" and t != M.PREFIX) or (made(t) is not None and t not in M.INFLECTED)
    count, waiting = 0, False
    for k, m in enumerate(morphs):
        m["next"], m["stem"], m["first"] = made(m["tag"]), stemlike(m["tag"]), stemlike(m["tag"])
        m["class"] = m["tag"].split("|")[0] if m["tag"] in M.PLAIN else m["tag"]
        m["dash"] = m["stem"] and m["lex"] == "-"
        m["member"] = m["tag"] in M.MEMBERS or (waiting and m["next"] in M.MEMBERS)
        count += m["member"]
        waiting = False if m["member"] else True if m["stem"] and not m["next"] else waiting
        if m["surf"]:
            out, rest = "", m["surf"]
            for c in m["lex"]:
                if rest and c == M.MARK:
                    out += c
                elif rest and rest[0] == c:
                    out, rest = out + c, rest[1:]
                else:
                    break
            m["surf"] = out + rest
            if count > 1 and (m["dash"] or k == 0 or not morphs[k - 1]["dash"]):
                m["lex"] = m["lex"].lower()
        else:
            m["surf"] = m["lex"]
    heads = any(m["class"] in M.HEADS or m["next"] in M.HEADS for m in morphs)
    first_stems = [k for k, m in enumerate(morphs) if m["first"]]
    for a, b in zip(first_stems, first_stems[1:]):  # at each further stem, what lies between it and the one before
        if not morphs[b]["dash"]:
            for m in morphs[a : b + 1]:
                if m["next"]:
                    m["class"], m["stem"], m["next"] = m["next"], True, None
    last, begun = (first_stems[-1], first_stems[0]) if first_stems else (-1, -1)
    dash = max((k for k, m in enumerate(morphs) if m["dash"]), default=-1)
    sure = any(x["tag"] in M.MEMBERS and y["tag"] in M.MEMBERS for x, y in zip(morphs, morphs[1:]))

    def participles():
        nonlocal last
        for k, m in enumerate(morphs):
            if m["class"] in M.STEM_IN_COMPOUND:
                m["class"], m["stem"], last = made(m["class"]), True, max(last, k)
                yield k

    if sure:
        begun = ([begun] + list(participles()))[-1]
    compound = count > 1 and (dash == -1 or heads)
    before = morphs[dash - 1] if dash > 0 else None
    bare = dash > 1 and not before["lex"] and not before["surf"] and not morphs[dash - 2]["stem"]
    if before and compound:
        compound = before["class"] in M.BEFORE_HYPHEN and not bare
    ends, k = False, len(morphs) - 1
    twin_open = before is not None and before["class"] in M.BEFORE_HYPHEN and not bare
    while k > 0 and morphs[k]["class"] in M.HYPHENS:
        morphs[k]["stem"], ends, k = False, True, k - 1
    while last > 0 and not morphs[last]["stem"]:
        last -= 1
    if compound and not sure:
        list(participles())
    sizes, cuts = 0, []
    for m in morphs:
        if m["member"] or m["class"] == M.DELIMITER:
            cuts += [sizes] if sizes else []
            sizes += len(m["surf"])
    marks = [k for k in range(1, len(morphs) - 1) if morphs[k - 1]["stem"] and morphs[k + 1]["stem"] and "-" in (morphs[k]["surf"], morphs[k]["lex"])]
    for k in marks:
        morphs[k]["stem"] = True
    incorrect = False
    if dash != -1 and not compound and not (ends and dash > 0 and twin_open):
        split = next((k for k, m in enumerate(morphs) if m["lex"] == "-"), len(morphs))
        half = next((k for k in range(dash - 1, 0, -1) if morphs[k]["stem"]), begun)
        stem = "".join((m["surf"] or m["lex"]) if k < (half if k < split else last) else m["lex"] for k, m in enumerate(morphs) if m["stem"])
        incorrect = [m["class"] for m in morphs[:split] if not m["stem"]] != [m["class"] for m in morphs[split:] if not m["stem"]]
    else:
        stem = "".join(m["surf"] if k < last else m["lex"] for k, m in enumerate(morphs) if m["stem"] and k <= last)
    edges = [0, *(c for c in cuts if c < len(stem)), len(stem)]
    return stem, [stem[a:b] for a, b in zip(edges, edges[1:])], [m["class"] for k, m in enumerate(morphs) if k >= last or m["class"] == M.PREFIX], compound, incorrect


def stems(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, a string").select("i", M.stem_of(F.col("a")).alias("s"))
    return [tuple(r.s) for r in sorted(df.collect())]


def test_by_hand(spark):
    for (text, stem, compound, incorrect), got in zip(BY_HAND, stems(spark, [x[0] for x in BY_HAND])):
        assert got == plain(text), text
        if stem is not None:
            assert ("+".join(got[1]), got[3], got[4]) == (stem, compound, incorrect), text


@pytest.mark.parametrize("seed", [1, 2])
def test_random_analyses(spark, seed):
    rng = random.Random(seed)
    tags = [*P.FIRST, *P.SECOND, *P.THIRD, "Nom", "Acc", "_Ord/Adj", "/Adj|col", "/N|Unit|Abbr", "/Post", "_Dim:cskA/N", "6`/N"]
    texts = []
    for _ in range(800):
        morphs = []
        for _ in range(rng.randint(0, 7)):
            tag = rng.choice(tags)
            text = "".join(rng.choices("abÁé", k=rng.randint(0, 3)))
            other = rng.choice([text, text.upper(), text[:1] + "*" + text[1:], "", text + "x"])
            morphs.append(DASH if tag.startswith("Hyph") and rng.random() < 0.9 else (text, other, tag))
        texts.append(ana(*morphs))
    for text, got in zip(texts, stems(spark, texts)):
        assert got == plain(text), text


def test_dictionary_of_the_words_of_documents(spark):
    groups = P.analysed(spark, DIR).collect()
    freq = {r.word: r.freq for r in P.frequencies(spark.read.parquet(f"{DIR}/documents.parquet")).collect()}
    want = {}
    for r in groups:
        found = [] if r.analyses[0].endswith("?") else [plain(a) for a in r.analyses]
        tries = [("+".join(p)) for s, p, _, _, bad in found if not bad and s]
        best = min(tries, key=len) if tries else None
        want[r.surf] = (r.surf if best == "the" else best.lower()) if best else r.surf if freq[r.surf] >= 5 and r.surf == r.surf.lower() else None
    got = {r.surf: r.stem for r in P.analysed_stems(spark, DIR).collect()}
    assert got == want and len({s for s in got.values() if s and "+" in s}) > 20


def test_candidates_of_unknown_forms(spark):
    groups = spark.createDataFrame([("a", ["x:x?"]), ("b", None), ("c", [BY_HAND[0][0], BY_HAND[1][0]])], "surf string, analyses array<string>")
    assert sorted(map(tuple, S.candidates(groups).collect())) == [("a", 0, ""), ("b", 0, ""), ("c", 0, "ház"), ("c", 1, "alma")]


def test_words_are_counted_once_and_dealt(spark, monkeypatch):
    """Texts are cut into words once; the analyses of many words are no single task, however few bytes they are."""
    monkeypatch.setattr(P, "TASK_WORDS", 500)
    df = P.analysed_stems(spark, DIR)
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()
    forms = P.counted_words(spark, DIR)
    n = forms.count()
    assert forms.rdd.getNumPartitions() == -(-n // 500) > 1 and df.count() == n
