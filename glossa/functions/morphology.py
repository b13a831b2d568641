"""Stems out of morphological analyses, as expressions over a row's array of morphemes.

An analysis is a run of letter pairs ``surface:lexical`` and tags ``:[tag]``, parted by spaces; a tag ends a morpheme. What a
tag means follows from its form: ``/C`` is a word class, ``_d/C`` a derivation that makes class C of what precedes it, others
are inflection. The stem goes up to the last stem morpheme, which is given in its lexical form, those before it in their
surface form; inflected inner morphemes are left out. Words of two or more members are compounds and are cut into pieces.

Choices: a class that a participle makes inside a compound is looked up by its own tag; a piece never reaches beyond the stem.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import let

# Tags of the analyses with a meaning that their form doesn't give.
INFLECTED = (
    "_AdvPerfPtcp/Adv", "_AdvPtcp/Adv", "_Aggreg/Adv", "_Caus/V", "_Com:stUl/Adv", "_Comp/Adj", "_Comp/Adv", "_Comp/Adv|Pro", "_Comp/Num", "_Comp/N|Pro", "_Comp/Post|(Abl)", "_Comp/Post|(All)",
    "_Design/Adj", "_Distr:nként/Adv", "_DistrFrq:ntA/Adv", "_Frac/Num", "_Freq/V", "_Manner:0/Adv", "_Manner/Adv", "_Mlt-Iter/Adv", "_Mod/V", "_Ord/Adj", "_OrdDate/N", "_Supe/N", "_Tmp_Ante/Adv", "_Tmp_Loc/Adv",
)
HYPHENS = ("Hyph:Dash", "Hyph:Hyph", "Hyph:Slash")
PREFIX, DELIMITER = "/Supl", "/Prev"
HEADS = ("/N", "/Adj", "/N|Acron", "/N|Acronx", "/N|Abbr", "/N|lat|Abbr", "/N|lat", "/N|Unit", "/N|mat")
MEMBERS = (*HEADS, "/V", "/CmpdPfx")
BEFORE_HYPHEN = (*HEADS, "Nom", "/Num", "/Num|Attr")
STEM_IN_COMPOUND = ("_ImpfPtcp/Adj", "_Adjz:s/Adj", "_Adjz:Ó/Adj", "_Ger/N")
PLAIN = (
    "/Adj|col", "/Adj|nat", "/N|mat", "/N|Acron", "/N|Unit", "/N|Unit|Abbr", "/N|Abbr|ChemSym", "/N|Ltr", "/N|Acronx", "/N|Abbr", "/N|def", "/N|lat|Abbr", "/N|lat", "/Adj|lat", "/Num|lat",
)
MARK = "*"


def is_stem(tag: Column) -> Column:
    derived = F.startswith(tag, F.lit("_")) & F.contains(tag, F.lit("/")) & ~tag.isin(*INFLECTED)
    return (F.startswith(tag, F.lit("/")) & (tag != PREFIX)) | tag.isin(*HYPHENS) | derived


def becomes(tag: Column) -> Column:
    """The class that a derivation makes; null for other tags."""
    return F.when(F.startswith(tag, F.lit("_")) & F.contains(tag, F.lit("/")), F.concat(F.lit("/"), F.substring_index(tag, "/", -1)))


def morphemes(analysis: Column) -> Column:
    """(lexical, surface, tag) of each tag; letters after the last tag belong to none."""
    parts = F.filter(F.split(analysis, " "), lambda p: p != "")
    after = lambda p: F.substring(p, F.instr(p, F.lit(":")) + 1, F.length(p))
    tagged = lambda p: F.startswith(after(p), F.lit("["))
    tag = lambda p: F.substring_index(F.substring_index(F.rtrim(after(p), F.lit("]")), "[", -1), "`", -1)
    side = lambda p, letter: F.when(tagged(p), F.concat(F.lit("\x01"), tag(p), F.lit("\x02"))).otherwise(letter)
    line = lambda letter: F.split(F.array_join(F.transform(parts, lambda p: side(p, letter(p))), ""), "\x02")
    both = F.zip_with(line(after), line(lambda p: F.substring_index(p, ":", 1)), lambda x, y: F.struct(F.substring_index(x, "\x01", 1).alias("lexical"), F.substring_index(y, "\x01", 1).alias("surface"), F.substring_index(x, "\x01", -1).alias("tag")))
    return let(both, lambda b: F.slice(b, 1, F.greatest(F.size(b) - 1, F.lit(0))))


def _marked(lexical: Column, surface: Column) -> Column:
    """The surface with the lexical form's marks, as far as both agree."""
    start = F.struct(F.lit("").alias("out"), surface.alias("rest"), F.lit(True).alias("same"))

    def step(a, c):
        mark, same = (c == MARK) & (a["rest"] != ""), F.startswith(a["rest"], c) & (a["rest"] != "")
        return F.when(~a["same"] | (~mark & ~same), F.struct(a["out"].alias("out"), a["rest"].alias("rest"), F.lit(False).alias("same"))).otherwise(
            F.struct(F.concat(a["out"], c).alias("out"), F.when(mark, a["rest"]).otherwise(F.substring(a["rest"], 2, 1 << 20)).alias("rest"), F.lit(True).alias("same"))
        )

    done = F.aggregate(F.filter(F.split(lexical, ""), lambda c: c != ""), start, step, lambda a: F.concat(a["out"], a["rest"]))
    return F.when(F.contains(lexical, F.lit(MARK)), done).otherwise(surface)


STATE = "struct<look:boolean,n:int,out:array<struct<lexical:string,surface:string,tag:string,class:string,next:string,stem:boolean,member:boolean,hyphen:boolean>>>"


def _folded(found: Column) -> Column:
    """look, n (members so far), out: morphemes with class, class that they make, and whether they are stems or members.

    A derivation makes a member of the stem before it, when that stem is none itself and the derived class can be one.
    """

    def step(a, m):
        nxt = becomes(m["tag"])
        shown = F.when(m["tag"].isin(*PLAIN), F.substring_index(m["tag"], "|", 1)).otherwise(m["tag"])
        member = m["tag"].isin(*MEMBERS) | (a["look"] & F.coalesce(nxt.isin(*MEMBERS), F.lit(False)))
        stem = is_stem(m["tag"])
        n = a["n"] + member.cast("int")
        given = m["surface"] != ""
        behind_hyphen = F.coalesce(F.get(a["out"], F.size(a["out"]) - 1)["hyphen"], F.lit(False))
        hyphen = stem & (m["lexical"] == "-")
        low = given & (n > 1) & (hyphen | ~behind_hyphen)
        item = F.struct(
            F.when(low, F.lower(m["lexical"])).otherwise(m["lexical"]).alias("lexical"), F.when(given, _marked(m["lexical"], m["surface"])).otherwise(m["lexical"]).alias("surface"),
            m["tag"].alias("tag"), shown.alias("class"), nxt.alias("next"), stem.alias("stem"), member.alias("member"), hyphen.alias("hyphen"),
        )
        look = F.when(member, False).when(stem & nxt.isNull(), True).otherwise(a["look"])
        return F.struct(look.alias("look"), n.alias("n"), F.concat(a["out"], F.array(item)).alias("out")).cast(STATE)

    start = F.struct(F.lit(False).alias("look"), F.lit(0).alias("n"), F.array().alias("out")).cast(STATE)
    return F.aggregate(found, start, step)


def _at(items: Column, holds) -> Column:
    """Places of the items for which holds(item, place)."""
    return F.filter(F.transform(items, lambda m, i: F.when(holds(m, i), i)), lambda i: i.isNotNull())


def _last(places: Column, otherwise: int = -1) -> Column:
    return F.coalesce(F.array_max(places), F.lit(otherwise))


def _as(m: Column, **changed: Column) -> Column:
    """An item with some fields changed."""
    return F.struct(*(changed.get(k, m[k]).alias(k) for k in ("lexical", "surface", "tag", "class", "next", "stem", "member", "hyphen")))


def _between_stems(items: Column) -> Column:
    """Derivations that another stem follows or that are a stem themselves take the class they make, once there was a stem before."""
    first = lambda a: F.coalesce(F.array_min(_at(a, lambda m, i: m["stem"])), F.lit(1 << 20))

    def change(a):
        def one(m, i):
            after = F.get(F.filter(F.slice(a, i + 2, F.size(a)), lambda x: x["stem"]), F.lit(0))
            followed = (first(a) <= i) & after.isNotNull() & ~F.coalesce(after["hyphen"], F.lit(False))
            itself = m["stem"] & ~m["hyphen"] & (first(a) < i)
            return F.when(m["next"].isNotNull() & (followed | itself), _as(m, **{"class": m["next"], "stem": F.lit(True)})).otherwise(m)

        return F.transform(a, one)

    return let(items, change)


def _participles(items: Column) -> Column:
    return F.transform(items, lambda m: F.when(m["class"].isin(*STEM_IN_COMPOUND), _as(m, **{"class": m["next"], "stem": F.lit(True)})).otherwise(m))


def stem_of(analysis: Column) -> Column:
    """(stem, pieces, tags, compound, incorrect) of an analysis.

    pieces are the parts of a compound's stem, or the stem; tags those from the last stem morpheme on, with prefixes;
    incorrect marks twin words whose halves bear different endings.
    """
    none = F.lit(False)
    waits = lambda m, i: m["class"].isin(*STEM_IN_COMPOUND)

    def whole(a):
        folded = a["out"]
        sure = F.exists(F.transform(folded, lambda m, i: (i > 0) & m["tag"].isin(*MEMBERS) & F.coalesce(F.get(folded, i - 1)["tag"].isin(*MEMBERS), none)), lambda x: x)
        head = F.exists(folded, lambda m: F.coalesce(m["class"].isin(*HEADS), none) | F.coalesce(m["next"].isin(*HEADS), none))
        hyphen = _last(_at(folded, lambda m, i: m["hyphen"]))
        last = _last(_at(folded, lambda m, i: m["stem"]))
        begun = F.coalesce(F.array_min(_at(folded, lambda m, i: m["stem"])), F.lit(-1))
        joined = _between_stems(folded)
        s = F.struct(
            F.when(sure, _participles(joined)).otherwise(joined).alias("items"), sure.alias("sure"), head.alias("head"), hyphen.alias("hyphen"), a["n"].alias("n"),
            F.when(sure, F.greatest(last, _last(_at(joined, waits)))).otherwise(last).alias("last"), F.when(sure, F.coalesce(F.array_max(_at(joined, waits)), begun)).otherwise(begun).alias("begun"),
        )
        return let(s, cut)

    def cut(s):
        items, hyphen = s["items"], s["hyphen"]
        before = F.get(items, hyphen - 1)
        bare = (hyphen > 1) & (before["lexical"] == "") & (before["surface"] == "") & ~F.coalesce(F.get(items, hyphen - 2)["stem"], none)
        open_ = F.coalesce(before["class"].isin(*BEFORE_HYPHEN), none)
        compound = (s["n"] > 1) & ((hyphen == -1) | s["head"]) & ((hyphen <= 0) | (open_ & ~F.coalesce(bare, none)))
        # hyphens at the end are no stems
        tail = lambda i: (i > 0) & F.forall(F.slice(items, i + 1, F.size(items)), lambda m: m["class"].isin(*HYPHENS))
        ends = F.exists(F.transform(items, lambda m, i: tail(i)), lambda x: x)
        closed = F.transform(items, lambda m, i: F.when(tail(i), _as(m, stem=none)).otherwise(m))
        twin = ~(ends & (hyphen > 0) & open_ & ~F.coalesce(bare, none))
        t = F.struct(closed.alias("items"), compound.alias("compound"), (twin & (hyphen != -1) & ~compound).alias("twin"), hyphen.alias("hyphen"), s["last"].alias("last"), s["begun"].alias("begun"), s["sure"].alias("sure"))
        return let(t, named)

    def named(t):
        items, late = t["items"], t["compound"] & ~t["sure"]
        back = F.when(t["last"] <= 0, t["last"]).otherwise(_last(_at(items, lambda m, i: m["stem"] & (i <= t["last"])), 0))
        last = F.when(late, F.greatest(back, _last(_at(items, waits)))).otherwise(back)
        changed = F.when(late, _participles(items)).otherwise(items)
        inner = lambda c: F.transform(c, lambda m, i: F.when((i > 0) & F.coalesce(F.get(c, i - 1)["stem"], none) & F.coalesce(F.get(c, i + 1)["stem"], none) & ((m["surface"] == "-") | (m["lexical"] == "-")), _as(m, stem=F.lit(True))).otherwise(m))
        return let(F.struct(let(changed, inner).alias("items"), last.alias("last"), *(t[c].alias(c) for c in ("compound", "twin", "hyphen", "begun"))), written)

    def written(w):
        items, last = w["items"], w["last"]
        plain = F.array_join(F.transform(F.filter(F.transform(items, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: x["m"]["stem"] & (x["i"] <= last)), lambda x: F.when(x["i"] < last, x["m"]["surface"]).otherwise(x["m"]["lexical"])), "")
        # twin words: of each half the last stem in its lexical form, and the same endings in both
        dash = F.coalesce(F.array_min(_at(items, lambda m, i: m["lexical"] == "-")), F.lit(1 << 20))
        half = _last(_at(items, lambda m, i: m["stem"] & (i > 0) & (i < w["hyphen"])))
        half = F.when(half > 0, half).otherwise(w["begun"])
        both = F.array_join(F.transform(items, lambda m, i: F.when(~m["stem"], "").when(i < F.when(i < dash, half).otherwise(last), F.when(m["surface"] != "", m["surface"]).otherwise(m["lexical"])).otherwise(m["lexical"])), "")
        endings = lambda test: F.transform(F.filter(F.transform(items, lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda x: ~x["m"]["stem"] & test(x["i"])), lambda x: x["m"]["class"])
        incorrect = w["twin"] & (endings(lambda i: i < dash) != endings(lambda i: i >= dash))
        stem = F.when(w["twin"], both).otherwise(plain)
        sizes = F.transform(F.filter(items, lambda m: m["member"] | (m["class"] == DELIMITER)), lambda m: F.length(m["surface"]))
        places = F.filter(F.transform(sizes, lambda n, i: F.when(i > 0, F.aggregate(F.slice(sizes, 1, i), F.lit(0), lambda a, x: a + x))), lambda p: p > 0)
        edges = lambda p, text: F.concat(F.array(F.lit(0)), F.filter(p, lambda x: x < F.length(text)), F.array(F.length(text)))
        pieces = let(F.struct(stem.alias("text"), places.alias("p")), lambda x: let(edges(x["p"], x["text"]), lambda e: F.transform(F.slice(e, 1, F.size(e) - 1), lambda lo, i: F.substring(x["text"], lo + 1, F.get(e, i + 1) - lo))))
        tags = F.transform(F.filter(F.transform(items, lambda m, i: F.struct(m["class"].alias("c"), ((i >= last) | (m["class"] == PREFIX)).alias("k"))), lambda x: x["k"]), lambda x: x["c"])
        return F.struct(stem.alias("stem"), pieces.alias("pieces"), tags.alias("tags"), w["compound"].alias("compound"), incorrect.alias("incorrect"))

    return let(_folded(morphemes(analysis)), whole)


def stemmed_text(stem: Column) -> Column:
    """A stem as it stands in a stem dictionary: its pieces with + between."""
    return F.array_join(stem["pieces"], "+")
