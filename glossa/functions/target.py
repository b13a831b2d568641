"""Tokens of target-language text, as arrays of structs.

A token is a run of hanzi, or a run of other characters up to a separator. Its norm is what indexes hold; a pipe inside it
parts a compound. ``sub`` counts the tokens since the last semicolon that follows one.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from glossa.functions.text import HANZI, NUMBER, has_hanzi, let, normal_token

# Characters that part tokens, besides white space.
SEPARATORS = ",;:.?!-/'\"()[]"

_SEP = r"\s" + re.escape(SEPARATORS).replace('"', r"\x22").replace("'", r"\x27")
_HAN = HANZI[1:-1]
PIECES = f"[{_HAN}]+|[^{_SEP}{_HAN}]+|[{_SEP}]+"
TOKEN = "struct<surf:string,norm:string,start:int,sub:int,cut:int,first:string,second:string>"


def tokens(text: Column) -> Column:
    """Tokens of a text: surf, norm, start, sub, and for a compound cut (place of its last pipe), first and second (norms of its halves)."""
    none = F.array().cast("array<struct<surf:string,start:int,sub:int>>")
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("sub"), F.lit(False).alias("open"), none.alias("out"))

    def step(acc, p):
        separator = p.rlike(f"^[{_SEP}]")
        after = F.when(~acc["open"], acc["sub"]).when(F.startswith(p, F.lit(";")), 0).otherwise(acc["sub"] + 1)
        token = F.struct(p.alias("surf"), acc["at"].alias("start"), after.alias("sub"))
        return F.struct((acc["at"] + F.length(p)).alias("at"), after.alias("sub"), (~separator).alias("open"), F.when(separator, acc["out"]).otherwise(F.concat(acc["out"], F.array(token))).alias("out"))

    found = F.aggregate(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECES), 0), begin, step)["out"]

    def whole(t):
        surf = t["surf"]
        number, hanzi = surf.rlike(NUMBER), has_hanzi(surf)
        place = F.when(~number & ~hanzi & F.contains(surf, F.lit("|")), F.length(surf) - F.length(F.substring_index(surf, "|", -1)) - 1)
        # most tokens have no pipe, so that the patterns are not tried
        return let(F.when(F.contains(surf, F.lit("|")), place), lambda cut: parted(t, cut))

    def parted(t, cut):
        surf = t["surf"]
        half = lambda x: F.when(cut.isNotNull(), normal_half(x))
        return F.struct(
            surf.alias("surf"), normal_token(surf).alias("norm"), t["start"].alias("start"), F.when(has_hanzi(surf), 0).otherwise(t["sub"]).alias("sub"), cut.alias("cut"),
            half(F.substring(surf, F.lit(1), cut)).alias("first"), half(F.substring(surf, cut + 2, F.length(surf))).alias("second"),
        )

    return F.transform(found, whole)


def normal_half(half: Column) -> Column:
    return F.lower(F.replace(F.replace(half, F.lit("|"), F.lit("")), F.lit("ß"), F.lit("ss")))


def query_tokens(text: str) -> list[str]:
    """Norms of the tokens of a query, which is one short string."""
    out = []
    for surf in re.findall(r"[㐀-䷿一-鿿豈-﫿]+|[^㐀-䷿一-鿿豈-﫿\s" + re.escape(SEPARATORS) + "]+", text):
        number = re.search(NUMBER, surf)
        out.append("NNN" if number else "ZHO" if re.match("[㐀-䷿一-鿿豈-﫿]", surf) else surf.replace("|", "").replace("ß", "ss").lower())
    return out


def without_punctuation(text: Column) -> Column:
    """Text without punctuation and a leading article; empty where it has a digit."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\p{P}", ""), r"\s+", " "), "^ ", "")
    plain = F.regexp_replace(plain, "^a ", "")
    return F.when(text.rlike(r"\p{Nd}"), "").otherwise(F.regexp_replace(plain, "^az ", ""))


def trimmed_tokens(text: Column) -> Column:
    """Words without punctuation at their ends; an empty one follows each that ends a sentence."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    bare = lambda w: F.regexp_replace(F.regexp_replace(w, r"^\p{P}+", ""), r"\p{P}+$", "")
    return F.flatten(F.transform(words, lambda w: F.filter(F.array(F.nullif(bare(w), F.lit("")), F.when(w.rlike(r"[-.?!]$"), "")), lambda x: x.isNotNull())))


def pruned_places(text: Column) -> Column:
    """For each character of the pruned text (punctuation and white space as single spaces, trimmed) its place in the text."""
    blank = lambda c: c.rlike(r"^[\p{P}\s]$")

    def places(chars):
        each = F.transform(chars, lambda c, i: F.struct(i.alias("i"), blank(c).alias("b"), F.coalesce(blank(F.get(chars, i - 1)), F.lit(True)).alias("after")))
        kept = F.filter(each, lambda x: ~(x["b"] & x["after"]))
        return let(kept, lambda k: F.transform(F.when(F.try_element_at(k, F.lit(-1))["b"], F.slice(k, 1, F.size(k) - 1)).otherwise(k), lambda x: x["i"]))

    return let(F.filter(F.split(text, ""), lambda c: c != ""), places)
