"""Pinyin: display forms with tone marks, and parsing of queries.

A query is one short string, so its parser is plain Python; display forms are column expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Vowels with the marks of tones 1 to 4.
MARKS = {"a": "āáǎà", "e": "ēéěè", "i": "īíǐì", "o": "ōóǒò", "u": "ūúǔù", "v": "ǖǘǚǜ"}


def display(text: Column, tone: Column) -> Column:
    """A syllable with its tone mark: on a or e, else on the o of ou, else on the last vowel; v is shown as ü."""
    at = (
        F.when(F.instr(text, F.lit("a")) > 0, F.instr(text, F.lit("a"))).when(F.instr(text, F.lit("e")) > 0, F.instr(text, F.lit("e"))).when(F.instr(text, F.lit("ou")) > 0, F.instr(text, F.lit("ou")))
        .otherwise(F.length(F.regexp_extract(text, "^(.*[iouv])", 1)))
    )
    vowel = F.substring(text, at, F.lit(1))
    marked = F.lit(None).cast("string")
    for v, forms in MARKS.items():
        marked = F.coalesce(marked, F.when(vowel == v, F.substring(F.lit(forms), tone, F.lit(1))))
    whole = F.concat(F.substring(text, F.lit(1), at - 1), F.coalesce(marked, vowel), F.substring(text, at + 1, F.length(text)))
    return F.replace(F.when((tone >= 1) & (tone <= 4) & (at > 0), whole).otherwise(text), F.lit("v"), F.lit("ü"))


def parse_query(query: str, syllabary: list[tuple[str, bool]]) -> list[tuple[str, int]]:
    """Syllables (text, tone) of a query; tone -1 where none is given.

    The syllabary lists syllables in matching order, each with whether it starts with a vowel. A piece without breaks is
    split by backtracking; syllables that start with a vowel can't start inside a piece. What can't be split stays whole.
    """
    text = query.strip().lower().replace("u:", "v").replace("ü", "v")
    pieces = [p for chunk in re.split(r"[ '’]+", text) for p in re.findall(r"[^0-5]*[0-5]|[^0-5]+$", chunk) if p]
    out: list[tuple[str, int]] = []
    for piece in pieces:
        for s in _split(piece, 0, syllabary) or [piece]:
            tone = int(s[-1]) % 5 if len(s) > 1 and s[-1] in "12345" else -1
            body = s[:-1] if tone >= 0 else s
            if len(body) > 1 and body.endswith("r") and body != "er":
                out += [(body[:-1], tone), ("r", 0)]
            else:
                out.append((body, tone))
    return out


def _split(piece: str, at: int, syllabary: list[tuple[str, bool]]) -> list[str] | None:
    if at == len(piece):
        return []
    for s, vowel in syllabary:
        if piece.startswith(s, at) and not (vowel and at > 0):
            end = at + len(s)
            for stop in ([end + 1] if end < len(piece) and piece[end] in "12345" else []) + [end]:
                rest = _split(piece, stop, syllabary)
                if rest is not None:
                    return [piece[at:stop], *rest]
    return None


def contiguous(pinyin: Column, query: list[tuple[str, int]]) -> Column:
    """Place of the first run of syllables that matches the query, tones only where given; null without one."""
    if not query:
        return F.lit(None).cast("int")
    same = lambda i: F.when(F.lit(True), _all(pinyin, i, query))
    starts = F.filter(F.transform(pinyin, lambda s, i: i), same)
    return F.get(starts, F.lit(0))


def _all(pinyin: Column, i: Column, query: list[tuple[str, int]]) -> Column:
    ok = F.lit(True)
    for k, (text, tone) in enumerate(query):
        s = F.get(pinyin, i + k)
        ok = ok & F.coalesce((F.lower(s["text"]) == text) & (F.lit(tone < 0) | (s["tone"] == tone)), F.lit(False))
    return ok
