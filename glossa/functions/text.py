"""Text expressions: words, folding, compact forms, ratios, script tests. All are plain column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = "[a-zà-ÿ]+"


def _folds() -> tuple[str, str]:
    """Letters of one code unit that come apart into one letter and marks, and those letters, by Unicode's decomposition."""
    pairs = []
    for c in map(chr, range(0xC0, 0x2000)):
        bare = "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(c for c, _ in pairs), "".join(x for _, x in pairs)


ACCENTED, PLAIN = _folds()
# Bands of the length filter: longest source, ratio of lengths from and to, largest share of punctuation.
BANDS = ((5, 2.5, 7.0, 0.3), (20, 2.3, 5.0, 0.2), (40, 2.1, 4.0, 0.1))
# Tokens that count as numbers.
NUMBER = r"^([0-9\-.:,^%]+|[0-9]+(th|nd|rd|st|s|m))$"
# The blocks of characters that count as hanzi.
HANZI = r"[\x{3400}-\x{4DFF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]"


def let(value: Column, body) -> Column:
    """body(value) with value computed once a row; plain columns may be computed again at each use in a lambda."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def folded(text: Column) -> Column:
    """Lower case without diacritics; marks of their own go too."""
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}", "")


def packed_prefix(text: Column) -> Column:
    """The first four characters of the folded text as one number, 16 bits each; shorter texts are filled up with 0."""
    unit = lambda i: F.coalesce(F.ascii(F.substring(folded(text), i, 1)), F.lit(0)).cast("long")
    return F.shiftleft(unit(1), 48) + F.shiftleft(unit(2), 32) + F.shiftleft(unit(3), 16) + unit(4)


def compacted(text: Column) -> Column:
    """Lower case without punctuation, white space and joiners; equal for texts that differ in those alone."""
    return F.regexp_replace(F.lower(text), r"[\p{P}\s￭]", "")


def pruned(text: Column) -> Column:
    """Punctuation and white space as single spaces, lower case, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[\p{P}\s]+", " "))


def punctuation(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{P}]", ""))


def good_pair(source: Column, target: Column) -> Column:
    """The banded filter on the ratio of lengths and the share of punctuation of a pair of segments."""
    n, m = F.length(source), F.length(target)
    share = F.greatest(punctuation(source) / n, punctuation(target) / m)
    out = F.lit(False)
    for longest, low, high, most in reversed(BANDS):
        ok = (m >= low * n) & (m <= high * n) & (share <= most)
        out = F.when(n <= longest, ok).otherwise(out)
    return (n > 0) & (m > 0) & out


def has_hanzi(text: Column) -> Column:
    return text.rlike(HANZI)


def non_bmp(text: Column) -> Column:
    return text.rlike(r"[\x{10000}-\x{10FFFF}]")


def private_use(text: Column) -> Column:
    return text.rlike(r"[\p{Co}\p{Cs}]")


def repaired(text: Column) -> Column:
    """Hungarian letters that a wrong code page has spoilt."""
    return F.translate(text, "õûÕÛ", "őűŐŰ")


def merged_alnum(text: Column) -> Column:
    """Joins letters, digits and decimals that spaces keep apart."""
    for pattern, new in ((r"(?<=[A-Za-z]) (?=[A-Za-z])", ""), (r"(?<=[0-9]) (?=[0-9])", ""), (r"(?<=[0-9]) ?([.,]) ?(?=[0-9])", "$1")):
        text = F.regexp_replace(text, pattern, new)
    return text


def normal_token(surface: Column) -> Column:
    """Key of a target token: without pipes, ß as ss, lower case; NNN for numbers, ZHO for Chinese."""
    key = F.lower(F.replace(F.replace(surface, F.lit("|"), F.lit("")), F.lit("ß"), F.lit("ss")))
    number = surface.rlike(NUMBER)
    return F.when(number, "NNN").when(has_hanzi(surface), "ZHO").otherwise(key)


def result_count(n: Column) -> Column:
    """Counts as they are shown: exact up to 500, then in steps of 100, 500 and 1000."""
    step = F.when(n <= 500, 1).when(n <= 2000, 100).when(n <= 10_000, 500).otherwise(1000)
    return (n - F.pmod(n, step)).cast("long")


def escaped(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text
