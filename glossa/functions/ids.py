"""Identifiers: entry codes, string hashes, packed postings, addresses."""

from __future__ import annotations

from math import prod

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTERS, DIGITS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Kinds of the code's places, first to last: letters or digits.
PLACES = (LETTERS, DIGITS, DIGITS, LETTERS, LETTERS, DIGITS, LETTERS)
#: Different codes; from this number on they come again.
CODES = prod(map(len, PLACES))


def code_of(number: Column) -> Column:
    """Seven-character code of a non-negative integer: mixed base 52 and 10, the last place counting fastest."""
    parts, rest = [], number.cast("long")
    for alphabet in reversed(PLACES):
        n = len(alphabet)
        parts.append(F.substring(F.lit(alphabet), (F.pmod(rest, F.lit(n)) + 1).cast("int"), F.lit(1)))
        rest = F.floor(rest / n).cast("long")  # exact: numbers stay below 2^53
    return F.concat(*reversed(parts))


def turn_of(number: Column) -> Column:
    """How often codes have all been used before a number's; 0 for the first CODES numbers."""
    return F.floor(number.cast("long") / CODES).cast("long")


def number_of(code: Column, turn: Column | None = None) -> Column:
    """The integer of a code. A code names one of CODES integers; larger ones need their turn besides."""
    total = F.lit(0).cast("long") if turn is None else turn.cast("long")
    for i, alphabet in enumerate(PLACES):
        total = total * len(alphabet) + F.instr(F.lit(alphabet), F.substring(code, i + 1, 1)) - 1
    return total.cast("long")


def djb2(text: Column) -> Column:
    """Hash by times 33 plus the character, from 5381, as a signed 32-bit integer."""
    h = F.aggregate(F.split(text, ""), F.lit(5381).cast("long"), lambda h, c: F.when(c == "", h).otherwise(F.pmod(h * 33 + F.ascii(c), F.lit(1 << 32))))
    return F.when(h >= 1 << 31, h - (1 << 32)).otherwise(h).cast("int")


def ipv4(text: Column) -> Column:
    """Address as an integer."""
    p = F.split(text, r"\.")
    return sum((p[i].cast("long") * (1 << (24 - 8 * i)) for i in range(4)), F.lit(0).cast("long"))
