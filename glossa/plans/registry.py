"""Collects the queries of all plan modules."""

from __future__ import annotations

from glossa.plans import corpus, dictionary, edits, entries, history, indexed, lexicon, pairs, search, stems, text, wordlists  # noqa: F401
from glossa.plans.catalog import ORACLES, QUERIES


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(ORACLES)
