"""Registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from glossa.llm import align as _align
from glossa.llm import decontaminate as _decontaminate
from glossa.llm import exact as _exact
from glossa.llm import html as _html
from glossa.llm import jaccard as _jaccard
from glossa.llm import licenses as _licenses
from glossa.llm import merkle as _merkle
from glossa.llm import mixing as _mixing
from glossa.llm import oracles
from glossa.llm import pii as _pii
from glossa.llm import quality as _quality
from glossa.llm import suffixes as _suffixes
from glossa.llm import urls as _urls
from glossa.llm import warc as _warc

QUERIES: dict = {}
ORACLES: dict = {}


def _add(name: str, f, sql: str | None = None) -> None:
    QUERIES[name] = f
    if sql:
        ORACLES[name] = sql


def _table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op8_line_frequency(spark, sf_dir):
    return _quality.quality(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


_add("op8_line_frequency", op8_line_frequency, oracles.QUALITY)


def op3_jaccard_join(spark, sf_dir):
    return _jaccard.jaccard_components(_table(spark, sf_dir, "documents"), width=3, percent=90)


_add("op3_jaccard_join", op3_jaccard_join, oracles.JACCARD)


def op4_boosted_candidates(spark, sf_dir):
    return _pii.personal_data(_table(spark, sf_dir, "documents"))


_add("op4_boosted_candidates", op4_boosted_candidates)

#: Target weights of the mixture; other sources have weight 1.
WEIGHTS = {"src0": 4, "src1": 3, "src2": 3, "src3": 2, "src4": 2, "src5": 2}


def op1_pfair_mixing(spark, sf_dir):
    return _mixing.mix(_table(spark, sf_dir, "documents").select("doc_id", "source"), WEIGHTS)


_add("op1_pfair_mixing", op1_pfair_mixing)


def op10_simhash_windows(spark, sf_dir):
    return _decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


_add("op10_simhash_windows", op10_simhash_windows)


def op2_sentence_rules(spark, sf_dir):
    return _licenses.scan(_table(spark, sf_dir, "documents"))


_add("op2_sentence_rules", op2_sentence_rules, oracles.licences())


def op7_boundary_chain(spark, sf_dir):
    return _warc.round_trip(_table(spark, sf_dir, "pages"))


_add("op7_boundary_chain", op7_boundary_chain, oracles.WARC)


def op9_hashed_ngrams(spark, sf_dir):
    return _urls.judge(_table(spark, sf_dir, "pages"))


_add("op9_hashed_ngrams", op9_hashed_ngrams)


def op6_lyndon_suffixes(spark, sf_dir):
    return _suffixes.dedup(_table(spark, sf_dir, "documents"), words=_suffixes.WORDS)


_add("op6_lyndon_suffixes", op6_lyndon_suffixes, oracles.SUFFIXES)


def op5_nearest_url(spark, sf_dir):
    return _html.extract(_table(spark, sf_dir, "pages"))


_add("op5_nearest_url", op5_nearest_url)


def op11_digest_index(spark, sf_dir):
    return _exact.dedup(_table(spark, sf_dir, "documents"))


_add("op11_digest_index", op11_digest_index, oracles.EXACT)


def op12_merkle_blocks(spark, sf_dir):
    return _merkle.audit(_table(spark, sf_dir, "documents"))


_add("op12_merkle_blocks", op12_merkle_blocks, oracles.MERKLE)


def op13_token_alignment(spark, sf_dir):
    return _align.summary(_table(spark, sf_dir, "documents"))


_add("op13_token_alignment", op13_token_alignment)
