"""Alignment of two tokenizers over the same texts: a byte-level BPE (A) and a piece BPE with byte fallback (B).

A task encodes texts with both, lays the ends of the tokens on one line of bytes and merges the two sorted lists: each step of
the two pointers is a link (a token of A and one of B that overlap), and each step at which both move ends a group. The steps of
a slice of texts are taken at once, on arrays. Distinct links of a text are kept with their counts; Spark counts links by id
pair over the corpus, takes the maximum for each id of either side, and joins both back. Pairs with a two-hundred-thousandth of all
links, of which there are 200,000 at most, are met by a broadcast; the others by a shuffle on the pair.

A encodes a space and the text, B the text, before which it sets a space of its own. Strings of special tokens inside a text are
plain text. A text whose tokens don't give back a space and the text, byte for byte, has no tokens, nor has a null or empty
one. Repeated rows are texts of their own. An empty table gives no rows and no pairs. A text is encoded whole,
whatever its length, alone in its slice. Columns beside the two named are of no concern, so none can clash.
"""

from __future__ import annotations

import base64
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm.common import SLICE, Scratch, bounded, quoted

#: Folder of the vocabulary files on every machine, and their names.
FOLDER, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: A's vocabulary once more, as ranks, with its pattern (a fixed value): another reader of the same encoding, four times as fast.
#: It takes texts of printable ASCII, tabs, line ends and Latin letters, on which the pattern's classes leave no doubt; A's own file takes the others.
RANKS_A, PATTERN = "byte_bpe_50k.tiktoken", r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CLEAR = re.compile("[\t\n\r -~À-ÖØ-öø-ž]*")
#: Most pairs that are broadcast.
HOT_PAIRS = 200_000
SCHEMA = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<long>, counts array<int>"


def _byte_of() -> dict[str, int]:
    """The characters that a byte-level vocabulary writes for bytes: printable Latin-1 for itself, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Side:
    """What a vocabulary knows of its ids: bytes, their number, and decimal strings with the mark that follows."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.sizes = pieces, np.array([len(p) for p in pieces], dtype=np.int64)
        self.shown = np.array([f"{i}{mark}" for mark in (",", "|", ";", "") for i in range(len(pieces))], dtype=object)

    def joined(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


@lru_cache(maxsize=2)
def vocabularies(folder: str):
    """Both tokenizers, A's ranks, and both sides, once in each Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tiktoken
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(f"{folder}/{FILE_A}"), SentencePieceProcessor(model_file=f"{folder}/{FILE_B}")
    a.encode_special_tokens = True
    byte, names = _byte_of(), [a.id_to_token(i) for i in range(a.get_vocab_size())]
    side_a = Side([bytes(byte[c] for c in name or "") for name in names])
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    with open(f"{folder}/{RANKS_A}", "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    quick = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return a, b, quick, side_a, Side([piece(i) for i in range(b.get_piece_size())])


def ids_of_a(texts: list[str], folder: str) -> list[list[int]]:
    """A's ids of a space and each text; none for an empty text."""
    a, _, quick, *_ = vocabularies(folder)
    clear = [CLEAR.fullmatch(t) is not None for t in texts]
    others = iter(a.encode_batch_fast([" " + t for t, c in zip(texts, clear) if not c], add_special_tokens=False))
    return [([] if not t else quick.encode_ordinary(" " + t)) if c else next(others).ids for t, c in zip(texts, clear)]


def encoded(texts: list[str], folder: str) -> list[tuple[list[int], list[int]]]:
    """Ids of both sides for each text; none where they don't give the text back."""
    _, b, _, side_a, side_b = vocabularies(folder)
    wholes = [b" " + t.encode() if t else b"" for t in texts]
    ids_a, ids_b = ids_of_a(texts, folder), b.encode(texts, num_threads=1)
    ok = lambda ids, side, whole: side.joined(ids) == whole
    return [(x, y) if ok(x, side_a, w) and ok(y, side_b, w) else ([], []) for x, y, w in zip(ids_a, ids_b, wholes)]


def merged(ends_a: np.ndarray, ends_b: np.ndarray):
    """All steps of the two pointers: token of A and of B at each link, whether both move, and the byte where it ends.

    Both lists are sorted, without repeats, and end at the same byte. Each end is marked on the line of bytes; the number of
    marks before a byte is where a pointer stands there.
    """
    size = int(ends_a[-1]) + 1
    on_a, on_b = np.zeros(size, dtype=bool), np.zeros(size, dtype=bool)
    on_a[ends_a], on_b[ends_b] = True, True
    steps = np.flatnonzero(on_a | on_b)
    at_a, at_b = (np.cumsum(on[steps]) - on[steps] for on in (on_a, on_b))
    return at_a, at_b, on_a[steps] & on_b[steps], steps


def _flat(ids: list[list[int]], n: int) -> np.ndarray:
    return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=n)


def _aligned(texts: list[str], folder: str) -> dict[str, list]:
    """Columns of SCHEMA but for the id. Texts lie one behind the other on the line of bytes; each ends a group."""
    ids, (*_, side_a, side_b) = encoded(texts, folder), vocabularies(folder)
    n_a, n_b = (np.array([len(p[k]) for p in ids], dtype=np.int64) for k in (0, 1))
    a, b = _flat([p[0] for p in ids], n_a.sum()), _flat([p[1] for p in ids], n_b.sum())
    ends_a, ends_b = np.cumsum(side_a.sizes[a]), np.cumsum(side_b.sizes[b])
    if not len(a):
        zero = [0] * len(texts)
        return {"n_a": zero, "n_b": zero, "n_groups": zero, "n_links": zero, "groups": [""] * len(texts), "pairs": [[] for _ in zero], "counts": [[] for _ in zero]}
    at_a, at_b, both, steps = merged(ends_a, ends_b)
    doc = np.repeat(np.arange(len(texts)), n_a)[at_a]
    per_doc = lambda d: np.bincount(d, minlength=len(texts))

    # A's tokens of a group, then B's; each with the mark behind it
    last_a, last_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
    last_a[at_a[both]], last_b[at_b[both]] = 1, 2
    last_b[np.cumsum(n_b)[n_b > 0] - 1] = 3
    # a token's group: the groups that ended before it
    group_a, group_b = (np.cumsum(last > 0) - (last > 0) for last in (last_a, last_b))
    line = np.empty(len(a) + len(b), dtype=object)
    line[np.arange(len(a)) + np.concatenate(([0], at_b[both] + 1))[group_a]] = side_a.shown[last_a * len(side_a.pieces) + a]
    line[np.arange(len(b)) + (at_a[both] + 1)[group_b]] = side_b.shown[last_b * len(side_b.pieces) + b]
    cuts = np.concatenate(([0], np.cumsum(n_a + n_b)))

    link = np.stack([doc, a[at_a] << 32 | b[at_b]])
    link = link[:, np.lexsort((link[1], link[0]))]
    first = np.flatnonzero(np.concatenate(([True], np.any(link[:, 1:] != link[:, :-1], axis=0))))
    counts = np.diff(np.append(first, link.shape[1])).astype(np.int32)
    inner = np.searchsorted(link[0, first], np.arange(1, len(texts)))
    return {
        "n_a": n_a, "n_b": n_b, "n_groups": per_doc(doc[both]), "n_links": per_doc(doc),
        "groups": ["".join(line[lo:hi].tolist()) for lo, hi in zip(cuts[:-1], cuts[1:])],
        "pairs": np.split(link[1, first], inner), "counts": np.split(counts, inner),
    }


def _slices(frame: pd.DataFrame):
    """Runs of rows with about SLICE characters; a longer text is alone."""
    lo = held = 0
    sizes = frame["text"].str.len().tolist()
    for i, n in enumerate(sizes):
        if i > lo and held + n > SLICE:
            yield frame.iloc[lo:i]
            lo, held = i, 0
        held += n
    if len(sizes) > lo:
        yield frame.iloc[lo:]


def aligned(docs: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """Columns of SCHEMA for each row: numbers of tokens, groups and links, the groups (``a1,a2|b1;a3|b2,b3``), distinct links with counts.

    A link is packed as id of A * 2^32 + id of B.
    """
    bounded(docs.sparkSession)

    def align(frames):
        for frame in frames:
            for part in _slices(frame):
                yield pd.DataFrame({"id": part["id"].to_numpy(dtype=object, na_value=None), **_aligned(part["text"].tolist(), folder)})

    return docs.select(F.col(quoted(ident)).cast("long").alias("id"), F.coalesce(F.col(quoted(text)), F.lit("")).alias("text")).mapInPandas(align, SCHEMA)


def pair_table(rows: DataFrame) -> DataFrame:
    """pair, a, b, n: links over the corpus by id pair, of saved rows of ``aligned``."""
    each = rows.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counted = each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n"))
    return counted.select("pair", F.shiftright("pair", 32).cast("int").alias("a"), F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("b"), "n")


def with_best(pairs: DataFrame) -> DataFrame:
    """A saved pair table with best_of_a and best_of_b; ties are all best. The maxima have a row for each id of a vocabulary."""
    for side in "ab":
        top = pairs.groupBy(F.col(side).alias("of")).agg(F.max("n").alias("top"))
        pairs = pairs.join(F.broadcast(top), F.col(side) == F.col("of")).withColumn(f"best_of_{side}", F.col("n") == F.col("top")).drop("of", "top")
    return pairs


def summary(docs: DataFrame, ident: str = "doc_id", text: str = "text", folder: str = FOLDER) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best (links best of their B id), count_sum (counts of their pairs), groups_sha256."""
    scratch = Scratch(docs.sparkSession)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = scratch.save(aligned(docs, ident, text, folder).withColumns({"groups": digest, "row": F.monotonically_increasing_id()}), "rows")
    counted = scratch.save(pair_table(rows), "counted")
    pairs = scratch.save(with_best(counted).select("pair", "n", "best_of_b"), "pairs")

    total = counted.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_PAIRS >= total
    each = rows.select("row", F.explode(F.arrays_zip("pairs", "counts")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.counts").alias("k"))
    few = F.broadcast(pairs.where(hot))
    rest = each.join(F.broadcast(pairs.where(hot).select("pair")), "pair", "left_anti").join(pairs.where(~hot), "pair")
    met = each.join(few, "pair").unionByName(rest)
    sums = met.groupBy(F.col("row").alias("of")).agg(F.sum(F.when(F.col("best_of_b"), F.col("k")).otherwise(0)).alias("n_best"), F.sum(F.col("k") * F.col("n")).alias("count_sum"))
    out = rows.join(sums, F.col("row") == F.col("of"), "left")
    return out.select(
        F.col("id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links",
        *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")), F.col("groups").alias("groups_sha256"),
    )
