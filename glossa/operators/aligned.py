"""Aligned segments: scripts, token maps, highlights of a query on both sides, and what is exported of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions.text import has_hanzi, let

# Short target words that aren't lit alone.
LONE_STOPS = ["a", "az", "és"]


def traditional(df: DataFrame, key: str, text: str, info: DataFrame) -> DataFrame:
    """key, traditional: whether a text has a character that info (hanzi, can_be_simp) says is no simplified one."""
    chars = df.where(has_hanzi(F.col(text))).select(key, F.explode(F.array_distinct(F.split(text, ""))).alias("hanzi"))
    met = chars.join(info.select("hanzi", "can_be_simp"), "hanzi", "left")
    return met.groupBy(key).agg(F.max(~F.coalesce("can_be_simp", F.lit(True))).alias("traditional"))


def lit_tokens(segments: DataFrame, query: str, prune: bool = True) -> DataFrame:
    """segment_id, ix, start, length, score: target tokens that a query found in the source lights up.

    Segments have segment_id, src, trg, src_map and trg_map (arrays of a, b: start and length) and align (array of ix1, ix2,
    score). Source tokens that cover the first or the last place of the query count; of a target token the best score. A
    short stop word without a lit neighbour stays dark. Everything happens inside the row.
    """
    at = F.instr("src", F.lit(query)) - 1
    covers = lambda p, place: (p["a"] <= place) & (p["a"] + p["b"] > place)
    chosen = F.filter(F.transform("src_map", lambda p, i: F.when(covers(p, F.col("at")) | covers(p, F.col("at") + len(query) - 1), i)), lambda i: i.isNotNull())
    near = segments.where(F.contains("src", F.lit(query))).withColumn("at", at)
    # bound: the few links of the chosen tokens are found once a row, before each target token looks for its own
    links = let(chosen, lambda c: F.filter("align", lambda x: F.array_contains(c, x["ix1"])))
    best = let(links, lambda few: F.transform("trg_map", lambda p, i: F.struct(i.alias("ix"), p["a"].alias("start"), p["b"].alias("length"), F.array_max(F.transform(F.filter(few, lambda x: x["ix2"] == i), lambda x: x["score"])).alias("score"))))
    near = near.withColumn("best", best)
    lone = lambda x: F.get("best", x["ix"] - 1)["score"].isNull() & F.get("best", x["ix"] + 1)["score"].isNull() & (x["length"] <= 2) & F.lower(F.substring(F.col("trg"), x["start"] + 1, x["length"])).isin(*LONE_STOPS)
    lit = F.filter("best", lambda x: x["score"].isNotNull() & (~lone(x) if prune else F.lit(True)))
    return near.select("segment_id", F.explode(lit).alias("t")).select("segment_id", "t.*")


def lit_spans(tokens: DataFrame) -> DataFrame:
    """segment_id, start, end, score: lit tokens, and the gaps between two that follow each other with the lower score."""
    nxt = F.expr("lead(struct(ix, start, score)) OVER (PARTITION BY segment_id ORDER BY ix)")
    each = tokens.withColumn("next", nxt)
    own = each.select("segment_id", "start", (F.col("start") + F.col("length")).alias("end"), "score")
    gap = each.where("next.ix = ix + 1 AND next.start > start + length").select("segment_id", (F.col("start") + F.col("length")).alias("start"), F.col("next.start").alias("end"), F.least("score", "next.score").alias("score"))
    return own.unionByName(gap)


def page_of(hits: DataFrame, key: str, offset: int, size: int) -> DataFrame:
    """One page of hits in key order, each row with whether more follow."""
    rows = hits.orderBy(key).offset(offset).limit(size + 1)
    return rows.withColumn("place", F.expr(f"row_number() OVER (ORDER BY {key})")).withColumn("more", F.expr("count(*) OVER ()") > size).where(F.col("place") <= size).drop("place")
