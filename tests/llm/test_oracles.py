"""Operators that SQL can express against it, and the schemas that the others promise, on the smallest tables."""

import duckdb
import pytest

from glossa.llm import queries as q

DIR = "/root/testdata/sf0.001"
PROMISED = {
    "op4_boosted_candidates": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op5_nearest_url": ["page_id", "url", "text", "n_chars"],
    "op9_hashed_ngrams": ["page_id", "host", "path", "rule", "verdict"],
}


def rows(df):
    cell = lambda v: "~" if v is None or v != v else str(v)
    return sorted(tuple("~" if str(v) == "<NA>" else cell(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.ORACLES))
def test_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = q.QUERIES[name](spark, DIR).toPandas(), c.sql(q.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) == len(want)
    if "refers_to" in got:
        got["refers_to"] = got["refers_to"].astype("Int64")
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(PROMISED))
def test_schema_and_rows(spark, name):
    out = q.QUERIES[name](spark, DIR)
    assert set(PROMISED[name]) <= set(out.columns)
    table = "documents" if name.startswith("op4") else "pages"
    assert out.count() == spark.read.parquet(f"{DIR}/{table}.parquet").count()
