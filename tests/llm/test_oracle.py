"""Registered queries against their DuckDB SQL on the smallest test scale."""

import math

import duckdb
import pytest

from __spark_entry__ import queries
from cartwheel.llm.registry import llm_oracle_sql, llm_queries

SF = "/root/testdata/sf0.001"


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return v


def test_every_operator_is_registered():
    numbers = [int(n[2:].split("_")[0]) for n in llm_queries()]
    assert sorted(numbers) == list(range(1, 14)) and {*llm_queries(), "pipeline"} <= set(queries())


@pytest.mark.parametrize("name", sorted(llm_oracle_sql()))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries()[name](spark, SF)
    res = con.execute(llm_oracle_sql()[name])
    names = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(names)
    rows = sorted((tuple(_norm(r[c]) for c in names) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(map(_norm, r)) for r in res.fetchall()), key=repr)
