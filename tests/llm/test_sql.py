"""Registered queries against their SQL at the smallest scale."""

import duckdb
import pytest

from tessera.llm import registry


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, con, sf, name):
    df = registry.QUERIES[name](spark, sf)
    cur = con.execute(registry.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_other_queries_cover_their_table(spark, con, sf, name):
    got = [r["doc_id"] for r in registry.QUERIES[name](spark, sf).select("doc_id").collect()]
    assert sorted(got) == [r[0] for r in con.execute("SELECT doc_id FROM documents ORDER BY 1").fetchall()]
