"""Every registered query of the library against its SQL, at the smallest scale."""

import duckdb
import pytest

from tessera import queries
from tessera.plans import jobs
from tessera import fixtures as fx

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


def canon(rows, columns):
    by = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted((tuple(one(r[i]) for i in by) for r in rows), key=repr)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, con, sf, name):
    df = queries.QUERIES[name](spark, sf)
    cur = con.execute(queries.SQL[name])
    columns = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), columns)


def test_jobs(spark, sf):
    out = jobs.error_analysis(fx.pred(spark, sf), fx.gt(spark, sf), top_k=3)
    assert out["ranking"].count() == 3 and out["class_priority"].count() == 5
    index, cases = fx.embeddings(spark, sf)
    images = index.select("object_id", index["object_id"].alias("image_id"))
    samples = images.selectExpr("image_id", "concat('s', image_id) AS stem")
    made = jobs.hard_mining(cases, index, samples, images, 3)
    copies = made["manifest"].selectExpr("sum(selection_count) AS n").first()["n"]
    assert made["oversampled"].count() == samples.count() + copies


def test_split_cuts_at_the_same_double(spark, tmp_path):
    """90 * 0.7 is less than 63 as a double, and int(n * ratio) is the rule; a decimal would say 63."""
    spark.range(90).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    got = {r["image_id"]: r["split"] for r in queries.QUERIES["split_dataset"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW customer AS SELECT * FROM read_parquet('{tmp_path}/customer.parquet/*.parquet')")
    assert got == dict(c.execute(queries.SQL["split_dataset"]).fetchall())
    assert sum(v == "train" for v in got.values()) == int(90 * 0.7) == 62
