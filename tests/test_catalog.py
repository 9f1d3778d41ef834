import duckdb
import pytest

from textloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def twin(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL | catalog.SLOW_SQL))
def test_query_equals_sql(spark, twin, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = sorted(repr([norm(r[c]) for c in columns]) for r in df.collect())
    got = twin.execute((catalog.SQL | catalog.SLOW_SQL)[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    assert rows == sorted(repr([norm(r[i]) for i in at]) for r in got.fetchall())
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL) - set(catalog.SLOW_SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
    spark.catalog.clearCache()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 40


def test_small_negative_numbers_round_to_minus_zero(spark, tmp_path):
    spark.createDataFrame([(1, [1.0, -1e-7, 1e-7, -0.5])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(catalog.SQL["vec_normalize"]).fetchall()[0][1]
    assert repr(catalog.QUERIES["vec_normalize"](spark, str(tmp_path)).first().unit) == repr(want) and repr(want[1]) == "-0.0"
