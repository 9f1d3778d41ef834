import duckdb
import pytest

from textloom.llm import registry


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = con.execute(registry.SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in columns]
    assert sorted(repr([norm(r[c]) for c in columns]) for r in df.collect()) == sorted(repr([norm(r[i]) for i in at]) for r in got.fetchall())
