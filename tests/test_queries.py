import math

import duckdb
import pytest

from lexivec.plans.queries import QUERIES, SQL


def norm(rows):
    clean = lambda x: None if isinstance(x, float) and math.isnan(x) else round(x, 5) if isinstance(x, float) else x
    return sorted(map(str, (tuple(map(clean, r)) for r in rows)))


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark", "events", "conversations", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_as_sql(spark, sf, db, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    want = db.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert len(got) == len(want) > 0
    assert norm(got) == norm(want)
