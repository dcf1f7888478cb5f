"""Every query with SQL against DuckDB on the smallest tables, and properties of the others."""

import math

import duckdb
import pytest

from rasterfold.plans.oracle import ORACLE_SQL
from rasterfold.plans.queries import QUERIES
from rasterfold.plans.scene_oracle import SCENE_SQL
from rasterfold.plans.scene_queries import SCENE_QUERIES

ALL_SQL, ALL = {**ORACLE_SQL, **SCENE_SQL}, {**QUERIES, **SCENE_QUERIES}
DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("lineitem", "events", "embeddings", "conversations", "part"):
        c.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ALL_SQL))
def test_sql(spark, con, name):
    df = ALL[name](spark, DIR)
    cols = sorted(df.columns)
    rel = con.sql(ALL_SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == want


def test_anaglyph_and_view_cover_the_frame(spark):
    assert QUERIES["sheared_view"](spark, DIR).count() == QUERIES["anaglyph"](spark, DIR).count() == 768
