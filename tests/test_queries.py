"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import math
import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as registry  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = registry.oracle_sql()
SLOW = {"kmeans_sweep", "kmeans_best_k", "truncated_svd_terms", "umap_reduce", "embedding_clusters", "hdbscan_sweep"}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def value(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in cols) for r in df.collect())
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == cols
    order = [names.index(c) for c in cols]
    assert got == sorted(tuple(value(row[i]) for i in order) for row in result.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = registry.entry(spark)
    assert "first_user_content" in df.columns and df.count() > 0
    assert set(ORACLES) <= set(registry.queries())
