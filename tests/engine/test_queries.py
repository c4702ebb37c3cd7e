"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from plumbline.plans import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def plain(v):
    if v is None or v != v:
        return ""
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def connection():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, connection, name):
    got = queries.QUERIES[name](spark, SF)
    want = connection.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(tuple(plain(r[c]) for c in order) for r in got.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", ["canonical_aggregate", "resolve_similarity", "nearest_anchor", "legend_text_lines", "pass_merge", "mode_share"])
def test_partitioning_never_shows(spark, name):
    rows = []
    for n in ("1", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        rows.append(sorted(map(str, queries.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert rows[0] == rows[1]


def test_fuzzy_names(spark):
    got = queries.golden_fuzzy(spark, SF).collect()
    assert got and all(r["found"] == r["item_name"] + "s" for r in got)
