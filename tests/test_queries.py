"""Every query that has SQL is compared with DuckDB over the smallest tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from leakscope.queries import REGISTRY

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_as_sql(spark, con, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    rel = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == cols
    want = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in rel.fetchall()], key=repr)
    assert got == want
    spark.catalog.clearCache()


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_others_run(spark, name):
    df = entry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns) and df.count() >= 0
    spark.catalog.clearCache()


#: Those that collect a bounded plan of loads or a name while they are built.
PLANNED = {"p2_repo_risk", "p2_found", "repo_concentration", "lsh_content_match", "hit_histogram"}


@pytest.mark.parametrize("name", sorted(set(REGISTRY) - PLANNED))
def test_building_runs_nothing(spark, name):
    """Building a query reads footers at most: no shuffle is run to look at its result."""
    spark.sparkContext.setJobGroup(f"build-{name}", name)
    entry.queries()[name](spark, SF)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"build-{name}") for s in tracker.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert all(s is None or s.name.startswith("parquet") for s in stages), [s.name for s in stages if s]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
