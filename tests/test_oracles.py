"""Every query that has SQL gives the same rows as DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from phasegrid.queries import ORACLES, QUERIES

#: Whole plans are tested in test_unwrap.
SLOW = {"unwrap_mcf", "unwrap_mst", "unwrap_defo", "unwrap_laplace"}


@pytest.fixture(scope="module")
def tables(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_same_rows(spark, sf_dir, tables, name):
    found = QUERIES[name](spark, sf_dir)
    names = sorted(found.columns)
    rows = Counter(tuple(r) for r in found.select(*[f"`{c}`" for c in names]).collect())
    sql = tables.execute("SELECT " + ", ".join(f'"{c}"' for c in names) + f" FROM ({ORACLES[name]}) AS t").fetchall()
    assert rows == Counter(sql)


def test_entry_has_a_stable_schema(spark, sf_dir):
    import __spark_entry__ as e

    assert e.queries()["arc_reliability"](spark, sf_dir).columns == ["sigsq", "gain", "arcs"]
    assert set(e.oracle_sql()) <= set(e.queries())
