"""Every registered query against its SQL, and the driver's contract."""

import math
import os

import pytest

import __spark_entry__ as entry_module
from quern.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in os.listdir(SF):
        if name.endswith(".parquet"):
            con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


def rows(frame):
    def plain(x):
        if x is None or isinstance(x, float) and math.isnan(x):
            return None
        if hasattr(x, "item"):
            x = x.item()
        return round(x, 9) if isinstance(x, float) else x

    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(repr(tuple(plain(x) for x in r)) for r in frame.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_agrees_with_sql(spark, duck, name):
    own = registry.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(registry.ORACLE_SQL[name]).fetchdf()
    assert sorted(own.columns) == sorted(theirs.columns)
    assert rows(own) == rows(theirs)


def test_entry_covers_all_rows_in_order(spark):
    found = entry_module.entry(spark).orderBy("part").collect()
    assert sum(r["rows"] for r in found) == spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert all(r["violations"] == 0 for r in found)
    ends = [((r["first_orderkey"], r["first_linenumber"]), (r["last_orderkey"], r["last_linenumber"])) for r in found]
    assert all(a[1] < b[0] for a, b in zip(ends, ends[1:], strict=False))


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
