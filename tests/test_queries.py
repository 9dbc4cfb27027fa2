"""Every registered query of the engine against its SQL, on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

from siltstone import catalog

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


def plain(frame):
    """Rows with columns by name, sorted, with numbers and nulls alike."""

    def value(x):
        if x is None or isinstance(x, float) and math.isnan(x) or str(x) == "<NA>":
            return "null"
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        return format(round(float(x), 6), "g") if isinstance(x, (int, float)) or hasattr(x, "dtype") else str(x)

    return sorted(tuple(value(x) for x in row) for row in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_its_sql(spark, duck, name):
    ours = catalog.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(catalog.oracle_sql()[name]).fetchdf()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
