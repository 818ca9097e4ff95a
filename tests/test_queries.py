"""Every registered query against its SQL on another engine: names, types and rows."""

import collections
import glob
import math
import os

import duckdb
import pytest

from millrace.plans import load

R = load()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{p}'")
    return con


def bag(table) -> collections.Counter:
    cols = [table[c].to_pylist() for c in sorted(table.column_names)]
    plain = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v + 0.0 if isinstance(v, float) else str(v)
    return collections.Counter(tuple(map(plain, row)) for row in zip(*cols))


def types(table) -> dict[str, str]:
    return {f.name: str(f.type).replace("large_", "") for f in table.schema}


@pytest.mark.parametrize("name", sorted(R.oracles))
def test_same_as_sql(spark, sf, duck, name):
    mine, theirs = R.builders[name](spark, sf).toArrow(), duck.execute(R.oracles[name]).to_arrow_table()
    assert types(mine) == types(theirs)
    assert bag(mine) == bag(theirs)


@pytest.mark.parametrize("name", sorted(R.builders.keys() - R.oracles.keys()))
def test_without_sql(spark, sf, name):
    assert R.builders[name](spark, sf).toArrow().num_rows > 0
