"""Each catalog query against its SQL oracle at the smallest scale."""

from pathlib import Path

import duckdb
import pytest

from quarry.plans import build, catalog, entities, more, ops, resolve, rules, scope, search  # noqa: F401

SF = "/root/testdata/sf0.001"


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(map(str, ([f"{r[i]:.4f}" if isinstance(r[i], float) else str(r[i]) for i in order] for r in data)))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.sql(catalog.ORACLES[name])
    got = catalog.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
