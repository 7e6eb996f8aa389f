"""Every registered query outside the corpus package: it runs, and equals its SQL twin on the smallest tables."""

from collections import Counter

import duckdb
import pytest

from tidewater.plans import audits, boosted, fifth, fourth, lines, live, more, portfolios, scored, third, wider  # noqa: F401
from tidewater.plans.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return float(f"{float(v):.9g}") + 0.0
    except TypeError:
        return str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, small, duck, name):
    got = QUERIES[name](spark, small)
    names = sorted(got.columns)
    rows = Counter(tuple(plain(x) for x in r) for r in got.select(*[f"`{c}`" for c in names]).collect())
    if name not in ORACLES:
        assert rows
        return
    found = duck.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == names
    order = [columns.index(c) for c in names]
    assert rows == Counter(tuple(plain(r[i]) for i in order) for r in found.fetchall())
