"""The driver contract: every registered glossary query against its oracle."""

import pytest

import __spark_entry__ as entry
from lexicarta.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def canonical(rows):
    return sorted(tuple("~" if x is None else str(round(x, 6)) if isinstance(x, float) else str(x) for x in r) for r in rows)


def test_registry():
    assert set(ORACLES) <= set(QUERIES) and set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert len(QUERIES) >= 55


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = canonical(df.select(*columns).collect())
    if name not in ORACLES:
        assert got
        return
    rows = duck.execute(ORACLES[name])
    names = [x[0] for x in rows.description]
    assert sorted(names) == columns
    assert got == canonical([r[names.index(c)] for c in columns] for r in rows.fetchall())
