"""Every registered key against its DuckDB twin on the smallest driver tables.

Rows are compared order-insensitively after normalising floats to 6 decimals; keys without
an oracle must at least run and return a stable schema."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

QUERIES = E.queries()
ORACLE = E.oracle_sql()


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda t: tuple((x is None, str(x)) for x in t))


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_key_matches_oracle(spark, duck, key):
    df = QUERIES[key](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    assert len(cols) == len(set(cols)), "duplicate output column names"
    if key not in ORACLE:
        assert df.columns == QUERIES[key](spark, SF_SMALL).columns
        return
    cur = duck.execute(ORACLE[key])
    dcols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(dcols)
    assert _rows(cols, rows) == _rows(dcols, cur.fetchall())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns[:3] == ["month", "year", "month_number"]


def test_every_survey_area_has_keys():
    prefixes = {k.split("_")[0].rstrip("0123456789") for k in QUERIES}
    for p in ("s", "k", "n", "f", "j", "a", "w", "o", "u", "r", "x", "m", "t", "e", "q", "st", "v", "ex"):
        assert p in prefixes, p
