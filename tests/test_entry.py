"""Driver contract and the DuckDB oracle gate at sf0.001 (the driver repeats it at sf0.01)."""

import math

import duckdb
import pytest

import __spark_entry__ as E

from .conftest import SF0001

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "event_id" in df.columns


def test_registry_consistent():
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs)
    assert len(qs) >= 150


def _norm(v):
    import pandas as pd

    if v is None or v is pd.NA or v is pd.NaT:
        return None
    if isinstance(v, (bool, int)):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        r = round(v, 6)
        return int(r) if r == int(r) and abs(r) < 2**53 else r
    if hasattr(v, "isoformat"):
        return v.replace(tzinfo=None).isoformat() if hasattr(v, "tzinfo") else v.isoformat()
    if hasattr(v, "item") and not isinstance(v, (str, bytes)):
        return _norm(v.item())
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF0001}/{t}.parquet')")
    return con


# the training-data operators have tests of their own in tests/llm
NAMES = sorted(n for n in E.oracle_sql() if not n.startswith("op"))


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, duck, name):
    sp = E.queries()[name](spark, SF0001).toPandas()
    dk = duck.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(dk.columns)
    cols = sorted(sp.columns)
    key = lambda r: repr(r)
    a = sorted((tuple(_norm(x) for x in r) for r in sp[cols].itertuples(index=False, name=None)), key=key)
    b = sorted((tuple(_norm(x) for x in r) for r in dk[cols].itertuples(index=False, name=None)), key=key)
    assert a == b


def test_entry_without_the_training_data_subpackage(monkeypatch):
    """The driver may remove ``corpus_pipeline`` and the ``llm`` folders."""
    import sys

    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("tidepool.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)  # importing it fails
    qs, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(qs) and "pipeline" not in qs and not any(n.startswith("op") for n in qs)
    assert not any(m.startswith("tidepool.llm") for m in sys.modules)
