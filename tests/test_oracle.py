"""Every registered query next to its SQL on the small tables."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tidemark.plans import load  # noqa: E402
from tools.check import compare, duck  # noqa: E402

SF = os.environ.get("TIDEMARK_SF", "/root/testdata/sf0.001")
NAMES = sorted(load())


@pytest.fixture(scope="module")
def con():
    pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_agrees_with_sql(spark, con, name):
    status, note, _ = compare(spark, con, load()[name], SF)
    assert status == "ok", note
    assert "TYPES" not in note, note


def test_every_query_has_sql():
    assert not [n for n, q in load().items() if q.sql is None]


def test_entry_points(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 200
    assert e.entry(spark).count() > 0
