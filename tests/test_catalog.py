import sys
from pathlib import Path

import pytest
from conftest import SMALL

sys.path.insert(0, str(Path(__file__).resolve().parent.parent / "tools"))

import __spark_entry__ as entry  # noqa: E402

check = pytest.importorskip("check")


@pytest.fixture(scope="module")
def db():
    return check.connect(SMALL)


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", list(entry.queries()))
def test_query(spark, db, name):
    ok, note = check.compare(spark, db, SMALL, name, entry.oracle_sql().get(name))
    assert ok is not False, note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
