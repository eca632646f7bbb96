"""Registered queries against DuckDB on the smallest data set."""

import importlib
import pkgutil

import pytest

import __spark_entry__ as entry
import check
import martlight.plans
from martlight.session import stable
from tests.conftest import SF

#: The queries of the training-data part are compared in its own tests.
KEYS = [k for k in entry.queries() if k in entry.oracle_sql() and not k.startswith("op")]
#: Inputs that many queries derive first; here they are derived once.
SHARED = ("features_table", "modelling_set", "purchase_rows", "trend_retention")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


@pytest.fixture(scope="module", autouse=True)
def shared_inputs():
    made = {}

    def once(name, make):
        return lambda t: made[name] if name in made else made.setdefault(name, stable(make(t)))

    with pytest.MonkeyPatch.context() as patch:
        for found in pkgutil.iter_modules(martlight.plans.__path__):
            module = importlib.import_module(f"martlight.plans.{found.name}")
            for name in SHARED:
                if hasattr(module, name):
                    patch.setattr(module, name, once(name, getattr(module, name)))
        yield


def test_every_statement_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_statement(spark, duck, key):
    rows, same, note = check.compare(spark, duck, key, SF)
    assert same, note
    assert not note


def test_entry(spark):
    assert entry.entry(spark).count() > 0
