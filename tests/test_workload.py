"""Every query with an SQL twin, side by side on the smallest driver tables."""

import os

import pytest

import check
import __spark_entry__ as contract

SF = str(check.DATA / "sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    return check.connect(SF)


def test_entry(spark):
    df = contract.entry(spark)
    assert df.columns == ["bowler", "wickets", "balls", "runs", "economy"] and df.count() == 15


# Full models take minutes to fit; check.py compares these two, test_models.py covers the parts with few trees.
@pytest.mark.parametrize("name", sorted(set(contract.oracle_sql()) - {"model_round_trip", "prediction_invariants"}))
def test_query_agrees_with_sql(spark, duck, name):
    assert check.compare(spark, duck, name, SF)[1].startswith("ok")


def test_every_sql_twin_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())
