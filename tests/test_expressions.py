import pytest
from pyspark.sql import functions as F

from pavilion.functions import expressions as x
from pavilion.functions.fixed_values import REPORT_PHASES, SCORING_ZONES, TARGET_BANDS


def values(spark, column, data, ddl):
    df = spark.createDataFrame([(v,) if not isinstance(v, tuple) else v for v in data], ddl)
    return [r[0] for r in df.select(column).collect()]


def test_safe_div_fills_only_on_zero(spark):
    got = values(spark, x.safe_div("a", "b"), [(6.0, 3.0), (6.0, 0.0), (None, 0.0), (None, 2.0), (6.0, None)], "a double, b double")
    assert got == [2.0, 0.0, 0.0, None, None]
    assert values(spark, x.safe_div("a", "b", fill=None), [(6, 0)], "a int, b int") == [None]


def test_round_even_is_half_to_even(spark):
    data = [0.5, 1.5, 2.5, -0.5, 2.4]
    assert values(spark, x.round_even("v", 0), data, "v double") == [0.0, 2.0, 2.0, -0.0, 2.0]
    assert values(spark, x.round_even("v", 1), [0.25, 0.75], "v double") == [0.2, 0.8]


def test_renames_pass_unknown_names_through(spark):
    assert values(spark, x.canonical_team("t"), ["Delhi Daredevils", "Somewhere XI", None], "t string") == [
        "Delhi Capitals", "Somewhere XI", None]
    assert values(spark, x.canonical_venue("t"), ["Feroz Shah Kotla", "Eden Gardens"], "t string") == [
        "Arun Jaitley Stadium", "Eden Gardens"]


def test_home_flag(spark):
    data = [("Punjab Kings", "Mohali"), ("Punjab Kings", "Pune"), ("Punjab Kings", None), ("Nobody", "Pune"), (None, "Pune")]
    assert values(spark, x.is_home("t", "c"), data, "t string, c string") == [1, 0, 0, 0, 0]


def test_season_year(spark):
    assert values(spark, x.season_year("s"), ["2007/08", "2011", None, "x"], "s string") == [2007, 2011, None, None]


@pytest.mark.parametrize("over,phase", [(1, "Powerplay"), (6, "Powerplay"), (7, "Middle"), (15, "Middle"), (16, "Death"), (21, "Death")])
def test_report_phase(spark, over, phase):
    assert values(spark, x.phase_name("o", REPORT_PHASES), [over], "o int") == [phase]


def test_target_bands_are_left_closed(spark):
    got = values(spark, x.left_closed_band("t", TARGET_BANDS), [99, 100, 119, 120, 299, 300], "t int")
    assert got == [None, "100-119", "100-119", "120-139", "220+", None]


def test_scoring_zones_are_right_closed(spark):
    got = values(spark, x.right_closed_band("r", SCORING_ZONES), [0, 1, 3, 4, 5, 6, 7], "r int")
    assert got == ["dot", "running", "running", "boundary", "boundary", "boundary", None]


def test_mean_of_short_array(spark):
    data = [([1, 2, 6],), ([],), (None,)]
    assert values(spark, x.mean_of(F.col("a"), 45.0), data, "a array<int>") == [3.0, 45.0, 45.0]
