import datetime as dt

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tradewind.functions.matching import contains, segments, tokens
from tradewind.functions.parse import (
    lenient_date, lenient_double, lenient_long, lenient_timestamp, strict_long, strict_utc_timestamp, whole,
)
from tradewind.functions.rounding import percent
from tradewind.functions.text import flag, normalize, strip


def values(spark, function, inputs, schema="x string"):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], f"i int, {schema}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("x"))).collect()]


def test_strip_knows_all_whitespace_and_keeps_case(spark):
    assert values(spark, strip, ["\t A b\n", " x ", "  ", None]) == ["A b", "x", "", None]


def test_normalize_lowers_and_keeps_null_also_in_an_all_null_column(spark):
    assert values(spark, normalize, [" ABC ", None]) == ["abc", None]
    assert values(spark, normalize, [None, None]) == [None, None]


def test_flag_spellings(spark):
    inputs = ["t", " TRUE ", "1", "f", "False", "0 ", "yes", "", None]
    assert values(spark, flag, inputs) == [True, True, True, False, False, False, None, None, None]


def test_lenient_parsers_turn_bad_text_into_null(spark):
    assert values(spark, lenient_long, [" 12 ", "146.0", "12.5", "1e3", "abc", "", None]) == [12, 146, None, 1000, None, None, None]
    assert values(spark, lenient_double, ["1.5", "1e2", "nan", "abc", None]) == [1.5, 100.0, None, None, None]
    assert values(spark, lenient_double, ["12d", "2.5f", "0x1p3", "1_0", "1e", "."]) == [None] * 6
    assert values(spark, lenient_double, [" -.5E-1 ", "+7.", "inf", "-Infinity"]) == [-0.05, 7.0, float("inf"), float("-inf")]
    assert values(spark, whole, [1.5, 2.0, None], "x double") == [None, 2, None]
    assert values(spark, lenient_timestamp, ["2019-10-01 00:00:05", "2019-13-01", "soon", None]) == [
        dt.datetime(2019, 10, 1, 0, 0, 5), None, None, None,
    ]
    assert values(spark, lenient_date, ["2019-10-01 10:00:00", "2019-10-02", "?"]) == [
        dt.date(2019, 10, 1), dt.date(2019, 10, 2), None,
    ]


def test_no_digit_of_a_number_is_cut(spark):
    whole = {"146.000000000000000000": 146, "5.": 5, ".0": 0, "-0": 0, "1.50e1": 15, "100E-2": 1, "0.5e1": 5, "12e1": 120, "+7e0": 7, "0e-9": 0}
    assert values(spark, lenient_long, list(whole)) == list(whole.values())
    broken = ["146.0000001", "146.00000000000000000000001", "1.55e1", "1e-1", "150e-2", "1e40", "9223372036854775808", "e5", ".", "1e", "12d", "0x10"]
    assert values(spark, lenient_long, broken) == [None] * len(broken)
    with pytest.raises(Exception, match="bad value in x"):
        values(spark, lambda c: strict_long(c, "x"), ["146.0000001"])


def test_lenient_times_take_offsets_off_and_know_no_other_zones(spark):
    inputs = ["2019-10-01T00:00:00+05:00", "2019-10-01 00:00:00-0930", "2019-10-01 10:00 UTC", "2019-10-01T10:00:00Z", "2019-10", " 2019 "]
    assert values(spark, lenient_timestamp, inputs) == [
        dt.datetime(2019, 9, 30, 19), dt.datetime(2019, 10, 1, 9, 30), dt.datetime(2019, 10, 1, 10), dt.datetime(2019, 10, 1, 10),
        dt.datetime(2019, 10, 1), dt.datetime(2019, 1, 1),
    ]
    assert values(spark, lenient_timestamp, ["2019-10-01 00:00:00 Europe/Paris", "2019-10-01 CET", "2019-10-01T00:00:00+5", "2019-02-30"]) == [None] * 4
    assert values(spark, lenient_date, ["2019-10-01T00:00:00+05:00", "2019-10-01 Europe/Paris"]) == [dt.date(2019, 9, 30), None]


@given(st.integers(-(2**63), 2**63 - 1))
@settings(max_examples=15, deadline=None)
def test_long_ids_stay_exact(number):
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    if spark is None:
        pytest.skip("no session")
    assert values(spark, lenient_long, [str(number), f"{number}.0"]) == [number, number]


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_strict_parsers_fail_on_bad_text_with_and_without_ansi(spark, settings, ansi):
    settings(spark__sql__ansi__enabled=ansi)
    assert values(spark, lambda c: strict_long(c, "x"), ["7", "8.0"]) == [7, 8]
    for bad in ("abc", None):
        with pytest.raises(Exception, match="bad value in x"):
            values(spark, lambda c: strict_long(c, "x"), ["7", bad])
    assert values(spark, lambda c: strict_utc_timestamp(c, "x"), ["2019-10-01 00:00:00 UTC", None]) == [
        dt.datetime(2019, 10, 1), None,
    ]
    zoned = ["2019-10-01 10:00:00+05:00", "2019-10-01T10:00:00.5-0330", "2019-10-01 10:00:00Z", "2019-10-01"]
    assert values(spark, lambda c: strict_utc_timestamp(c, "x"), zoned) == [
        dt.datetime(2019, 10, 1, 5), dt.datetime(2019, 10, 1, 13, 30, 0, 500_000), dt.datetime(2019, 10, 1, 10), dt.datetime(2019, 10, 1),
    ]
    for bad in ("yesterday UTC", "2019-10-01 10:00:00 Europe/Berlin", "2019-13-01 UTC"):
        with pytest.raises(Exception, match="bad value in x"):
            values(spark, lambda c: strict_utc_timestamp(c, "x"), [bad])


def test_utc_times_do_not_depend_on_the_session_time_zone(spark, settings):
    settings(spark__sql__session__timeZone="Asia/Tokyo")
    assert values(spark, lambda c: strict_utc_timestamp(c, "x"), ["2019-10-01 00:00:00 UTC"]) == [dt.datetime(2019, 10, 1)]


def test_percent_styles_differ_on_halves(spark):
    df = spark.createDataFrame([(1, 800), (3, 800), (1, 3), (0, 5)], "p bigint, n bigint")

    def rates(style):
        return [r[0] for r in df.orderBy("n", "p").select(percent(F.col("p"), F.col("n"), style)).collect()]

    assert rates("half_up") == [33.33, 0.0, 0.13, 0.38]
    assert rates("half_even") == [33.33, 0.0, 0.12, 0.38]
    assert rates("scaled") == [33.33, 0.0, 0.13, 0.38]
    with pytest.raises(ValueError):
        rates("other")


def test_match_modes_differ(spark):
    codes = ["a.ring", "a.Ring", "a.rings", "a.hard_ring", "ring", None]
    found = {
        "token": values(spark, lambda c: F.array_contains(tokens(c), "ring"), codes),
        "segment": values(spark, lambda c: F.array_contains(segments(c), "ring"), codes),
        "contains": values(spark, lambda c: contains(c, "ring"), codes),
    }
    assert found == {
        "token": [True, True, False, True, True, False],
        "segment": [True, True, False, False, True, False],
        "contains": [True, False, True, True, True, None],
    }


def test_tokens_are_words_of_any_script_in_order(spark):
    assert values(spark, tokens, ["Kitchen.KÜCHE_café-3", None]) == [["kitchen", "küche", "café", "3"], []]
    assert values(spark, segments, ["Kitchen.KÜCHE_café", "a"]) == [["kitchen", "küche_café"], ["a"]]
