"""Pearson test: p-value accuracy, edge cases and properties."""

from __future__ import annotations

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import builders as b
from gpsight.functions.stats import t_two_sided_p
from gpsight.operators.correlate import pearson_test


def _p(spark, t, df):
    return spark.range(1).select(t_two_sided_p(F.lit(float(t)), F.lit(df)).alias("p")).collect()[0].p


def _closed_form(t, df):
    """Two-sided tail for df = 1, 2, 3 (closed forms of the Student-t CDF)."""
    if df == 1:
        return 1 - 2 / math.pi * math.atan(t)
    if df == 2:
        return 1 - t / math.sqrt(2 + t * t)
    if df == 3:
        return 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + math.sqrt(3) * t / (3 + t * t))
    raise ValueError(df)


@pytest.mark.parametrize("t", [0.0, 0.3, 1.0, 2.5, 7.0, 40.0])
@pytest.mark.parametrize("df", [1, 2, 3])
def test_p_value_matches_closed_forms(spark, t, df):
    assert _p(spark, t, df) == pytest.approx(_closed_form(t, df), abs=1e-11)


@pytest.mark.parametrize("t,df,expected", [
    (2.228139, 10, 0.05),       # published t-table points (two-sided 5 %)
    (12.706205, 1, 0.05),
    (2.063899, 24, 0.05),
    (2.575829, 1_000_000, 0.01),  # normal limit
])
def test_p_value_table_points(spark, t, df, expected):
    assert _p(spark, t, df) == pytest.approx(expected, abs=2e-7)


def test_p_value_tiny_tail_keeps_relative_accuracy(spark):
    # t = 9, df = 400: about 9.2e-18
    p = _p(spark, 9.0, 400)
    assert 8.5e-18 < p < 9.9e-18


def _test(spark, xy):
    return pearson_test(b.pairs(spark, xy), "x", "y").collect()[0]


def test_constant_column_gives_null_r(spark):
    row = _test(spark, [(1, 1), (1, 2), (1, 3)])
    assert row.n == 3 and row.r is None and row.p_value is None


def test_null_in_a_pair_is_dropped(spark):
    row = _test(spark, [(1, 2), (2, None), (3, 5), (4, 4)])
    assert row.n == 3
    assert row.r == pytest.approx(0.785714286, abs=1e-9)
    assert row.df == 1
    assert row.ci_low is None  # n = 3: no interval, as in cor.test


def test_perfect_correlation(spark):
    row = _test(spark, [(1, 2), (2, 4), (3, 6)])
    assert row.r == 1.0 and row.p_value == 0.0 and row.t is None and row.significant


def test_too_few_pairs(spark):
    row = _test(spark, [(1, 2), (2, 3)])
    assert row.n == 2 and row.r is None and row.df is None


def test_reference_style_example(spark):
    # x, y with a known cor.test outcome: r = 0.7745967, t = 2.1213, df = 3, p = 0.1240
    xy = [(1, 1), (2, 3), (3, 2), (4, 5), (5, 4)]
    row = _test(spark, xy)
    assert row.r == pytest.approx(0.8, abs=1e-9)
    assert row.t == pytest.approx(0.8 * math.sqrt(3 / 0.36), abs=1e-8)
    assert row.p_value == pytest.approx(_closed_form(0.8 * math.sqrt(3 / 0.36), 3), abs=1e-9)
    z = math.atanh(0.8)
    half = 1.959963984540054 / math.sqrt(2)
    assert row.ci_low == pytest.approx(math.tanh(z - half), abs=1e-9)
    assert row.ci_high == pytest.approx(math.tanh(z + half), abs=1e-9)


finite = st.floats(min_value=-1e3, max_value=1e3, allow_nan=False, allow_infinity=False)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(finite, finite), min_size=4, max_size=30),
       st.floats(min_value=0.01, max_value=100))
def test_r_bounded_and_scale_invariant(spark, xy, scale):
    a = _test(spark, xy)
    if a.r is None:
        return
    assert -1.0 <= a.r <= 1.0
    scaled = _test(spark, [(x * scale, y) for x, y in xy])
    if scaled.r is not None:
        assert scaled.r == pytest.approx(a.r, abs=1e-6)
    if a.p_value is not None:
        assert 0.0 <= a.p_value <= 1.0


def test_result_independent_of_partitioning(spark):
    xy = [(i, (i * 7919) % 101) for i in range(200)]
    one = pearson_test(b.pairs(spark, xy).coalesce(1), "x", "y").collect()[0]
    many = pearson_test(b.pairs(spark, xy).repartition(7), "x", "y").collect()[0]
    assert one.n == many.n == 200
    assert one.r == pytest.approx(many.r, abs=1e-9)
    assert one.p_value == pytest.approx(many.p_value, abs=1e-9)


@pytest.mark.parametrize("df", [10**6, 10**9, 10**12])
def test_p_value_large_df_approaches_normal(spark, df):
    # P(|T| > 1.96) - P(|Z| > 1.96) shrinks like 1/df (about 0.2773 / df here)
    normal = math.erfc(1.96 / math.sqrt(2))
    diff = _p(spark, 1.96, df) - normal
    assert diff == pytest.approx(0.2773 / df, rel=0.1, abs=1e-14)
