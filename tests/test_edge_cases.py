"""Edge cases the test tables do not contain (FIXTURES.md section 3)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import builders as b
from gpsight.functions.expr import round_half_even, year_month
from gpsight.operators import drugs, rates, register, spend, validate


def test_practice_without_dm_rows_gets_null_rate(spark):
    q = b.qof(spark, [("W00001", "AF001", 5, 100), ("W00009", "DM001", 3, 30)])
    one_pass = b.as_dict(rates.indicator_rate(q, "DM"), "practiceid", "rate_diabetes")
    written = b.as_dict(rates.indicator_rate_full_join(q, "DM"), "practiceid", "rate_diabetes")
    assert one_pass == written == {"W00001": None, "W00009": 0.1}


def test_zero_list_size_gives_ieee_values_not_error(spark):
    import math
    q = b.qof(spark, [("W00002", "DM001", 1, 0), ("W00003", "DM001", 0, 0),
                      ("W00005", "DM001", None, 0)])
    got = b.as_dict(rates.indicator_rate(q), "practiceid", "rate_diabetes")
    assert got["W00002"] == math.inf and math.isnan(got["W00003"]) and got["W00005"] is None
    one = rates.rate_percent(rates.practice_qof(q, "W00002")).collect()[0]["rate_pct"]
    assert one == math.inf


def test_floor_division_passes_special_values(spark):
    import math
    from gpsight.functions.expr import floor_div
    row = spark.range(1).select(
        floor_div(F.lit(5.0), F.lit(0.0)).alias("a"), floor_div(F.lit(-5.0), F.lit(0)).alias("b"),
        floor_div(F.lit(0.0), F.lit(0.0)).alias("c"), floor_div(F.lit(1e300), F.lit(1.0)).alias("d"),
        floor_div(F.lit(None).cast("double"), F.lit(0.0)).alias("e")).collect()[0]
    assert row.a == math.inf and row.b == -math.inf and math.isnan(row.c)
    assert row.d == 1e300 and row.e is None


def test_null_numerator_policies(spark):
    q = b.qof(spark, [("W00003", "DM001", None, 50), ("W00003", "DM002", 4, 50)])
    skip = b.as_dict(rates.indicator_rate(q), "practiceid", "rate_diabetes")
    prop = b.as_dict(rates.indicator_rate(q, na="propagate"), "practiceid", "rate_diabetes")
    assert skip == {"W00003": 4 / 50}
    assert prop == {"W00003": None}
    prop_patients = b.as_dict(rates.indicator_patients(q, na="propagate"), "practiceid",
                              "diabetes_patients")
    assert prop_patients == {"W00003": None}


def test_register_matches_prefix_not_leading_letters(spark):
    q = b.qof(spark, [("WAL", "SMOK002", 7, 0), ("WAL", "EPIL001", 3, 0), ("WAL", "XYZ1", 1, 0)])
    out = b.as_dict(register.disease_register(q, register.area_table(spark)), "area", "patients")
    assert out == {"Smoking": 7, "Epilepsy": 3}


def test_national_code_variants(spark):
    q = b.qof(spark, [("WAL", "DM001", 10, 100), ("WALX", "DM001", 20, 100),
                      ("W00001", "DM001", 1, 10)])
    national = rates.national_rate(rates.indicator_rate(q))
    assert [r.practiceid for r in national.collect()] == ["WAL"]
    reg = register.disease_register(q, register.area_table(spark))
    assert sorted(r.practiceid for r in reg.collect()) == ["WAL", "WALX"]


def test_practice_without_insulin_is_absent(spark):
    r = b.rx(spark, [
        ("W00001", "201501", "0601010A0", "Insulin", 10, 1, 1),
        ("W00001", "201501", "0101010A0", "Other", 30, 1, 1),
        ("W00002", "201501", "0101010A0", "Other", 5, 1, 1),
    ])
    share = b.as_dict(drugs.drug_share(r, drugs.is_insulin(), "rate_insulin"), "practiceid",
                      "rate_insulin")
    two = b.as_dict(drugs.drug_share_two_scans(r, drugs.is_insulin(), "rate_insulin"),
                    "practiceid", "rate_insulin")
    assert share == two == {"W00001": 0.25}


def test_bad_period_gives_null_month(spark):
    df = spark.createDataFrame([("2015xx",), (None,), ("201503",)], "period string")
    months = [r[0] for r in df.select(year_month("period")).collect()]
    assert months[0] is None and months[1] is None and str(months[2]) == "2015-03-01"


def test_month_quirk(spark):
    r = b.rx(spark, [
        ("W00001", "201501", "x", "a", 1, 1, 10),
        ("W00001", "201502", "x", "a", 1, 1, 11),
    ])
    row = spend.avg_monthly_spend(r).collect()[0]
    assert row.months == 2
    assert row.avg_monthly_spend == 10.5
    assert row.avg_monthly_spend_compat == 5.0


def test_floor_division_is_floor_not_truncation(spark):
    from gpsight.functions.expr import floor_div
    v = spark.range(1).select(floor_div(F.lit(-7.5), F.lit(2.0)).alias("v")).collect()[0].v
    assert v == -4.0


def test_round_ties_to_even(spark):
    v = spark.range(1).select(round_half_even(F.lit(0.25), 1).alias("v")).collect()[0].v
    assert float(v) == 0.2


@pytest.mark.parametrize("pid,expected", [
    ("W92041", True), ("w92041", False), ("W9204", False), ("W920411", False), (None, None),
])
def test_practice_id_format(spark, pid, expected):
    df = spark.createDataFrame([(pid,)], "practiceid string")
    assert validate.validate_practice_ids(df).collect()[0].is_valid is expected


def _spp_tables(spark):
    r = b.rx(spark, [("W00001", "201501", "x", "a", 1, 100, 1),
                     ("W00002", "201501", "x", "a", 1, 300, 1),
                     ("W00003", "201501", "x", "a", 1, 50, 1)])
    q = b.qof(spark, [("W00001", "DM001", 1, 10), ("W00002", "DM001", 1, 10),
                      ("W00003", "DM001", 1, 10), ("WAL", "DM001", 3, 30)])
    a = b.address(spark, [("W00001", "a", "L1 2AB"), ("W00002", "b", "L2 3CD"),
                          ("W00003", "c", "L1 9ZZ"), ("W99999", "d", "NA1 1AA")])
    return r, q, a


def test_one_letter_postcode_areas_stay_apart(spark):
    spp = spend.spend_per_patient(*_spp_tables(spark))
    peers = spend.area_peers(spp, "W00001")
    got = {r.practiceid: r.is_chosen for r in peers.collect()}
    assert got == {"W00001": True, "W00003": False}
    stats = {r.practiceid: (r.area, r.area_practices, r.area_mean)
             for r in spend.area_peer_stats(spp).collect()}
    assert stats["W00002"] == ("L2", 1, 30.0)
    assert stats["W00001"] == ("L1", 2, 7.5)


def test_unknown_practice(spark):
    r, q, a = _spp_tables(spark)
    spp = spend.spend_per_patient(r, q, a)
    assert spend.area_peers(spp, "W99999").count() == 0
    flags = {row.practiceid: (row.has_med, row.has_qof)
             for row in validate.data_availability(r, q, a).collect()}
    assert flags["W99999"] == (False, False)
    assert flags["WAL"] == (False, True)


def test_spend_per_patient_drops_national_row(spark):
    spp = spend.spend_per_patient(*_spp_tables(spark))
    got = b.as_dict(spp, "practiceid", "spend_per_patient")
    assert got == {"W00001": 10.0, "W00002": 30.0, "W00003": 5.0}


def test_monthly_cost_per_patient_floors(spark):
    r = b.rx(spark, [("W00001", "201501", "x", "a", 1, 1, 25)])
    q = b.qof(spark, [("W00001", "DM001", 1, 10)])
    row = spend.monthly_cost_per_patient(r, q).collect()[0]
    assert row.avg_cost == 2.0


def test_practices_with_both(spark):
    r, q, a = _spp_tables(spark)
    r = r.unionByName(b.rx(spark, [("W00077", "201501", "x", "a", 1, 1, 1)]))
    one = {x.practiceid for x in validate.practices_with_both(r, q).collect()}
    semi = {x.practiceid for x in validate.practices_with_both_semi(r, q, a).collect()}
    assert one == semi == {"W00001", "W00002", "W00003"}
    counts = {x.practiceid: (x.med_rows, x.qof_rows)
              for x in validate.practice_row_counts(r, q, a).collect()}
    assert counts["W00077"] == (1, 0) and counts["WAL"] == (0, 1) and counts["W99999"] == (0, 0)


def test_sql_parameters_stay_values(spark):
    from gpsight.sources import sql
    from gpsight.sources.tables import PracticeTables
    from gpsight.operators.register import area_table
    q = b.qof(spark, [("W00001", "DM001", 1, 10), ("x' or '1'='1", "DM001", 2, 20)])
    t = PracticeTables(rx=b.rx(spark, []), qof=q, address=b.address(spark, []),
                       area=area_table(spark))
    hostile = sql.run_sql(spark, t, sql.PRACTICE_QOF, practiceid="x' or '1'='1; drop table t")
    assert hostile.count() == 0
    exact = sql.run_sql(spark, t, sql.PRACTICE_QOF, practiceid="x' or '1'='1")
    assert [r.numerator for r in exact.collect()] == [2]


def test_short_postcode_area_is_a_prefix(spark):
    r = b.rx(spark, [(p, "201501", "x", "a", 1, 10, 1) for p in ("W00001", "W00002", "W00003")])
    q = b.qof(spark, [(p, "DM001", 1, 10) for p in ("W00001", "W00002", "W00003")])
    a = b.address(spark, [("W00001", "a", "L"), ("W00002", "b", "L2 3CD"), ("W00003", "c", "M1 1AA")])
    peers = spend.area_peers(spend.spend_per_patient(r, q, a), "W00001")
    assert sorted(x.practiceid for x in peers.collect()) == ["W00001", "W00002"]


def test_check_practices_for_requested_ids(spark):
    r, q, _ = _spp_tables(spark)
    ids = spark.createDataFrame([("W00001",), ("W12345",), ("WAL",), ("bad",)], "practiceid string")
    got = {x.practiceid: (x.is_valid, x.has_med, x.has_qof, x.has_both)
           for x in validate.check_practices(ids, r, q).collect()}
    assert got == {"W00001": (True, True, True, True), "W12345": (True, False, False, False),
                   "WAL": (False, False, True, False), "bad": (False, False, False, False)}


def test_single_practice_rate_without_dm_rows_is_zero(spark):
    # ungrouped: sum over no matching rows is 0; grouped per-practice table: NULL
    q = b.qof(spark, [("W00001", "AF001", 5, 100)])
    assert rates.rate_percent(q).collect()[0].rate_pct == 0.0
    assert b.as_dict(rates.indicator_rate(q), "practiceid", "rate_diabetes") == {"W00001": None}
    assert rates.rate_percent(b.qof(spark, [])).collect()[0].rate_pct is None
