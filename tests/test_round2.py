"""Ids beyond five digits, several addresses, missing addresses, the scratch folder, precision."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from gpsight.functions.stats import pearson_test_from_moments
from gpsight.operators.profile import practice_profile, practice_report
from gpsight.session import checkpoint_dir, materialize, remove_written
from gpsight.sources.fixtures import padded, practice_code


def test_long_keys_are_not_cut(spark):
    keys = spark.createDataFrame([(7,), (10000,), (100000,), (1234567,)], "k long")
    rows = keys.select(practice_code(F.col("k")), padded(F.col("k"), 3)).collect()
    assert [tuple(r) for r in rows] == [("W00007", "007"), ("W10000", "10000"), ("W100000", "100000"),
                                        ("W1234567", "1234567")]


@pytest.fixture()
def small(spark):
    rx = spark.createDataFrame([("W00001", "201501", "06", "x", 1.0, 2.0, 3.0), ("W00002", "201501", "06", "x", 1.0, 4.0, 5.0)],
                               "practiceid string, period string, bnfcode string, bnfname string, quantity double, nic double, actcost double")
    qof = spark.createDataFrame([("W00001", "DM001", 5, 100), ("W00002", "DM001", 7, 50)],
                                "orgcode string, indicator string, numerator long, field4 long")
    address = spark.createDataFrame([("W00001", "a", "CF2 1AA"), ("W00001", "b", "CF1 1AA")],
                                    "practiceid string, name string, postcode string")
    return rx, qof, address


def test_profile_has_one_row_per_practice(small):
    rows = {r["practiceid"]: r for r in practice_profile(*small).collect()}
    assert len(rows) == 2 and practice_profile(*small).count() == 2
    assert rows["W00001"]["postcode"] == "CF1 1AA" and rows["W00001"]["area_practices"] == 1
    assert rows["W00002"]["postcode"] is None


def test_report_without_address_or_national_rate(small):
    said = {r["practiceid"]: r["summary"] for r in practice_report(practice_profile(*small)).collect()}
    assert "null" not in said["W00002"] and "nu " not in said["W00002"] and "area" not in said["W00002"]
    assert "in postcode area CF" in said["W00001"] and "unknown" in said["W00001"]


def test_scratch_folder_is_stable_and_can_be_cleared(spark):
    assert checkpoint_dir(spark) == checkpoint_dir(spark)
    df = materialize(spark.range(3).toDF("x"), "to-clear")
    assert df.count() == 3
    assert remove_written(spark, "to-clear") >= 1
    assert remove_written(spark, "to-clear") == 0


def test_small_p_keeps_its_digits(spark):
    # r = 0.8, df = 98: t = 13.2, p far below 1e-10
    m = spark.createDataFrame([(100, 1.0, 1.0, 0.8)], "n long, sxx double, syy double, sxy double")
    p = pearson_test_from_moments(m, "n", "sxx", "syy", "sxy").first()["p_value"]
    assert 0 < p < 1e-20


def test_one_practice_profile_equals_the_row_of_the_whole_profile(spark, tables01, small):
    from gpsight.operators.profile import one_practice_profile
    for t, ids in (((tables01.rx, tables01.qof, tables01.address), ("W00004", "W99999")),
                   (small, [r["practiceid"] for r in small[0].select("practiceid").distinct().collect()])):
        whole = practice_profile(*t).collect()
        for practice in ids:
            if practice is None:
                continue
            want = [r for r in whole if r["practiceid"] == practice]
            got = one_practice_profile(*t, practice).collect()
            assert [[x if not isinstance(x, float) else round(x, 9) for x in r] for r in got] == \
                [[x if not isinstance(x, float) else round(x, 9) for x in r] for r in want]


def test_one_practice_reports_push_the_practice_to_the_scans(tables01):
    from gpsight.operators.profile import one_practice_profile
    from gpsight.operators.spend import area_peers_of
    t = (tables01.rx, tables01.qof, tables01.address)
    for df in (one_practice_profile(*t, "W00004"), area_peers_of(*t, "W00004")):
        plan = df.sparkSession.sparkContext._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        assert "EqualTo(practiceid,W00004)" in plan and "EqualTo(orgcode,W00004)" in plan
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_area_peers_from_tables_equal_the_filtered_whole(tables01):
    from gpsight.operators.spend import area_peers, area_peers_of, spend_per_patient
    t = (tables01.rx, tables01.qof, tables01.address)
    whole = area_peers(spend_per_patient(*t), "W00004")
    assert sorted(area_peers_of(*t, "W00004").collect()) == sorted(whole.collect())


def test_month_spellings(spark):
    from gpsight.functions.expr import year_month
    seen = spark.createDataFrame([(x,) for x in ("201501", "2015-01", "2015/1", " 201501 ", "2015.12")], "p string")
    assert [str(r[0])[:7] for r in seen.select(year_month("p")).collect()] == ["2015-01"] * 4 + ["2015-12"]
    bad = spark.createDataFrame([(x,) for x in ("20151", "2015-13", "abc", "", None, "2015-001")], "p string")
    assert [r[0] for r in bad.select(year_month("p")).collect()] == [None] * 6


def test_missing_values_propagate_where_asked(spark):
    import builders as b
    from gpsight.operators import correlate, drugs, rates, register, spend
    r = b.rx(spark, [("W00001", "201501", "0601011", "Insulin", 1, 1, 1), ("W00001", "201501", "x", "y", None, 1, None),
                     ("W00002", "201501", "0601011", "Insulin", 2, 1, 1), ("W00002", "201502", "x", "y", 2, 1, 3)])
    q = b.qof(spark, [("W00001", "DM001", 5, 10), ("W00001", "DM002", None, 10), ("W00002", "DM001", 5, 10),
                      ("WAL", "DM001", None, 9), ("WAL", "DM002", 4, 9)])
    cost = {(x["practiceid"], str(x["month"])): x["total_cost_meds"] for x in spend.monthly_cost(r, na="propagate").collect()}
    assert cost[("W00001", "2015-01-01")] is None and cost[("W00002", "2015-02-01")] == 3
    spent = b.as_dict(spend.avg_monthly_spend(r, na="propagate"), "practiceid", "avg_monthly_spend")
    assert spent == {"W00001": None, "W00002": 2.0}
    share = b.as_dict(drugs.drug_share(r, drugs.is_insulin(), "s", na="propagate"), "practiceid", "s")
    assert share == {"W00001": None, "W00002": 0.5}
    pairs = {x["practiceid"]: (x["rate_diabetes"], x["rate_insulin"])
             for x in correlate.diabetes_insulin_pairs(r, q, na="propagate").collect()}
    assert pairs == {"W00001": (None, None), "W00002": (0.5, 0.5)}
    assert rates.rate_percent(q.filter("orgcode = 'W00001'"), na="propagate").first()[0] is None
    assert rates.rate_percent(q.filter("orgcode = 'W00001'")).first()[0] == 50.0
    found = register.disease_register(q, register.area_table(spark), na="propagate").collect()
    assert [x["patients"] for x in found] == [None]
    whole = {x["practiceid"]: x for x in practice_profile(r, q, b.address(spark, [("W00002", "n", "AB1")]), na="propagate").collect()}
    assert whole["W00001"]["avg_monthly_spend"] is None and whole["W00001"]["rate_pct"] is None
    assert whole["W00002"]["rate_pct"] == 50.0


def test_sql_text_leaves_the_session_views_alone(spark, tables01):
    from gpsight.sources.sql import run_sql
    spark.range(3).createOrReplaceTempView("address")
    try:
        n = run_sql(spark, tables01, "select count(*) n from gp_data_up_to_2015 where practiceid = :p", p="W00004").first()["n"]
        assert n == tables01.rx.filter("practiceid = 'W00004'").count()
        assert run_sql(spark, tables01, "with a as (select practiceid from address) select count(*) n from a").first()["n"] \
            == tables01.address.count()
        assert spark.table("address").count() == 3
    finally:
        spark.catalog.dropTempView("address")


def test_jdbc_needs_slices(spark):
    import pytest
    from gpsight.sources.tables import read_jdbc_tables
    with pytest.raises(ValueError, match="partitionColumn"):
        read_jdbc_tables(spark, "jdbc:none:", {"user": "u"})
