"""The one-pass rewrites equal the forms written in the analysed code (sf0.01 tables)."""

from __future__ import annotations

from pyspark.sql import DataFrame

from gpsight.operators import drugs, rates, register, validate
from gpsight.sources.fixtures import load_fixture_tables


def _same(a: DataFrame, b: DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    b = b.select(*a.columns)
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0
    assert b.exceptAll(a).count() == 0


def test_full_join_equals_one_pass(tables01):
    _same(rates.indicator_rate(tables01.qof, "DM"), rates.indicator_rate_full_join(tables01.qof, "DM"))


def test_full_join_equals_one_pass_for_other_prefixes(tables01):
    for prefix in ("AST", "SMO", "HYP"):
        _same(rates.indicator_rate(tables01.qof, prefix, "rate"),
              rates.indicator_rate_full_join(tables01.qof, prefix, "rate"))


def test_two_scans_equal_one_pass(tables01):
    for pred, name in ((drugs.is_insulin(), "rate_insulin"), (drugs.is_metformin(), "rate_metformin")):
        _same(drugs.drug_share(tables01.rx, pred, name),
              drugs.drug_share_two_scans(tables01.rx, pred, name))


def test_multi_share_equals_single_shares(tables01):
    both = drugs.drug_shares(tables01.rx, {"rate_insulin": drugs.is_insulin(),
                                           "rate_metformin": drugs.is_metformin()})
    single = drugs.drug_share(tables01.rx, drugs.is_insulin(), "rate_insulin")
    _same(both.filter("rate_insulin is not null").select("practiceid", "rate_insulin"), single)


def test_union_equals_prefix_join(tables01):
    _same(register.disease_register(tables01.qof, tables01.area),
          register.disease_register_union(tables01.qof))


def test_register_total_is_sum_of_matching_numerators(tables01):
    from pyspark.sql import functions as F
    prefixes = [p for _, p, _ in register.AREAS]
    cond = None
    for p in prefixes:
        c = F.col("indicator").startswith(p)
        cond = c if cond is None else cond | c
    expected = (register.national_rows(tables01.qof).filter(cond)
                .agg(F.sum("numerator")).collect()[0][0])
    got = register.disease_register(tables01.qof, tables01.area).agg(F.sum("patients")).collect()[0][0]
    assert got == expected


def test_semi_joins_equal_flag_aggregation(tables01):
    _same(validate.practices_with_both(tables01.rx, tables01.qof),
          validate.practices_with_both_semi(tables01.rx, tables01.qof, tables01.address))


def test_stored_tables_equal_views(spark, tables01):
    from conftest import SF01
    views = load_fixture_tables(spark, SF01)
    _same(tables01.qof, views.qof)
    _same(tables01.address, views.address)
    _same(tables01.rx.groupBy("practiceid", "period").count(),
          views.rx.groupBy("practiceid", "period").count())


def test_drug_share_bounds(tables01):
    from pyspark.sql import functions as F
    share = drugs.drug_share(tables01.rx, drugs.is_metformin(), "s")
    lo, hi = share.agg(F.min("s"), F.max("s")).collect()[0]
    assert 0.0 <= lo <= hi <= 1.0


def test_profile_row_equals_single_practice_operators(tables01):
    from pyspark.sql import functions as F

    from gpsight.operators import profile, spend

    pid = "W00004"
    row = (profile.practice_profile(tables01.rx, tables01.qof, tables01.address)
           .filter(F.col("practiceid") == pid).collect())
    assert len(row) == 1
    row = row[0]
    one_qof = rates.practice_qof(tables01.qof, pid)
    assert row.no_of_patients == rates.list_size(one_qof).collect()[0].total
    assert row.rate_pct == rates.rate_percent(one_qof).collect()[0].rate_pct
    national = rates.rate_percent(rates.practice_qof(tables01.qof, "WAL")).collect()[0].rate_pct
    assert row.national_rate_pct == national
    spendrow = (spend.avg_monthly_spend(spend.practice_prescriptions(tables01.rx, pid))
                .collect()[0])
    assert (row.months, row.avg_monthly_spend, row.avg_monthly_spend_compat) == (
        spendrow.months, spendrow.avg_monthly_spend, spendrow.avg_monthly_spend_compat)
    spp = spend.spend_per_patient(tables01.rx, tables01.qof, tables01.address)
    peers = spend.area_peers(spp, pid).collect()
    mine = [p for p in peers if p.is_chosen][0]
    assert row.spend_per_patient == mine.spend_per_patient
    assert row.area_practices == len(peers)
