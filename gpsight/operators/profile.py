"""Practice profile: the per-practice report of the analysed code, for every practice.

The analysed code builds one practice's profile with eleven separate database round trips
and four full reads of the QOF table. Here it is one plan:

* prescriptions are aggregated per (practice, month); those monthly rows and the QOF rows
  are stacked and grouped once by practice (``cogroup``), giving the month count, the
  actual-cost and net-ingredient-cost totals, the list size and the diabetes numerators
  together — practices with both kinds of data only, as the inner join of the original;
* the national rate is a scalar subquery over the QOF table (one value, run once; the
  ``orgcode = 'WAL'`` filter reaches the scan);
* the address is joined on. This per-practice table feeds two consumers (the postcode-area
  means and the rows they are joined back to).

The function is lazy: no job runs at call time. Both consumers read the same columns of the same
grouped exchange (see ``_reads_all``), so Spark runs it once: one scan of the prescriptions and one of
the whole QOF table. The national rate reads the ``WAL`` rows of the QOF table besides. With
``materialize=True`` the per-practice table is written to the shared checkpoint folder instead
(``session.remove_written`` deletes it later), for callers that go on to use it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gpsight.functions.exact import exact_mean
from gpsight.functions.expr import (NATIONAL_CODE, floor_div, max_where, month_start, percent,
                                    postcode_area, ratio, round_half_even, starts_with,
                                    sum_na, sum_where, year_month)
from gpsight.operators.cogroup import (QOF, RX, group_by_practice_key, join_address, on_both_sides,
                                       side_counts, stacked)
from gpsight.operators.spend import rows_of
from gpsight.session import materialize as write_once


def _monthly(rx: DataFrame, na: str) -> DataFrame:
    return (rx.select("practiceid", month_start(year_month("period")).alias("month"),
                      "actcost", "nic")
            .groupBy("practiceid", "month")
            .agg(sum_na("actcost", na).alias("_cost"), F.sum("nic").alias("_nic")))


def _qof_by_practice(qof: DataFrame, prefix: str) -> DataFrame:
    # The profile's rate is the single-practice figure: an ungrouped sum, 0 without matches.
    return (qof.groupBy(F.col("orgcode").alias("practiceid"))
            .agg(F.max("field4").alias("no_of_patients"),
                 F.coalesce(F.sum(F.when(starts_with("indicator", prefix), F.col("numerator"))),
                            F.lit(0)).alias("_dm")))


def practice_base(rx: DataFrame, qof: DataFrame, address: DataFrame, prefix: str = "DM",
                  width: int = 2, na: str = "skip") -> DataFrame:
    """One row per practice with both kinds of data: the per-practice part of the profile.

    ``na`` holds for the figures that the original adds up in R (monthly cost, list size,
    numerators); the net ingredient cost comes from its SQL and skips missing amounts.
    """
    # monthly prescription rows and QOF rows, grouped once by practice (= inner join of the
    # per-practice prescription figures and the per-practice QOF figures)
    rows = stacked(_monthly(rx, na), {"_cost": F.col("_cost"), "_nic": F.col("_nic")},
                   qof, {"_size": F.col("field4"), "_dmn": F.col("numerator"),
                         "_ind": starts_with("indicator", prefix)})
    of_rx, of_qof = F.col("_source") == RX, F.col("_source") == QOF
    patients = sum_where(F.col("_ind"), "_dmn", na)
    # a sum over no matching rows is 0
    patients = (F.coalesce(patients, F.lit(0)) if na == "skip"
                else F.when(F.count_if("_ind") == 0, F.lit(0)).otherwise(patients))
    per_practice = on_both_sides(group_by_practice_key(rows).agg(
        F.count_if(of_rx).alias("months"),
        sum_where(of_rx, "_cost", na).cast("double").alias("_total_cost"),
        F.sum(F.when(of_rx, F.col("_nic"))).cast("double").alias("total_costs"),
        max_where(of_qof, "_size", na).alias("no_of_patients"),
        patients.alias("_dm"),
        *side_counts()))
    rate = round_half_even(percent(ratio("_dm", "no_of_patients")), 1)
    # a practice can have several addresses: the smallest postcode is the deterministic pick
    one = address.groupBy("practiceid").agg(F.min("postcode").alias("postcode"))
    return (join_address(per_practice, one, "left")
            .select("practiceid", "no_of_patients", "months",
                    ratio("_total_cost", "months").alias("avg_monthly_spend"),
                    round_half_even(ratio(floor_div("_total_cost", "months"), "months"), 1)
                    .alias("avg_monthly_spend_compat"),
                    "postcode", "total_costs",
                    ratio("total_costs", "no_of_patients").alias("spend_per_patient"),
                    rate.alias("rate_pct"),
                    postcode_area("postcode", width).alias("_area")))


def practice_profile(rx: DataFrame, qof: DataFrame, address: DataFrame, prefix: str = "DM",
                     national_code: str = NATIONAL_CODE, width: int = 2,
                     materialize: bool = False, na: str = "skip") -> DataFrame:
    """One row per practice with prescriptions and QOF rows.

    Columns: practiceid, no_of_patients, months, avg_monthly_spend, avg_monthly_spend_compat,
    postcode, total_costs, spend_per_patient, area_practices, area_mean, rate_pct,
    national_rate_pct.
    """
    base = practice_base(rx, qof, address, prefix, width, na)
    if materialize:
        base = write_once(base, "practice-profile")
    return _with_comparisons(base, base, qof, prefix, national_code, width)


def one_practice_profile(rx: DataFrame, qof: DataFrame, address: DataFrame, practiceid: str,
                         prefix: str = "DM", national_code: str = NATIONAL_CODE,
                         width: int = 2) -> DataFrame:
    """The row of :func:`practice_profile` of one practice, without the country's other areas.

    The practice's own figures come from its rows (the equality reaches the scans); the area
    figures from the rows of the area's practices, cut before they are aggregated.
    """
    own = practice_base(rx.filter(F.col("practiceid") == F.lit(practiceid)),
                        qof.filter(F.col("orgcode") == F.lit(practiceid)),
                        address.filter(F.col("practiceid") == F.lit(practiceid)), prefix, width)
    chosen = (address.filter(F.col("practiceid") == F.lit(practiceid))
              .agg(postcode_area(F.min("postcode"), width)).scalar())
    there = (address.groupBy("practiceid").agg(F.min("postcode").alias("postcode"))
             .filter(postcode_area("postcode", width) == chosen))
    peers = practice_base(rows_of(rx, there), rows_of(qof, there, "orgcode"), there, prefix, width)
    return _with_comparisons(own, peers, qof, prefix, national_code, width)


def _with_comparisons(base: DataFrame, peers: DataFrame, qof: DataFrame, prefix: str,
                      national_code: str, width: int) -> DataFrame:
    """``base`` next to the figures of its practices' areas (over ``peers``) and the nation's."""
    national_qof = _qof_by_practice(qof, prefix).filter(F.col("practiceid") == F.lit(national_code))
    national = national_qof.agg(
        F.max(round_half_even(percent(ratio("_dm", "no_of_patients")), 1))).scalar()

    areas = (peers.filter(F.col("postcode").isNotNull()).filter(_reads_all(peers))
             .groupBy("_area")
             .agg(F.count(F.lit(1)).alias("area_practices"),
                  exact_mean("spend_per_patient").alias("area_mean")))
    # at most as many areas as prefixes of two characters; longer prefixes are left to AQE
    areas = F.broadcast(areas) if width <= 2 else areas

    return (base.join(areas, "_area", "left")
            .withColumn("national_rate_pct", national)
            .select("practiceid", "no_of_patients", "months", "avg_monthly_spend",
                    "avg_monthly_spend_compat", "postcode", "total_costs", "spend_per_patient",
                    "area_practices", "area_mean", "rate_pct", "national_rate_pct"))


def _reads_all(df: DataFrame) -> Column:
    """True for every row, but it reads all columns.

    The areas need few columns of the per-practice table. With this they read the same ones as the
    practices do, so both have the same plan up to the grouped exchange and Spark runs it once;
    pruned, they would be two plans and two scans of the facts.
    """
    return F.hash(*df.columns) >= F.lit(-2 ** 31)


def practice_report(profile: DataFrame) -> DataFrame:
    """(practiceid, summary): the profile as one sentence per practice.

    A missing figure reads ``unknown``; without an address the area clause is left out.
    """
    def shown(column: str, digits: int) -> Column:
        return F.coalesce(F.round(column, 6).cast(f"decimal(18,{digits})").cast("string"), F.lit("unknown"))

    def said(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit("unknown"))

    area = F.when(F.col("area_mean").isNull(), "").otherwise(F.concat(
        F.lit(" against a mean of "), shown("area_mean", 2), F.lit(" over "), F.col("area_practices").cast("string"),
        F.lit(" practices in postcode area "), F.substring("postcode", 1, 2)))
    summary = F.concat(
        said("practiceid"), F.lit(" has "), said("no_of_patients"),
        F.lit(" patients. Average medication spend per month: "), shown("avg_monthly_spend", 2),
        F.lit(" (as computed by the original script: "), shown("avg_monthly_spend_compat", 1),
        F.lit("). Spend per patient: "), shown("spend_per_patient", 2), area, F.lit(". Diabetes rate: "),
        shown("rate_pct", 1), F.lit("% (national: "), shown("national_rate_pct", 1), F.lit("%)."))
    return profile.select("practiceid", summary.alias("summary"))
