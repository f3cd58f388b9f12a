"""Medication spend: monthly cost, average monthly spend, spend per patient, area peers.

Money columns (``nic``, ``actcost``) are decimals. They are summed as decimals — exact and
independent of summation order — and turned into doubles once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.functions.exact import exact_mean
from gpsight.functions.expr import (floor_div, max_na, max_where, month_start, postcode_area,
                                    ratio, round_half_even, sum_na, year_month)
from gpsight.operators.cogroup import (KEY_COLUMNS, QOF, group_by_practice_key, join_address,
                                       key_columns, on_both_sides, practice_from_key,
                                       side_counts, stacked)


def practice_prescriptions(rx: DataFrame, practiceid: str) -> DataFrame:
    """One practice's prescriptions; the equality reaches the Parquet scan."""
    return rx.filter(F.col("practiceid") == F.lit(practiceid))


def practice_address(address: DataFrame, practiceid: str) -> DataFrame:
    return address.filter(F.col("practiceid") == F.lit(practiceid))


def total_cost_by_practice(rx: DataFrame) -> DataFrame:
    """(practiceid, total_costs): ``select practiceid, sum(nic) ... group by practiceid``."""
    return (rx.groupBy("practiceid")
            .agg(F.sum("nic").cast("double").alias("total_costs")))


def _monthly_decimal(rx: DataFrame, na: str = "skip") -> DataFrame:
    return (rx.select("practiceid", month_start(year_month("period")).alias("month"), "actcost")
            .groupBy("practiceid", "month")
            .agg(sum_na("actcost", na).alias("total_cost_meds")))


def monthly_cost(rx: DataFrame, na: str = "skip") -> DataFrame:
    """(practiceid, month, total_cost_meds): actual cost per practice and calendar month.

    Unparsable periods give a NULL month, which forms its own group (as NA does in R).
    """
    return _monthly_decimal(rx, na).withColumn("total_cost_meds",
                                           F.col("total_cost_meds").cast("double"))


def _monthly_totals(rx: DataFrame, na: str = "skip") -> DataFrame:
    """(practiceid, months, total): month count and exact decimal total per practice."""
    return (_monthly_decimal(rx, na).groupBy("practiceid")
            .agg(F.count(F.lit(1)).alias("months"),
                 sum_na("total_cost_meds", na).alias("total")))


def avg_monthly_spend(rx: DataFrame, na: str = "skip") -> DataFrame:
    """(practiceid, months, avg_monthly_spend, avg_monthly_spend_compat) for every practice.

    ``avg_monthly_spend`` is total / months, the stated intent. The analysed code divides by
    the month count twice — ``(total %/% months) / months``, rounded half-to-even to one
    decimal — and that figure is kept as ``avg_monthly_spend_compat``.
    """
    totals = _monthly_totals(rx, na).withColumn("total", F.col("total").cast("double"))
    return totals.select(
        "practiceid",
        "months",
        ratio("total", "months").alias("avg_monthly_spend"),
        round_half_even(ratio(floor_div("total", "months"), "months"), 1)
        .alias("avg_monthly_spend_compat"),
    )


def monthly_cost_per_patient(rx: DataFrame, qof: DataFrame, na: str = "skip") -> DataFrame:
    """(practiceid, month, total_cost_meds, avg_cost): monthly cost and monthly cost %/% list
    size, for every practice. ``na``: the original computes both in R."""
    # Both sides grouped on the two-column null-safe key, so the join matches a missing id
    # with a missing id (as dplyr does) and reuses the list-size side's partitioning.
    monthly = (rx.select(*key_columns(), month_start(year_month("period")).alias("month"), "actcost")
               .groupBy(*KEY_COLUMNS, "month")
               .agg(sum_na("actcost", na).cast("double").alias("total_cost_meds")))
    pop = qof.groupBy(*key_columns("orgcode")).agg(max_na("field4", na).alias("total_pop"))
    return (monthly.join(pop, list(KEY_COLUMNS))
            .select(practice_from_key(), "month", "total_cost_meds",
                    floor_div("total_cost_meds", "total_pop").alias("avg_cost")))


def spend_per_patient(rx: DataFrame, qof: DataFrame, address: DataFrame, na: str = "skip") -> DataFrame:
    """(practiceid, postcode, total_costs, total_pop, spend_per_patient).

    Costs and list sizes come from one co-grouped aggregation of both tables (practices on
    both sides only, as the inner join); the address join then drops ``WAL``. Its strategy
    is left to AQE: the per-practice table grows with the number of practices, so no
    broadcast is forced. ``na`` is the policy of the list size, which the original takes in R;
    the cost comes from its SQL and skips missing amounts.
    """
    rows = stacked(rx, {"_nic": F.col("nic")}, qof, {"_size": F.col("field4")})
    per_practice = on_both_sides(
        group_by_practice_key(rows).agg(F.sum("_nic").cast("double").alias("total_costs"),
                                        max_where(F.col("_source") == QOF, "_size", na).alias("total_pop"),
                                        *side_counts()))
    return (join_address(per_practice, address)
            .select("practiceid", "postcode", "total_costs", "total_pop",
                    ratio("total_costs", "total_pop").alias("spend_per_patient")))


def rows_of(rows: DataFrame, practices: DataFrame, key: str = "practiceid") -> DataFrame:
    """The rows whose practice is in ``practices`` (a missing id matches a missing id)."""
    wanted = practices.select(F.col("practiceid").alias("_wanted"))
    return rows.join(wanted, F.col(key).eqNullSafe(F.col("_wanted")), "left_semi")


def area_peers_of(rx: DataFrame, qof: DataFrame, address: DataFrame, practiceid: str,
                  width: int = 2, na: str = "skip") -> DataFrame:
    """:func:`area_peers` from the tables themselves, aggregating the chosen area only.

    The chosen practice's area comes from that practice's rows (the equality reaches the
    scans); the facts are cut to the area's practices before they are aggregated.
    """
    own = spend_per_patient(rx.filter(F.col("practiceid") == F.lit(practiceid)),
                            qof.filter(F.col("orgcode") == F.lit(practiceid)),
                            address.filter(F.col("practiceid") == F.lit(practiceid)))
    chosen = own.agg(F.min(postcode_area("postcode", width))).scalar()
    there = address.filter(F.col("postcode").startswith(chosen))
    spp = spend_per_patient(rows_of(rx, there), rows_of(qof, there, "orgcode"), there, na)
    return spp.withColumn("is_chosen", F.col("practiceid") == F.lit(practiceid))


def area_peers(spp: DataFrame, practiceid: str, width: int = 2) -> DataFrame:
    """Rows of ``spp`` in the chosen practice's postcode area, with an ``is_chosen`` flag.

    The chosen area is a scalar subquery (``min`` makes the pick deterministic when the
    practice has several rows) compared in a filter. An unknown practice gives NULL and so no
    rows (the analysed code would match postcodes starting with "NA" instead).
    """
    chosen = (spp.filter(F.col("practiceid") == F.lit(practiceid))
              .agg(F.min(postcode_area("postcode", width))).scalar())
    # ``str_detect(postcode, '^<area>')``: a prefix test (equal to comparing the first two
    # characters unless the chosen postcode is shorter than that).
    return (spp.filter(F.col("postcode").startswith(chosen))
            .withColumn("is_chosen", F.col("practiceid") == F.lit(practiceid)))


def area_peer_stats(spp: DataFrame, width: int = 2) -> DataFrame:
    """(practiceid, area, spend_per_patient, area_practices, area_mean) for every practice.

    The per-area aggregate is joined back on the area key; it has one row per postcode
    area, so it is broadcast, and a populous area never concentrates in one task.
    ``area_mean`` is added up exactly: the same bits for every order of the rows.
    """
    keyed = spp.select("practiceid", postcode_area("postcode", width).alias("area"),
                       "spend_per_patient")
    stats = (keyed.groupBy(F.col("area").alias("_area"))
             .agg(F.count(F.lit(1)).alias("area_practices"),
                  exact_mean("spend_per_patient").alias("area_mean")))
    # Null-safe key: practices without a postcode form one group, as NA does in group_by.
    # At most as many areas as prefixes of two characters; longer prefixes are left to AQE.
    stats = F.broadcast(stats) if width <= 2 else stats
    return (keyed.join(stats, keyed["area"].eqNullSafe(F.col("_area")))
            .select("practiceid", "area", "spend_per_patient", "area_practices", "area_mean"))
