"""List sizes and indicator rates from the quality-indicator table.

``qof`` columns: orgcode, indicator, numerator, field4 (the practice list size, repeated on
every row of the practice). The national row ``WAL`` lives in the same table and is kept in
per-practice results, as in the analysed code.

Note: an indicator rate sums the numerators of *all* indicators with the prefix, so a
patient counted by several indicators counts several times and the rate can exceed 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.functions.expr import (NATIONAL_CODE, max_na, percent, ratio, round_half_even,
                                    starts_with, str_detect, sum_na, sum_where)
from gpsight.operators.keys import join_on


def qof_renamed(qof: DataFrame) -> DataFrame:
    """``rename(practiceid = orgcode, no_of_patients = field4)``."""
    return qof.withColumnsRenamed({"orgcode": "practiceid", "field4": "no_of_patients"})


def practice_qof(qof: DataFrame, practiceid: str) -> DataFrame:
    """QOF rows of one organisation (pushed below the view's aggregations)."""
    return qof.filter(F.col("orgcode") == F.lit(practiceid))


def list_size_by_practice(qof: DataFrame, na: str = "skip") -> DataFrame:
    """(practiceid, total_pop): the list size of every organisation."""
    return (qof.groupBy(F.col("orgcode").alias("practiceid"))
            .agg(max_na("field4", na).alias("total_pop")))


def list_size(qof: DataFrame, na: str = "skip") -> DataFrame:
    """(total): max list size over the given rows — one row, NULL when there are none."""
    return qof.agg(max_na("field4", na).alias("total"))


def indicator_patients(qof: DataFrame, prefix: str = "DM", name: str = "diabetes_patients",
                       na: str = "skip") -> DataFrame:
    """(practiceid, <name>): summed numerators of indicators starting with ``prefix``."""
    return (qof.filter(starts_with("indicator", prefix))
            .groupBy(F.col("orgcode").alias("practiceid"))
            .agg(sum_na("numerator", na).alias(name)))


def indicator_rate(qof: DataFrame, prefix: str = "DM", name: str = "rate_diabetes",
                   na: str = "skip") -> DataFrame:
    """(practiceid, <name>): indicator patients / list size, for every organisation.

    One aggregation replaces the analysed code's full outer join of the prefix sum with the
    list size: both group the same table by the same key and the prefix side's keys are a
    subset, so an organisation without a matching indicator gets a NULL rate either way.
    """
    hit = starts_with("indicator", prefix)
    patients = F.sum(F.when(hit, F.col("numerator")))
    if na == "propagate":
        patients = F.when(F.count_if(hit & F.col("numerator").isNull()) == 0, patients)
    return (qof.groupBy(F.col("orgcode").alias("practiceid"))
            .agg(patients.alias("_patients"), max_na("field4", na).alias("_pop"))
            .select("practiceid", ratio("_patients", "_pop").alias(name)))


def indicator_rows(qof: DataFrame, pattern: str) -> DataFrame:
    """QOF rows whose indicator matches a regex (``filter(str_detect(indicator, pattern))``)."""
    return qof.filter(str_detect("indicator", pattern))


def indicator_rate_full_join(qof: DataFrame, prefix: str = "DM",
                             name: str = "rate_diabetes") -> DataFrame:
    """The same rate as written: prefix sum FULL OUTER JOIN list size, then the ratio."""
    patients = indicator_patients(qof, prefix, "_patients")
    pop = list_size_by_practice(qof)
    return (join_on(patients, pop, "full")
            .select("practiceid", ratio("_patients", "total_pop").alias(name)))


def rate_percent(qof: DataFrame, prefix: str = "DM", digits: int = 1, na: str = "skip") -> DataFrame:
    """(rate_pct): rate over the given rows in percent, rounded half-to-even — one row.

    Filter ``qof`` to one practice first for the analysed code's single-practice figure.
    """
    hit = starts_with("indicator", prefix)
    # An ungrouped sum over no matching rows is 0 in the analysed code (not NA), so a
    # practice without prefix indicators has rate 0; no rows at all leave the list size NULL.
    patients = sum_where(hit, "numerator", na)
    if na == "skip":
        patients = F.coalesce(patients, F.lit(0))
    else:
        patients = F.when(F.count_if(hit) == 0, F.lit(0)).otherwise(patients)
    return (qof.agg(patients.alias("_patients"),
                    max_na("field4", na).alias("_pop"))
            .select(round_half_even(percent(ratio("_patients", "_pop")), digits).alias("rate_pct")))


def national_rate(rates: DataFrame, code: str = NATIONAL_CODE) -> DataFrame:
    """The national row of a rate table (``practiceid == 'WAL'``)."""
    return rates.filter(F.col("practiceid") == F.lit(code))


def compare_rate(rates: DataFrame, practiceid: str, code: str = NATIONAL_CODE) -> DataFrame:
    """The chosen practice's row next to the national row (the comparison chart's data)."""
    return rates.filter(F.col("practiceid").isin(code, practiceid))
