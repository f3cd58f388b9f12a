"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Each query reads the practice tables derived from the test tables in ``sf_dir`` — built by
Spark from them on first use and stored (``gpsight.sources.store``) — and applies one
operator to all of their rows. Single-practice
queries use ``CHOSEN_PRACTICE``: the analysed code's operators take one practice id, and
the filter on it is the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from gpsight.functions.expr import NATIONAL_CODE
from gpsight.operators import correlate, drugs, profile, rates, register, spend, validate
from gpsight.sources import sql
from gpsight.sources.store import practice_tables
from gpsight.sources.tables import PracticeTables

# Fixed value: the practice used for the single-practice queries (present at every scale).
CHOSEN_PRACTICE = "W00004"

QueryFn = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, QueryFn] = {}
_ON_TABLES: dict[str, Callable[[PracticeTables], DataFrame]] = {}


def query(name: str):
    def wrap(fn: Callable[[PracticeTables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(practice_tables(spark, sf_dir))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        _ON_TABLES[name] = fn
        return fn
    return wrap


def registry() -> dict[str, QueryFn]:
    return dict(_REGISTRY)


def on_tables(name: str) -> Callable[[PracticeTables], DataFrame]:
    """The operator behind a registered query, applied to any PracticeTables."""
    return _ON_TABLES[name]


# --- scans, projections, catalog -----------------------------------------------------------

@query("scan_qof")
def scan_qof(t: PracticeTables) -> DataFrame:
    """The whole QOF table."""
    return t.qof.select("orgcode", "indicator", "numerator", "field4")


@query("scan_address")
def scan_address(t: PracticeTables) -> DataFrame:
    """``select practiceid, postcode from address``."""
    return t.address.select("practiceid", "postcode")


def _practice_sql(text: str) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return sql.run_sql(spark, practice_tables(spark, sf_dir), text, practiceid=CHOSEN_PRACTICE)
    return run


# One practice's rows, as parameterised SQL text.
for _name, _text in (("practice_prescriptions", sql.PRACTICE_PRESCRIPTIONS),
                     ("practice_qof", sql.PRACTICE_QOF),
                     ("practice_address", sql.PRACTICE_ADDRESS)):
    _REGISTRY[_name] = _practice_sql(_text)
    _ON_TABLES[_name] = (lambda text: lambda t: sql.run_sql(
        t.rx.sparkSession, t, text, practiceid=CHOSEN_PRACTICE))(_text)


@query("qof_renamed")
def qof_renamed(t: PracticeTables) -> DataFrame:
    """QOF with practiceid / no_of_patients names."""
    return rates.qof_renamed(t.qof)


# S8/S9 (list_tables, describe_table) are catalog reads: they touch no rows, so their work
# does not grow with the tables. They live in gpsight.sources.catalog (tested there) and are
# not registered as queries.


# --- validation and availability -----------------------------------------------------------

@query("valid_practice_ids")
def valid_practice_ids(t: PracticeTables) -> DataFrame:
    """Every id in the three tables, checked against ``^W[0-9]{5}$``."""
    return validate.validate_practice_ids(validate.known_practice_ids(t.rx, t.qof, t.address))


@query("check_practices")
def check_practices(t: PracticeTables) -> DataFrame:
    """The gate of the main flow (id format, both kinds of data) for every known id."""
    return validate.check_practices(validate.known_practice_ids(t.rx, t.qof, t.address), t.rx, t.qof)


@query("data_availability")
def data_availability(t: PracticeTables) -> DataFrame:
    """has_med / has_qof for every known id."""
    return validate.data_availability(t.rx, t.qof, t.address)


@query("practices_with_both")
def practices_with_both(t: PracticeTables) -> DataFrame:
    """Practices with both kinds of data."""
    return validate.practices_with_both(t.rx, t.qof)


@query("practice_row_counts")
def practice_row_counts(t: PracticeTables) -> DataFrame:
    """Prescription and QOF row counts per known id."""
    return validate.practice_row_counts(t.rx, t.qof, t.address)


# --- list sizes and rates ------------------------------------------------------------------

@query("list_size_one")
def list_size_one(t: PracticeTables) -> DataFrame:
    """A1/C4: patients at the chosen practice."""
    return rates.list_size(rates.practice_qof(t.qof, CHOSEN_PRACTICE))


@query("list_size_by_practice")
def list_size_by_practice(t: PracticeTables) -> DataFrame:
    """A2: list size per organisation."""
    return rates.list_size_by_practice(t.qof)


@query("diabetes_patients")
def diabetes_patients(t: PracticeTables) -> DataFrame:
    """Diabetes numerators per organisation."""
    return rates.indicator_patients(t.qof, "DM", "diabetes_patients")


@query("diabetes_rate_one")
def diabetes_rate_one(t: PracticeTables) -> DataFrame:
    """The chosen practice's diabetes rate in percent, one decimal."""
    return rates.rate_percent(rates.practice_qof(t.qof, CHOSEN_PRACTICE), "DM")


@query("diabetes_rate_by_practice")
def diabetes_rate_by_practice(t: PracticeTables) -> DataFrame:
    """Diabetes rate of every organisation, one pass."""
    return rates.indicator_rate(t.qof, "DM", "rate_diabetes")


@query("diabetes_rate_full_join")
def diabetes_rate_full_join(t: PracticeTables) -> DataFrame:
    """The same rate as written (full outer join)."""
    return rates.indicator_rate_full_join(t.qof, "DM", "rate_diabetes")


@query("national_rate")
def national_rate(t: PracticeTables) -> DataFrame:
    """the national diabetes rate row."""
    return rates.national_rate(rates.indicator_rate(t.qof, "DM", "rate_diabetes"))


@query("rate_vs_national")
def rate_vs_national(t: PracticeTables) -> DataFrame:
    """Chosen practice and national rows."""
    return rates.compare_rate(rates.indicator_rate(t.qof, "DM", "rate_diabetes"), CHOSEN_PRACTICE)


# --- spend ---------------------------------------------------------------------------------

@query("total_cost_by_practice")
def total_cost_by_practice(t: PracticeTables) -> DataFrame:
    """Net ingredient cost per practice."""
    return spend.total_cost_by_practice(t.rx)


@query("monthly_cost")
def monthly_cost(t: PracticeTables) -> DataFrame:
    """Actual cost per practice and month."""
    return spend.monthly_cost(t.rx)


@query("avg_monthly_spend")
def avg_monthly_spend(t: PracticeTables) -> DataFrame:
    """Average monthly spend of every practice (both forms)."""
    return spend.avg_monthly_spend(t.rx)


@query("monthly_cost_per_patient")
def monthly_cost_per_patient(t: PracticeTables) -> DataFrame:
    """Monthly cost %/% list size."""
    return spend.monthly_cost_per_patient(t.rx, t.qof)


@query("spend_per_patient")
def spend_per_patient(t: PracticeTables) -> DataFrame:
    """Spend per patient of every practice with an address."""
    return spend.spend_per_patient(t.rx, t.qof, t.address)


@query("spend_per_patient_area")
def spend_per_patient_area(t: PracticeTables) -> DataFrame:
    """Practices in the chosen practice's postcode area."""
    return spend.area_peers_of(t.rx, t.qof, t.address, CHOSEN_PRACTICE)


@query("area_peer_stats")
def area_peer_stats(t: PracticeTables) -> DataFrame:
    """J8 for all practices: each practice with its postcode area's count and mean."""
    return spend.area_peer_stats(spend.spend_per_patient(t.rx, t.qof, t.address)).withColumn("area_mean", F.round("area_mean", 6))


@query("area_practice_counts")
def area_practice_counts(t: PracticeTables) -> DataFrame:
    """Rows per practice behind the count chart (practices of the chosen area)."""
    peers = spend.area_peers_of(t.rx, t.qof, t.address, CHOSEN_PRACTICE)
    return peers.groupBy("practiceid").agg(F.count(F.lit(1)).alias("n"))


@query("practice_row_share")
def practice_row_share(t: PracticeTables) -> DataFrame:
    """Each practice's share of rows within its own fill group (the proportion chart).

    The chart fills by practice, so each practice is its own group and its share is 1;
    computed as count / sum(count) over the group.
    """
    rated = rates.indicator_rate(t.qof, "DM", "rate_diabetes")
    counts = rated.groupBy("practiceid").agg(F.count(F.lit(1)).alias("_n"))
    group_total = F.sum("_n").over(Window.partitionBy("practiceid"))
    return counts.select("practiceid", (F.col("_n") / group_total).cast("double").alias("prop"))


# --- drug shares and correlation ------------------------------------------------------------

@query("total_quantity_by_practice")
def total_quantity_by_practice(t: PracticeTables) -> DataFrame:
    """A4: total quantity per practice."""
    return drugs.total_quantity_by_practice(t.rx)


@query("insulin_rows")
def insulin_rows(t: PracticeTables) -> DataFrame:
    """insulin prescriptions."""
    return drugs.drug_rows(t.rx, drugs.is_insulin())


@query("metformin_rows")
def metformin_rows(t: PracticeTables) -> DataFrame:
    """Metformin prescriptions."""
    return drugs.name_prefix_rows(t.rx, t.rx_folded, drugs.METFORMIN_NAME_PREFIX)


@query("insulin_quantity")
def insulin_quantity(t: PracticeTables) -> DataFrame:
    """Insulin quantity per practice."""
    return drugs.drug_quantity(t.rx, drugs.is_insulin(), "insulin_prsc")


@query("metformin_quantity")
def metformin_quantity(t: PracticeTables) -> DataFrame:
    """Metformin quantity per practice."""
    rows = drugs.name_prefix_rows(t.rx, t.rx_folded, drugs.METFORMIN_NAME_PREFIX)
    return drugs.drug_quantity(rows, drugs.is_metformin(), "met_prsc")


@query("insulin_rate")
def insulin_rate(t: PracticeTables) -> DataFrame:
    """Insulin share of prescribed quantity, one pass."""
    return drugs.drug_share(t.rx, drugs.is_insulin(), "rate_insulin")


@query("metformin_rate")
def metformin_rate(t: PracticeTables) -> DataFrame:
    """Metformin share of prescribed quantity, one pass."""
    return drugs.drug_share(t.rx, drugs.is_metformin(), "rate_metformin")


@query("diabetes_insulin_pairs")
def diabetes_insulin_pairs(t: PracticeTables) -> DataFrame:
    """Diabetes rate and insulin share per practice."""
    return correlate.diabetes_insulin_pairs(t.rx, t.qof)


@query("diabetes_metformin_pairs")
def diabetes_metformin_pairs(t: PracticeTables) -> DataFrame:
    """Diabetes rate and metformin share per practice."""
    return correlate.diabetes_metformin_pairs(t.rx, t.qof)


def _rounded(test: DataFrame) -> DataFrame:
    """The operators give full precision; the comparison is of 9 decimals."""
    return test.withColumns({c: F.round(c, 9) for c in ("r", "t", "p_value", "ci_low", "ci_high")})


@query("cor_diabetes_insulin")
def cor_diabetes_insulin(t: PracticeTables) -> DataFrame:
    """Pearson test, diabetes rate ~ insulin share."""
    return _rounded(correlate.cor_diabetes_insulin(t.rx, t.qof))


@query("cor_diabetes_metformin")
def cor_diabetes_metformin(t: PracticeTables) -> DataFrame:
    """Pearson test, diabetes rate ~ metformin share."""
    return _rounded(correlate.cor_diabetes_metformin(t.rx, t.qof))


# --- disease register and profile ----------------------------------------------------------

@query("disease_register")
def disease_register(t: PracticeTables) -> DataFrame:
    """Patients per disease area, national rows, one pass."""
    return register.disease_register(t.qof, t.area, org_prefix=NATIONAL_CODE)


@query("disease_register_union")
def disease_register_union(t: PracticeTables) -> DataFrame:
    """The register as written, 19 filters stacked."""
    return register.disease_register_union(t.qof, org_prefix=NATIONAL_CODE)


@query("practice_profile")
def practice_profile(t: PracticeTables) -> DataFrame:
    """The profile of every practice with both kinds of data."""
    found = profile.practice_profile(t.rx, t.qof, t.address)
    return found.withColumn("area_mean", F.round("area_mean", 6))


@query("practice_report")
def practice_report(t: PracticeTables) -> DataFrame:
    """The profile as one sentence per practice."""
    return profile.practice_report(profile.practice_profile(t.rx, t.qof, t.address))
