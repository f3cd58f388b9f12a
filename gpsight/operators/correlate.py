"""Diabetes rate against a drug's share of prescribing, across practices.

``rate_pairs`` inner-joins two one-row-per-practice tables (the scatter plot's data);
``rate_share_pairs`` computes the same pairs for a QOF rate and a prescription share in one
co-grouped aggregation;
``pearson_test`` reduces a pair table to one row with two global aggregations over the same
exchange. Each is partial per partition and merged once, so it is a fixed-size exchange no
matter how many practices there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gpsight.functions.exact import exact_mean, exact_sum
from gpsight.functions.expr import max_where, ratio, starts_with, sum_where
from gpsight.functions.stats import DEFAULT_ALPHA, pearson_test_from_moments
from gpsight.operators.cogroup import QOF, RX, side_counts, stacked
from gpsight.operators.drugs import is_insulin, is_metformin
from gpsight.operators.keys import join_on


def rate_pairs(rate: DataFrame, share: DataFrame) -> DataFrame:
    """(practiceid, <rate column>, <share column>) for practices present in both."""
    return join_on(rate, share)


def pearson_test(pairs: DataFrame, x: str, y: str, alpha: float = DEFAULT_ALPHA,
                 digits: int | None = None) -> DataFrame:
    """One row: n, r, t, df, p_value, ci_low, ci_high, significant (``cor.test(x, y)``).

    Pairs with a NULL on either side are dropped. Outputs have full precision, or are rounded to
    ``digits`` decimals. First the means and ranges, then the sums of centred products, both
    added up exactly, so the result is the same bits for every order and partitioning of the
    pairs. The two passes read the pairs' exchange once.
    """
    complete = (pairs.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
                .filter(F.col("_x").isNotNull() & F.col("_y").isNotNull()))
    about = F.struct(*(part for c in ("_x", "_y") for part in (
        exact_mean(c).alias(f"mean{c}"), F.max(c).alias(f"max{c}"), F.min(c).alias(f"min{c}"))))
    told = complete.agg(about.alias("_told")).scalar()

    def centred(c: str) -> Column:
        # a constant column has no spread, whatever its mean was rounded to; ranges are brought
        # near 1 by a power of two, which r doesn't see
        low, high = told.getField(f"min{c}"), told.getField(f"max{c}")
        spread = high - low
        usual = (spread > 0) & (spread < F.lit(float("inf")))
        scale = F.when(usual, F.pow(F.lit(2.0), -F.floor(F.log2(F.when(usual, spread))))).otherwise(F.lit(1.0))
        return F.when(low == high, F.lit(0.0)).otherwise((F.col(c) - told.getField(f"mean{c}")) * scale)

    moved = complete.select(centred("_x").alias("_x"), centred("_y").alias("_y"))
    moments = moved.agg(
        F.count(F.lit(1)).alias("_n"),
        exact_sum(F.col("_x") * F.col("_x")).alias("_sxx"),
        exact_sum(F.col("_y") * F.col("_y")).alias("_syy"),
        exact_sum(F.col("_x") * F.col("_y")).alias("_sxy"),
    )
    return pearson_test_from_moments(moments, "_n", "_sxx", "_syy", "_sxy", alpha=alpha,
                                     digits=digits)


def rate_share_pairs(rx: DataFrame, qof: DataFrame, predicate: Column, name: str,
                     prefix: str = "DM", rate_name: str = "rate_diabetes",
                     na: str = "skip") -> DataFrame:
    """(practiceid, <rate_name>, <name>): indicator rate next to a drug's share, one pass.

    Equal to ``rate_pairs(indicator_rate(qof, prefix), drug_share(rx, predicate, name))``:
    both tables are stacked and grouped once by practice (``cogroup``); a practice is kept
    when it has QOF rows (the rate's full join) and matching prescriptions (the share's inner
    join). One shuffle of partial aggregates, no join. ``na`` holds for the figures that the
    original adds up in R; the total quantity comes from its SQL and skips missing ones.
    """
    rows = stacked(rx, {"_qty": F.col("quantity"), "_hit": predicate},
                   qof, {"_ind": starts_with("indicator", prefix), "_dm": F.col("numerator"),
                         "_size": F.col("field4")})
    of_rx, of_qof = F.col("_source") == RX, F.col("_source") == QOF
    grouped = rows.groupBy("practiceid").agg(
        sum_where(F.col("_ind"), "_dm", na).alias("_patients"), max_where(of_qof, "_size", na).alias("_pop"),
        sum_where(F.col("_hit"), "_qty", na).alias("_drug"), F.sum(F.when(of_rx, F.col("_qty"))).alias("_total"),
        F.count_if(F.col("_hit")).alias("_matches"), *side_counts())
    return (grouped.filter((F.col("_qof_rows") > 0) & (F.col("_matches") > 0))
            .select("practiceid", ratio("_patients", "_pop").alias(rate_name),
                    ratio("_drug", "_total").alias(name)))


def diabetes_insulin_pairs(rx: DataFrame, qof: DataFrame, na: str = "skip") -> DataFrame:
    return rate_share_pairs(rx, qof, is_insulin(), "rate_insulin", na=na)


def diabetes_metformin_pairs(rx: DataFrame, qof: DataFrame, na: str = "skip") -> DataFrame:
    return rate_share_pairs(rx, qof, is_metformin(), "rate_metformin", na=na)


def cor_diabetes_insulin(rx: DataFrame, qof: DataFrame, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    return pearson_test(diabetes_insulin_pairs(rx, qof), "rate_diabetes", "rate_insulin", alpha)


def cor_diabetes_metformin(rx: DataFrame, qof: DataFrame, alpha: float = DEFAULT_ALPHA) -> DataFrame:
    return pearson_test(diabetes_metformin_pairs(rx, qof), "rate_diabetes", "rate_metformin", alpha)
