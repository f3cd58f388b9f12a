"""Practice-id checks and data availability, for every practice at once.

The analysed code asks, for one practice, "are there prescription rows?" and "are there
QOF rows?" by fetching all the rows and counting them. Here one aggregation over the union
of the id columns answers both questions for every practice: each side contributes only
its id plus a flag, the partial aggregate collapses each input partition to its distinct
ids before the shuffle, and no join against the large fact tables is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gpsight.functions.expr import is_valid_practice_id


def _id_flags(rx: DataFrame, qof: DataFrame, address: DataFrame | None) -> DataFrame:
    sides = [
        rx.select(F.col("practiceid"), F.lit(1).alias("_med"), F.lit(0).alias("_qof")),
        qof.select(F.col("orgcode").alias("practiceid"), F.lit(0).alias("_med"), F.lit(1).alias("_qof")),
    ]
    if address is not None:
        sides.append(address.select("practiceid", F.lit(0).alias("_med"), F.lit(0).alias("_qof")))
    out = sides[0]
    for side in sides[1:]:
        out = out.unionByName(side)
    # id checks are about practice ids; a row without one belongs to no practice
    return out.filter(F.col("practiceid").isNotNull())


def validate_practice_ids(ids: DataFrame, column: str = "practiceid") -> DataFrame:
    """Adds ``is_valid``: the id matches ``^W[0-9]{5}$`` (NULL for a NULL id)."""
    return ids.withColumn("is_valid", is_valid_practice_id(column))


def known_practice_ids(rx: DataFrame, qof: DataFrame, address: DataFrame) -> DataFrame:
    """(practiceid): every id seen in any of the three tables."""
    return _id_flags(rx, qof, address).select("practiceid").distinct()


def data_availability(rx: DataFrame, qof: DataFrame, address: DataFrame | None = None) -> DataFrame:
    """(practiceid, has_med, has_qof) for every id in the prescription, QOF or address tables."""
    return (_id_flags(rx, qof, address).groupBy("practiceid")
            .agg((F.max("_med") > 0).alias("has_med"), (F.max("_qof") > 0).alias("has_qof")))


def practice_row_counts(rx: DataFrame, qof: DataFrame, address: DataFrame | None = None) -> DataFrame:
    """(practiceid, med_rows, qof_rows): row counts per practice in both fact tables."""
    return (_id_flags(rx, qof, address).groupBy("practiceid")
            .agg(F.sum("_med").cast("bigint").alias("med_rows"),
                 F.sum("_qof").cast("bigint").alias("qof_rows")))


def practices_with_both(rx: DataFrame, qof: DataFrame) -> DataFrame:
    """(practiceid): practices with prescription rows AND QOF rows."""
    return (data_availability(rx, qof).filter(F.col("has_med") & F.col("has_qof"))
            .select("practiceid"))


def practices_with_both_semi(rx: DataFrame, qof: DataFrame, address: DataFrame) -> DataFrame:
    """The same set written as two existence tests (left-semi joins) on the address list.

    The right sides are reduced to their distinct ids first, so the semi joins shuffle one
    row per practice rather than the fact tables.
    """
    med_ids = rx.select("practiceid").distinct()
    qof_ids = qof.select(F.col("orgcode").alias("practiceid")).distinct()
    # (a NULL id matches nothing in a semi join, so NULL ids drop out as in data_availability)
    return (address.select("practiceid").distinct()
            .join(med_ids, "practiceid", "left_semi")
            .join(qof_ids, "practiceid", "left_semi"))


def check_practices(ids: DataFrame, rx: DataFrame, qof: DataFrame,
                    column: str = "practiceid") -> DataFrame:
    """(practiceid, is_valid, has_med, has_qof, has_both) for each requested id.

    The batch form of the analysed code's first steps: format check, then the two existence
    tests, then their conjunction. Ids that appear in neither table get false/false. The
    flags come from one aggregation over the id columns of both tables (one row per
    practice), left-joined to the requested ids; AQE picks broadcast or sort-merge from the
    measured sizes.
    """
    flags = data_availability(rx, qof)
    requested = ids.select(F.col(column).alias("practiceid"))
    joined = requested.join(flags, "practiceid", "left")
    has_med = F.coalesce(F.col("has_med"), F.lit(False))
    has_qof = F.coalesce(F.col("has_qof"), F.lit(False))
    return joined.select(
        "practiceid",
        is_valid_practice_id("practiceid").alias("is_valid"),
        has_med.alias("has_med"),
        has_qof.alias("has_qof"),
        (has_med & has_qof).alias("has_both"),
    )
