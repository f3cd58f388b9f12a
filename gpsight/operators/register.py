"""Disease register: patients on each of 19 disease-area registers, national rows.

The analysed code filters the national rows nineteen times (one indicator prefix each),
sums per organisation, labels each result with its area and stacks the nineteen tables.
``disease_register`` does the same in one pass: each indicator is matched to its area by an
equi-join on its leading characters against the broadcast 19-row area table, then one
grouped sum. The prefixes, of any length, are those of the area table that is passed.
Where prefixes overlap (one is the beginning of another) an indicator counts for each of its areas,
as in the stacked form, which is kept as ``disease_register_union``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gpsight.functions.expr import NATIONAL_CODE, sum_na

# The 19 disease areas as (index, indicator prefix, area name), in register order.
AREAS = (
    (0, "AF", "Atrial Fibrillation"),
    (1, "AST", "Asthma"),
    (2, "CAN", "Cancer"),
    (3, "CHD", "Coronary Heart Disease"),
    (4, "COPD", "Chronic Obstructive Pulmonary Disease"),
    (5, "DEM", "Dementia"),
    (6, "DEP", "Depression"),
    (7, "DM", "Diabetes Mellitus"),
    (8, "EP", "Epilepsy"),
    (9, "HF", "Heart Failure"),
    (10, "HYP", "Hypertension"),
    (11, "LD", "Learning Disabilities"),
    (12, "MH", "Mental Health"),
    (13, "OB", "Obesity"),
    (14, "OST", "Osteoporosis"),
    (15, "PAD", "Peripheral Arterial Disease"),
    (16, "RA", "Rheumatoid Arthritis"),
    (17, "SMO", "Smoking"),
    (18, "STIA", "Stroke and Transient Ischaemic Attacks"),
)

AREA_SCHEMA = T.StructType([
    T.StructField("idx", T.IntegerType(), False),
    T.StructField("prefix", T.StringType(), False),
    T.StructField("area", T.StringType(), False),
])


def area_table(spark: SparkSession, areas=AREAS) -> DataFrame:
    """The area dimension (idx, prefix, area)."""
    return spark.createDataFrame(list(areas), AREA_SCHEMA)


def match_area(rows: DataFrame, area: DataFrame, column: str = "indicator") -> DataFrame:
    """Attach every area whose prefix starts ``column`` (inner: rows without an area drop out).

    Each row proposes all beginnings of its code (a handful: codes are short), and an equi-join of
    the proposals with the area table finds the areas, whatever prefixes it holds. This is an
    exact prefix match (codes may carry more letters after the prefix) planned as a hash join
    rather than a nested loop; whether the area table is broadcast is left to its measured size.
    """
    beginnings = F.transform(F.sequence(F.lit(0), F.length(column)),
                             lambda k: F.substring(F.col(column), F.lit(1), k))
    proposed = rows.withColumn("_prefix", F.explode(beginnings))
    return proposed.join(area, F.col("_prefix") == F.col("prefix")).drop("_prefix")


def national_rows(qof: DataFrame, org_prefix: str = NATIONAL_CODE) -> DataFrame:
    """``where orgcode like 'WAL%'`` — national rows, by prefix as the register query has it."""
    return qof.filter(F.col("orgcode").startswith(org_prefix))


def disease_register(qof: DataFrame, area: DataFrame, org_prefix: str = NATIONAL_CODE,
                     na: str = "skip") -> DataFrame:
    """(practiceid, patients, area): summed numerators per national code and row of ``area``.

    Each row of ``area`` (idx, prefix, area) gives its own rows, as each filter of the stacked
    form does, also where two of them share a prefix or a name.
    """
    rows = (national_rows(qof, org_prefix)
            .select(F.col("orgcode").alias("practiceid"), "indicator", "numerator"))
    labelled = match_area(rows, area.select("idx", "prefix", "area"))
    return (labelled.groupBy("practiceid", "idx", "prefix", "area")
            .agg(sum_na("numerator", na).cast("bigint").alias("patients"))
            .select("practiceid", "patients", "area"))


def disease_register_union(qof: DataFrame, areas=AREAS,
                           org_prefix: str = NATIONAL_CODE, na: str = "skip") -> DataFrame:
    """The register as written: one filter + grouped sum per area, stacked by name.

    Reads the national rows once per area; use :func:`disease_register` for real work.
    """
    rows = (national_rows(qof, org_prefix)
            .select(F.col("orgcode").alias("practiceid"), "indicator", "numerator"))
    parts = [
        rows.filter(F.col("indicator").startswith(prefix))
        .groupBy("practiceid")
        .agg(sum_na("numerator", na).cast("bigint").alias("patients"))
        .withColumn("area", F.lit(name))
        for _, prefix, name in areas
    ]
    return reduce(DataFrame.unionByName, parts)
