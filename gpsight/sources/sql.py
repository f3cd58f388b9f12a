"""SQL text over the practice tables, with bound parameters.

The analysed code builds SQL by pasting values into the text. Here values are bound as named
parameters (``:name``) by Spark's parser, so a value holding quotes or semicolons stays a
value. The tables are common table expressions of the statement, so no view of the session is
touched. The result is a lazy DataFrame; filters still reach the Parquet scans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gpsight.sources.tables import PracticeTables

# Fixed statements of the analysed code, with the practice id as a bound parameter.
PRACTICE_PRESCRIPTIONS = "select * from gp_data_up_to_2015 where practiceid = :practiceid"
PRACTICE_QOF = "select * from qof_achievement where orgcode = :practiceid"
PRACTICE_ADDRESS = "select * from address where practiceid = :practiceid"


def run_sql(spark: SparkSession, tables: PracticeTables, text: str, **params) -> DataFrame:
    """Run ``text`` over the practice tables, with ``params`` bound by name.

    The tables go by their source names; ``gp_data`` and ``area_dim`` are names of the
    prescriptions and of the disease areas as well.
    """
    names = {"gp_data_up_to_2015": "rx", "gp_data": "rx", "qof_achievement": "qof", "address": "address",
             "area_dim": "area"}
    known = ", ".join(f"{name} AS (SELECT * FROM {{{table}}})" for name, table in names.items())
    body = text.strip().rstrip(";").replace("{", "{{").replace("}", "}}")
    if body.lower().startswith("with"):
        body = f"SELECT * FROM ({body})"
    return spark.sql(f"WITH {known} {body}", args=params, rx=tables.rx, qof=tables.qof,
                     address=tables.address, area=tables.area)
