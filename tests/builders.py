"""Small in-memory practice tables for unit tests (the test data holds no NULLs)."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

RX_SCHEMA = T.StructType([
    T.StructField("practiceid", T.StringType()),
    T.StructField("period", T.StringType()),
    T.StructField("bnfcode", T.StringType()),
    T.StructField("bnfname", T.StringType()),
    T.StructField("quantity", T.DoubleType()),
    T.StructField("nic", T.DecimalType(18, 2)),
    T.StructField("actcost", T.DecimalType(24, 4)),
])

QOF_SCHEMA = T.StructType([
    T.StructField("orgcode", T.StringType()),
    T.StructField("indicator", T.StringType()),
    T.StructField("numerator", T.LongType()),
    T.StructField("field4", T.LongType()),
])

ADDRESS_SCHEMA = T.StructType([
    T.StructField("practiceid", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("postcode", T.StringType()),
])


def rx(spark: SparkSession, rows) -> DataFrame:
    """rows: (practiceid, period, bnfcode, bnfname, quantity, nic, actcost)."""
    fixed = [(p, per, code, name, None if q is None else float(q),
              None if n is None else Decimal(str(n)), None if a is None else Decimal(str(a)))
             for p, per, code, name, q, n, a in rows]
    return spark.createDataFrame(fixed, RX_SCHEMA)


def qof(spark: SparkSession, rows) -> DataFrame:
    """rows: (orgcode, indicator, numerator, field4)."""
    return spark.createDataFrame(list(rows), QOF_SCHEMA)


def address(spark: SparkSession, rows) -> DataFrame:
    """rows: (practiceid, name, postcode)."""
    return spark.createDataFrame(list(rows), ADDRESS_SCHEMA)


def pairs(spark: SparkSession, xy) -> DataFrame:
    schema = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
    return spark.createDataFrame([(None if x is None else float(x), None if y is None else float(y))
                                  for x, y in xy], schema)


def as_dict(df: DataFrame, key: str, value: str) -> dict:
    return {r[key]: r[value] for r in df.collect()}
