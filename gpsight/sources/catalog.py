"""Catalog reads: the tables a session can see and the structure of one table.

Both are metadata lookups answered by the driver's catalog; neither starts a job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DESCRIBE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("position", T.IntegerType(), False),
    T.StructField("type", T.StringType(), False),
    T.StructField("length", T.IntegerType(), True),
    T.StructField("precision", T.IntegerType(), True),
])

# Binary precision reported for the fixed-width numeric types, following the
# information-schema convention (bits of the significand / integer).
_BINARY_PRECISION = {
    T.ByteType: 8,
    T.ShortType: 16,
    T.IntegerType: 32,
    T.LongType: 64,
    T.FloatType: 24,
    T.DoubleType: 53,
}


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """(name): tables and temp views visible in the session (``dbListTables``)."""
    sql = "SHOW TABLES" if database is None else f"SHOW TABLES IN `{database}`"
    return spark.sql(sql).select(F.col("tableName").alias("name"))


def _describe_field(field: T.StructField, position: int) -> tuple:
    dtype = field.dataType
    length = dtype.length if isinstance(dtype, (T.VarcharType, T.CharType)) else None
    if isinstance(dtype, T.DecimalType):
        precision = dtype.precision
    else:
        precision = _BINARY_PRECISION.get(type(dtype))
    return (field.name, position, dtype.simpleString(), length, precision)


def describe_dataframe(spark: SparkSession, df: DataFrame) -> DataFrame:
    """(name, position, type, length, precision) for each column of ``df``."""
    rows = [_describe_field(f, i + 1) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, DESCRIBE_SCHEMA)


def describe_table(spark: SparkSession, table: str) -> DataFrame:
    """The structure of a registered table or view (``get_columns(table)``)."""
    return describe_dataframe(spark, spark.table(table))
