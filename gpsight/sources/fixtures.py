"""The practice tables as views over the driver's TPC-H-style test tables.

Mapping: practice = supplier, prescription = line item, drug = part, patient = customer.
The same views are written as SQL in ``gpsight.plans.oracle`` for the DuckDB oracle; both
must give identical rows.

Plan notes (scale):
* ``nation`` / ``region`` / the area table have a fixed row count, so they are broadcast.
* In the QOF view ``lineitem`` joins ``orders`` / ``part`` without hints: Catalyst and AQE choose
  from the measured sizes (broadcast under the threshold, sort-merge above it). The prescriptions
  join ``part`` by a shuffled hash: the line items' numbers are exchanged right after the scan,
  so an input that can't be split is one task's reading only, not its strings and its sampling too.
* The QOF view counts distinct patients per (practice, indicator) and per practice, by plain
  hash aggregates over one grouping of (practice, patient): partial aggregates before each
  exchange, and no state that depends on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gpsight.functions.expr import NATIONAL_CODE
from gpsight.operators.register import area_table
from gpsight.sources.tables import ROW_KEY, PracticeTables

# The test tables the views read.
BASE_TABLES = ("region", "nation", "supplier", "part", "orders", "lineitem")

# Indicators that an area can have (remainders of three, of either sign), and the bits of the
# masks that hold a patient's indicators in all 19 areas.
KINDS, MASK_BITS, MASK_STARTS = 5, 48, (0, 48)


def read_base(spark: SparkSession, sf_dir: str, name: str, spread: int | None = None) -> DataFrame:
    """Read one test table; ``spread`` deals the line items to so many partitions.

    They are dealt by (order, line), the table's unique key, so that an order with very many
    lines is spread as well. Spreading is the caller's choice (a file of one row group is one
    input split); nothing here depends on the size of the input.
    """
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return df.repartition(spread, "l_orderkey", "l_linenumber") if spread and name == "lineitem" else df


def padded(value: Column, width: int) -> Column:
    """Digits with leading zeros to at least ``width``; longer numbers keep all their digits."""
    text = value.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def practice_code(key: Column) -> Column:
    """Supplier key -> practice id ``W`` + at least five digits."""
    return F.concat(F.lit("W"), padded(key, 5))


def address_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = read_base(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nation = read_base(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = read_base(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = (supplier
              .join(F.broadcast(nation), F.col("s_nationkey") == F.col("n_nationkey"))
              .join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")))
    postcode = F.concat(
        F.upper(F.substring("r_name", 1, 2)),
        F.col("n_nationkey").cast("string"),
        F.lit(" "),
        (F.col("s_suppkey") % 10).cast("string"),
        F.lit("AA"),
    )
    return joined.select(
        practice_code(F.col("s_suppkey")).alias("practiceid"),
        F.col("s_name").alias("name"),
        postcode.alias("postcode"),
    )


def gp_data_view(spark: SparkSession, sf_dir: str, row_key: bool = False, spread: int | None = None) -> DataFrame:
    """The prescription table. ``row_key`` adds ``_row_key``, a hash of the line item's unique
    (order, line number) key, which the stored-table writer uses to split copies of a row."""
    lineitem = read_base(spark, sf_dir, "lineitem", spread).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity",
        "l_extendedprice", "l_discount")
    part = read_base(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    joined = lineitem.join(part.hint("shuffle_hash"), F.col("l_partkey") == F.col("p_partkey"))

    bnfcode = F.concat(
        padded(F.col("p_size") % 15 + 1, 2),
        padded(F.col("p_partkey") % 4 + 1, 2),
        padded(F.col("p_partkey") % 3 + 1, 2),
        padded(F.col("p_partkey"), 9),
    )
    name = F.col("p_name")
    bnfname = (F.when(name.like("red %"),
                      F.concat(F.lit("Metformin HCl_"), name.substr(F.lit(5), F.length(name))))
               .otherwise(name))
    nic = F.col("l_extendedprice").cast("decimal(18,2)")
    columns = [
        practice_code(F.col("l_suppkey")).alias("practiceid"),
        (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("string").alias("period"),
        bnfcode.alias("bnfcode"),
        bnfname.alias("bnfname"),
        F.col("l_quantity").alias("quantity"),
        nic.alias("nic"),
        (nic * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))).alias("actcost"),
    ]
    if row_key:
        columns.append(F.xxhash64("l_orderkey", "l_linenumber").alias(ROW_KEY))
    return joined.select(*columns)


def qof_view(spark: SparkSession, sf_dir: str, spread: int | None = None) -> DataFrame:
    lineitem = read_base(spark, sf_dir, "lineitem", spread).select("l_orderkey", "l_partkey", "l_suppkey")
    orders = read_base(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    part = read_base(spark, sf_dir, "part").select("p_partkey", "p_size")
    area = area_table(spark).select("idx", "prefix")

    # One group for each practice and patient; its indicators are bits of two masks, so joins, the
    # exchange and the grouping run once, on numbers. A part's number in its area (the remainder of
    # a negative key is negative) is 0 to 4 here.
    number = F.col("idx") * KINDS + (F.col("p_partkey") % 3).cast("int") + 2
    masks = [F.when(number.between(first, first + MASK_BITS - 1), F.call_function("shiftleft", F.lit(1).cast("bigint"), number - first))
             .otherwise(F.lit(0).cast("bigint")) for first in MASK_STARTS]
    patients = (lineitem.filter(F.col("l_suppkey").isNotNull())
                .join(orders.filter(F.col("o_custkey").isNotNull()), F.col("l_orderkey") == F.col("o_orderkey"))
                .join(part, F.col("l_partkey") == F.col("p_partkey"))
                .join(F.broadcast(area), F.col("p_size") % 19 == F.col("idx"))
                .groupBy("l_suppkey", "o_custkey")
                .agg(*(F.bit_or(mask).alias(f"_mask{i}") for i, mask in enumerate(masks))))
    held = [F.count_if(F.getbit(f"_mask{i}", F.lit(bit)) == 1) for i in range(len(MASK_STARTS)) for bit in range(MASK_BITS)]
    sizes = patients.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("field4"), F.array(*held).alias("_held"))
    named = (sizes.select(practice_code(F.col("l_suppkey")).alias("orgcode"), "field4", F.posexplode("_held").alias("_number", "numerator"))
             .filter("numerator > 0"))
    indicator = F.concat(F.col("prefix"), padded(F.col("_number") % KINDS - 1, 3))
    practice_rows = (named.join(F.broadcast(area), F.expr(f"_number DIV {KINDS}") == F.col("idx"))
                     .select("orgcode", indicator.alias("indicator"), "numerator", "field4"))
    national_rows = (practice_rows.groupBy("indicator")
                     .agg(F.sum("numerator").cast("bigint").alias("numerator"),
                          F.sum("field4").cast("bigint").alias("field4"))
                     .select(F.lit(NATIONAL_CODE).alias("orgcode"), "indicator", "numerator", "field4"))
    return practice_rows.unionByName(national_rows)


def load_fixture_tables(spark: SparkSession, sf_dir: str, row_key: bool = False,
                        spread: int | None = None) -> PracticeTables:
    """The practice tables built lazily from the test tables in ``sf_dir``."""
    return PracticeTables(
        rx=gp_data_view(spark, sf_dir, row_key, spread),
        qof=qof_view(spark, sf_dir, spread),
        address=address_view(spark, sf_dir),
        area=area_table(spark),
    )
