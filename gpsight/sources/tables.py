"""The practice tables and their readers.

Three tables carry all the analyses:

``rx``       prescriptions, one row per prescribed item per practice and month
             (practiceid, period, bnfcode, bnfname, quantity, nic, actcost)
``qof``      quality-indicator achievement, one row per practice and indicator, with a
             national row per indicator under the organisation code ``WAL``
             (orgcode, indicator, numerator, field4 = practice list size)
``address``  one row per practice (practiceid, name, postcode)

plus ``area`` — the fixed 19-row table of disease-area indicator prefixes.

Readers return lazy DataFrames. Column pruning and filters written later reach the scan.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gpsight.operators.drugs import FOLDED_NAME
from gpsight.operators.register import area_table

# Source table names as they are called in the original database.
SOURCE_NAMES = {
    "rx": "gp_data_up_to_2015",
    "qof": "qof_achievement",
    "address": "address",
}

RX_COLUMNS = ("practiceid", "period", "bnfcode", "bnfname", "quantity", "nic", "actcost")

# Optional column of a prescription DataFrame about to be stored: a deterministic value that
# differs between distinct source rows (a hash of the source's unique key). Not stored.
ROW_KEY = "_row_key"
QOF_COLUMNS = ("orgcode", "indicator", "numerator", "field4")
ADDRESS_COLUMNS = ("practiceid", "name", "postcode")



@dataclass(frozen=True)
class PracticeTables:
    """The tables; ``rx_folded`` is ``rx`` with the folded drug name, where the source stores it."""

    rx: DataFrame
    qof: DataFrame
    address: DataFrame
    area: DataFrame
    rx_folded: DataFrame | None = None

    def register_views(self, prefix: str = "") -> None:
        """Expose the tables to ``spark.sql`` as temp views."""
        self.rx.createOrReplaceTempView(prefix + "gp_data")
        self.rx.createOrReplaceTempView(prefix + SOURCE_NAMES["rx"])
        self.qof.createOrReplaceTempView(prefix + "qof_achievement")
        self.address.createOrReplaceTempView(prefix + "address")
        self.area.createOrReplaceTempView(prefix + "area_dim")


def read_parquet_tables(spark: SparkSession, path: str) -> PracticeTables:
    """Read the three practice tables stored as Parquet under ``path``.

    Expects ``{path}/gp_data_up_to_2015``, ``{path}/qof_achievement`` and ``{path}/address``
    (files or folders, possibly partitioned).
    """
    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path.rstrip('/')}/{name}")

    rx = read(SOURCE_NAMES["rx"])
    return PracticeTables(
        rx=rx.select(*RX_COLUMNS),
        qof=read(SOURCE_NAMES["qof"]).select(*QOF_COLUMNS),
        address=read(SOURCE_NAMES["address"]),
        area=area_table(spark),
        rx_folded=rx.select(*RX_COLUMNS, FOLDED_NAME) if FOLDED_NAME in rx.columns else None,
    )


def read_jdbc_tables(
    spark: SparkSession,
    url: str,
    properties: dict[str, str],
    num_partitions: int = 64,
) -> PracticeTables:
    """Read the practice tables from the original relational database over JDBC.

    The big prescription table is read in ``num_partitions`` parallel range slices of the
    numeric or date column that ``properties`` names (``partitionColumn``, ``lowerBound``,
    ``upperBound``); without one it would be one task's work, so that is an error. Filters and
    column pruning written later are pushed into the generated SQL by the JDBC source.
    """
    missing = [k for k in ("partitionColumn", "lowerBound", "upperBound") if k not in properties]
    if missing:
        raise ValueError(f"the prescription table is read in slices; properties lack {', '.join(missing)}")
    props = dict(properties)
    part_col = props.pop("partitionColumn", None)
    lower = props.pop("lowerBound", None)
    upper = props.pop("upperBound", None)

    def read(table: str, partitioned: bool = False) -> DataFrame:
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", table)
        for key, value in props.items():
            reader = reader.option(key, value)
        if partitioned and part_col:
            reader = (reader.option("partitionColumn", part_col)
                      .option("lowerBound", lower).option("upperBound", upper)
                      .option("numPartitions", num_partitions))
        return reader.load()

    return PracticeTables(
        rx=read(SOURCE_NAMES["rx"], partitioned=True).select(*RX_COLUMNS),
        qof=read(SOURCE_NAMES["qof"]).select(*QOF_COLUMNS),
        address=read(SOURCE_NAMES["address"]),
        area=area_table(spark),
    )


def write_parquet_tables(tables: PracticeTables, path: str, mode: str = "overwrite",
                         partitions: int | None = None) -> None:
    """Store the practice tables as Parquet under ``path`` (readable by ``read_parquet_tables``).

    Each table is range-partitioned on its practice key followed by further columns —
    (practice, period, drug code, source row key) for prescriptions, (organisation,
    indicator) for QOF, which is unique — and sorted the same way inside each file. Each
    file then holds a contiguous slice of practice ids, so an equality or prefix filter on
    the practice (one practice's rows, the national ``WAL`` rows) skips the other files' row
    groups by their min/max statistics; and because the range key goes beyond the practice,
    one practice holding many rows — or many copies of one row, told apart by the source
    row key ``_row_key`` — is still split over several files and write tasks. Without a
    source row key every column is part of the range key, so only exact copies of a row
    stay together. All keys are deterministic and the range bounds come from a sample taken
    once, so retried tasks write the same rows.
    """
    spark = tables.rx.sparkSession
    n = partitions or spark.sparkContext.defaultParallelism
    base = path.rstrip("/")
    if ROW_KEY in tables.rx.columns:
        rx_key = ("practiceid", "period", "bnfcode", ROW_KEY)
    else:
        rx_key = ("practiceid", "period", "bnfcode", "bnfname", "quantity", "nic", "actcost")
    qof_key = ("orgcode", "indicator")
    results = {
        "rx": tables.rx.repartitionByRange(n, *rx_key).sortWithinPartitions(*rx_key)
        .select(*RX_COLUMNS, F.lower("bnfname").alias(FOLDED_NAME)),
        "qof": tables.qof.repartitionByRange(n, *qof_key).sortWithinPartitions(*qof_key),
        "address": tables.address,
    }
    # three independent jobs: small stages of one fill the cores that another leaves idle
    with ThreadPoolExecutor(len(results)) as pool:
        jobs = [pool.submit(df.write.mode(mode).parquet, f"{base}/{SOURCE_NAMES[name]}")
                for name, df in results.items()]
        for job in jobs:
            job.result()
