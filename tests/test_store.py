"""The stored practice tables: built once, reused, rebuilt when inputs or commits change."""

from __future__ import annotations

import os
import shutil

from gpsight.sources import store
from gpsight.sources.fixtures import BASE_TABLES, load_fixture_tables

from conftest import SF001


def _copy_inputs(dst) -> str:
    folder = dst / "sf"
    folder.mkdir()
    for name in BASE_TABLES:
        shutil.copy(f"{SF001}/{name}.parquet", folder / f"{name}.parquet")
    return str(folder)


def test_store_is_reused_and_follows_its_inputs(spark, tmp_path):
    sf = _copy_inputs(tmp_path)
    first = store.practice_tables(spark, sf)
    root = store.current_location(spark, sf)
    assert root is not None and store._commit_stamp(spark, root) is not None
    assert store.practice_tables(spark, sf) is first  # opened once per session and commit
    assert store.current_location(spark, sf) == root  # no second build

    # same rows as the views they were built from
    views = load_fixture_tables(spark, sf)
    assert first.qof.exceptAll(views.qof).count() == 0
    assert first.rx.count() == views.rx.count()

    # a changed input file gives a new location (and a fresh build)
    os.utime(f"{sf}/lineitem.parquet", (1_000_000_000, 1_000_000_000))
    assert store.current_location(spark, sf) is None
    rebuilt = store.practice_tables(spark, sf)
    assert rebuilt is not first and rebuilt.rx.count() == views.rx.count()


def test_incomplete_store_is_rebuilt(spark, tmp_path):
    sf = _copy_inputs(tmp_path)
    store.practice_tables(spark, sf)
    root = store.current_location(spark, sf)
    local = root[len("file:"):] if root.startswith("file:") else root
    os.remove(f"{local}/qof_achievement/_SUCCESS")  # as if a write had died half-way
    assert store._commit_stamp(spark, root) is None
    assert store.current_location(spark, sf) is None  # the incomplete copy is never read
    tables = store.practice_tables(spark, sf)
    fresh = store.current_location(spark, sf)
    assert fresh is not None and fresh != root
    assert tables.qof.count() > 0


def test_copies_of_one_row_are_split_by_the_row_key(spark, tmp_path):
    import pyarrow.parquet as pq
    from decimal import Decimal

    from pyspark.sql import functions as F

    import builders as b
    from gpsight.operators.register import area_table
    from gpsight.sources.tables import ROW_KEY, PracticeTables, write_parquet_tables

    copies = spark.range(3000).select(
        F.lit("W00001").alias("practiceid"), F.lit("201501").alias("period"),
        F.lit("0601010A0").alias("bnfcode"), F.lit("Insulin").alias("bnfname"),
        F.lit(1.0).alias("quantity"), F.lit(Decimal("2.00")).cast("decimal(18,2)").alias("nic"),
        F.lit(Decimal("1.5")).cast("decimal(24,4)").alias("actcost"),
        F.xxhash64("id").alias(ROW_KEY))
    tables = PracticeTables(rx=copies, qof=b.qof(spark, [("W00001", "DM001", 1, 10)]),
                            address=b.address(spark, []), area=area_table(spark))
    out = tmp_path / "stored"
    write_parquet_tables(tables, str(out), partitions=4)
    folder = out / "gp_data_up_to_2015"
    sizes = [pq.ParquetFile(f).metadata.num_rows for f in folder.glob("*.parquet")]
    assert sum(sizes) == 3000 and len([s for s in sizes if s]) == 4  # spread over all files
    assert ROW_KEY not in pq.ParquetFile(next(folder.glob("*.parquet"))).schema_arrow.names
