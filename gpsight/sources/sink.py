"""Ordered results, written so that readers see the whole of one or nothing of it.

``summarise`` and ``arrange`` of the original scripts give rows in the order of their keys. Here
the order is global: the rows are range-partitioned on the keys and sorted inside each
partition, so file ``part-00000`` holds the smallest keys, and no task sorts more than its range.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gpsight.session import remove_written


def _path(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), hpath


def ordered(df: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """``df`` in the order of ``keys`` (all columns by default), NULLs first.

    The remaining columns break ties, so that equal keys come in one order on every run.
    """
    first = list(keys or [])
    return df.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in [*first, *(c for c in df.columns if c not in first)]))


def write_ordered(df: DataFrame, path: str, keys: Sequence[str] | None = None, clean: bool = False) -> str:
    """Write ``df`` as Parquet under ``path`` in the order of ``keys``; returns ``path``.

    The files are written to a staging folder next to ``path`` and moved there in one rename when
    they are complete; an older result stays until then and is removed after. A failed run
    removes its staging folder. ``clean`` removes what ``session.materialize`` wrote in this run
    as well: pass it with the last result that reads such copies.
    """
    spark = df.sparkSession
    target = path.rstrip("/")
    parent, name = (target.rsplit("/", 1) if "/" in target else (".", target))
    tag = uuid.uuid4().hex[:12]
    fs, staged = _path(spark, f"{parent}/.{name}-staged-{tag}")
    _, old = _path(spark, f"{parent}/.{name}-old-{tag}")
    _, final = _path(spark, target)
    try:
        ordered(df, keys).write.parquet(staged.toString())
        replaced = fs.exists(final)
        if replaced and not fs.rename(final, old):
            raise OSError(f"can't move the older result away from {target}")
        if not fs.rename(staged, final):
            if replaced:
                fs.rename(old, final)
            raise OSError(f"can't move the result to {target}")
        if replaced:
            fs.delete(old, True)
    finally:
        if fs.exists(staged):
            fs.delete(staged, True)
        if clean:
            remove_written(spark)
    return target


def ordered_rows(df: DataFrame, keys: Sequence[str] | None = None) -> Iterator[Row]:
    """The rows in order, a partition at a time: the plan runs once and the driver holds no
    more than a partition or two."""
    return ordered(df, keys).toLocalIterator(prefetchPartitions=True)
