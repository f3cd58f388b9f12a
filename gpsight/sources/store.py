"""Stored practice tables: the views over the test tables, written once as Parquet.

In the analysed application the prescription, QOF and address tables are stored database
tables; loading them is not part of any analysis. ``practice_tables`` mirrors that: the
first call for an input folder builds the views (``gpsight.sources.fixtures``) and writes
them as Parquet under the shared checkpoint folder (``spark.checkpoint.dir``); later calls
read the stored tables. Copies are keyed by a fingerprint of the input files (path, size,
file count, modification time), so changed inputs are never served from an old copy; each
ingest writes a new folder and only complete folders (three commit markers) are read.

All file-system calls go through Hadoop's FileSystem API, so the folder can be HDFS, S3 or
any other shared store the cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import inspect
import uuid

from pyspark.sql import SparkSession

from gpsight.session import checkpoint_dir
from gpsight.sources.fixtures import BASE_TABLES, load_fixture_tables
from gpsight.sources.tables import (SOURCE_NAMES, PracticeTables, read_parquet_tables,
                                    write_parquet_tables)

STORE_FOLDER = "gpsight-practice-tables"

# Bumped whenever the stored layout changes, so an older layout is never served.
STORE_LAYOUT_VERSION = 4

# Session setting with the number of partitions to which line items are dealt at ingest.
SPREAD_SETTING = "spark.gpsight.ingest.spread"

# Input bytes behind one stored file; the number of files grows with the input. A task sorts
# one file's rows, which are several times larger in memory: more than this is sorted on disk.
TARGET_FILE_BYTES = 32 * 1024 * 1024


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    return hpath.getFileSystem(conf), hpath


def _input_summaries(spark: SparkSession, sf_dir: str):
    """(path, bytes, files, modification time) per input table.

    Two file-system calls per table, answered on the JVM side (a content summary and the
    table's own status), so the cost does not grow with the number of files — listing
    hundreds of thousands of files through the Python gateway would stall the driver.
    """
    for name in BASE_TABLES:
        fs, path = _fs(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")
        if fs.exists(path):
            summary = fs.getContentSummary(path)
            status = fs.getFileStatus(path)
            yield (str(path), summary.getLength(), summary.getFileCount(),
                   status.getModificationTime())


def _builder_source() -> bytes:
    """The code that builds and lays out the stored tables: a change to it is a new copy."""
    from gpsight.operators import register
    from gpsight.sources import fixtures, tables

    return b"".join(inspect.getsource(m).encode() for m in (fixtures, tables, register))


def fingerprint(spark: SparkSession, sf_dir: str) -> str:
    """Hash of the input tables (paths, sizes, file counts, modification times) and of the
    code that builds the stored copy from them."""
    digest = hashlib.sha1(f"v{STORE_LAYOUT_VERSION}|{sf_dir.rstrip('/')}".encode())
    digest.update(_BUILDER_DIGEST)
    for path, size, files, mtime in _input_summaries(spark, sf_dir):
        digest.update(f"{path}|{size}|{files}|{mtime}".encode())
    return digest.hexdigest()[:16]


def _commit_stamp(spark: SparkSession, root: str) -> tuple | None:
    """Modification times of the three tables' commit markers; None if any is missing."""
    stamp = []
    for name in SOURCE_NAMES.values():
        fs, path = _fs(spark, f"{root}/{name}/_SUCCESS")
        if not fs.exists(path):
            return None
        stamp.append(fs.getFileStatus(path).getModificationTime())
    return tuple(stamp)


def store_base(spark: SparkSession, sf_dir: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{STORE_FOLDER}/{fingerprint(spark, sf_dir)}"


def current_location(spark: SparkSession, sf_dir: str) -> str | None:
    """The newest complete stored copy for ``sf_dir`` (all three commit markers present)."""
    base = store_base(spark, sf_dir)
    fs, pattern = _fs(spark, f"{base}-*")
    found = fs.globStatus(pattern) or []
    candidates = sorted(((st.getModificationTime(), str(st.getPath())) for st in found
                         if st.isDirectory()), reverse=True)
    for _, path in candidates:
        if _commit_stamp(spark, path) is not None:
            return path
    return None


def ingest(spark: SparkSession, sf_dir: str, location: str | None = None,
           spread: int | None = None) -> str:
    """Build the practice tables from ``sf_dir`` and write them; returns the folder.

    Each ingest writes a new folder, so a copy being written (or abandoned half-way by a
    failed job) is never read, and readers of an older copy are never disturbed. ``spread``
    deals the line items to so many partitions first, for inputs that can't be split (a file of
    one row group is one task, however large). It is the caller's choice, here or by the session
    setting ``spark.gpsight.ingest.spread``; without either nothing is dealt anew.
    """
    if spread is None and (chosen := spark.conf.get(SPREAD_SETTING, None)):
        spread = int(chosen)
    root = location or f"{store_base(spark, sf_dir)}-{uuid.uuid4().hex[:12]}"
    input_bytes = sum(size for _, size, _, _ in _input_summaries(spark, sf_dir))
    partitions = max(spark.sparkContext.defaultParallelism,
                     -(-input_bytes // TARGET_FILE_BYTES))
    write_parquet_tables(load_fixture_tables(spark, sf_dir, row_key=True, spread=spread), root,
                         partitions=partitions)
    return root


# Opened tables per (session, folder, commit stamp): opening lists files and reads Parquet
# footers, which would otherwise be repeated by every query.
_OPENED: dict[tuple, PracticeTables] = {}


def practice_tables(spark: SparkSession, sf_dir: str) -> PracticeTables:
    """The practice tables for ``sf_dir``, stored on first use and read from storage after."""
    root = current_location(spark, sf_dir)
    if root is None:
        ingest(spark, sf_dir)
        root = current_location(spark, sf_dir)  # the qualified path, as later lookups see it
    stamp = _commit_stamp(spark, root)
    key = (id(spark), spark.sparkContext.applicationId, root, stamp)
    tables = _OPENED.get(key)
    if tables is None:
        tables = _OPENED[key] = read_parquet_tables(spark, root)
    return tables


# Computed once per process; read by fingerprint().
_BUILDER_DIGEST = hashlib.sha1(_builder_source()).digest()
