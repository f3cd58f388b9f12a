"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import inspect
import sys
import time
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gpsight.session import materialize

# Rows of a batch that are held as Python objects at once; only memory depends on it.
SLICE_ROWS = 256
# Bytes of text that are worked on at once; only memory depends on it.
SLICE_BYTES = 4 * 1024 * 1024
# Rows of an Arrow batch between the JVM and a worker.
BATCH_SETTING, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
# Bytes of words and their encodings that a worker remembers, and what an entry costs besides.
CACHE_BYTES, CACHE_ENTRY = 96 * 1024 * 1024, 200


def short_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_ROWS rows in this session, unless it asks for fewer.

    Spark's default of 10,000 rows is tens of megabytes of texts, held by the JVM and by the
    worker of every running task at once.
    """
    if int(spark.conf.get(BATCH_SETTING, "10000")) not in range(1, BATCH_ROWS + 1):
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of an id's decimal text modulo ``folds``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0))


def _bounded(batch: pa.RecordBatch, sizes: np.ndarray, rows: int, limit: int) -> Iterator[pa.RecordBatch]:
    total, at = sizes.cumsum(), 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(total.searchsorted(before + limit, side="right"))))
        yield batch.slice(at, end - at)
        at = end


def _bytes(column: pa.Array) -> np.ndarray:
    """Bytes of each value; of other types than text and binary the mean."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_binary(kind) or pa.types.is_large_string(kind) or pa.types.is_large_binary(kind):
        return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.full(len(column), -(-column.nbytes // max(1, len(column))), np.int64)


def bounded_batches(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a number of rows and of bytes; a row is never cut."""
    for batch in batches:
        yield from _bounded(batch, sum(map(_bytes, batch.columns), np.zeros(batch.num_rows, np.int64)), rows, limit)


def slices(batches: Iterable[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[dict[str, list]]:
    """The rows of Arrow batches as column lists, a bounded number of rows and bytes at a time."""
    for batch in bounded_batches(batches, rows):
        yield batch.to_pydict()


def byte_slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut where the bytes of a text column pass ``limit``; a row is never cut."""
    for batch in batches:
        yield from _bounded(batch, _bytes(batch.column(column)), batch.num_rows, limit)


def map_rows(df: DataFrame, step: Callable[[dict[str, list]], dict[str, list]], schema: str,
             rows: int = SLICE_ROWS, make: Callable[[], Callable] | None = None) -> DataFrame:
    """Apply a function on column lists to slices of ``df`` in Python workers.

    ``make``, if given, is called once a task and returns the function (for per-task state).
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        apply = make() if make else step
        for part in slices(batches, rows):
            yield pa.RecordBatch.from_pydict(apply(part), schema=arrow)

    return df.mapInArrow(tidied(run), schema)


def tidy() -> None:
    """Gives memory that a worker has freed back to the system; it serves other operators later."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidied(run: Callable) -> Callable:
    """A function on a task's batches that tidies up at the task's end."""
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            tidy()
    return wrapped


def tidied_groups(run: Callable) -> Callable:
    """A function on one group (or two) that tidies up after it, once in some seconds."""
    def done(found):
        if time.monotonic() - vars(sys).get("_gpsight_tidied", 0) > 2:
            tidy()
            vars(sys)["_gpsight_tidied"] = time.monotonic()
        return found
    if len(inspect.signature(run).parameters) == 1:
        return lambda group: done(run(group))
    return lambda left, right: done(run(left, right))


def once(key, make: Callable):
    """What ``make`` returns, made once in each Python worker and kept for its later tasks.

    A worker serves several operators in turn; it keeps what the latest one asked for, and lets
    go of the rest.
    """
    kept = vars(sys).setdefault("_gpsight_kept", {})
    if key not in kept:
        kept.clear()
        tidy()
        kept[key] = make()
    return kept[key]


class Remembered(dict):
    """Encodings of words, forgotten all together when they outgrow a number of bytes."""

    def __init__(self, limit: int = CACHE_BYTES):
        super().__init__()
        self.limit, self.held = limit, 0

    def keep(self, word: str, packed: bytes) -> bytes:
        size = 2 * len(word) + len(packed) + CACHE_ENTRY
        if self.held + size > self.limit:
            self.clear()
            self.held = 0
        if size <= self.limit:
            self[word] = packed
            self.held += size
        return packed


def carried(docs: DataFrame, carry: bool) -> list[Column]:
    """The other columns of ``docs`` as one column ``row``, if they are to be carried along."""
    return [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")] if carry else []


def row_schema(docs: DataFrame, carry: bool) -> str:
    return f", row {docs.schema.simpleString()}" if carry else ""


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_sample(labelled: DataFrame, key: str, label: str, per_label: int) -> DataFrame:
    """At most ``per_label`` rows of each label, the ones with the smallest key hashes.

    Hash-ordered sampling is the same on every run and every partitioning. The rows of a label
    are first cut to ``per_label`` in each of 64 hash slots, so no task holds a whole label.
    """
    from pyspark.sql import Window

    order = [F.xxhash64(F.col(key).cast("string")), F.col(key)]
    slot = F.pmod(F.xxhash64(F.lit("slot"), F.col(key).cast("string")), F.lit(64))
    for part in ([label, "_slot"], [label]):
        rank = F.row_number().over(Window.partitionBy(*part).orderBy(*order))
        labelled = (labelled.withColumn("_slot", slot).withColumn("_rank", rank)
                    .filter(F.col("_rank") <= per_label).drop("_rank"))
    return labelled.drop("_slot")


__all__ = ["Remembered", "SLICE_BYTES", "SLICE_ROWS", "bounded_batches", "bounded_sample", "byte_slices", "carried", "fold", "map_rows", "materialize", "once", "row_schema", "short_batches",
           "shuffle_partitions", "slices", "table", "tidied", "tidied_groups", "tidy"]
