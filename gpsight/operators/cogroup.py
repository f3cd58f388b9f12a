"""Per-practice figures from two tables in one aggregation (union, then group).

Several analyses aggregate the prescription table and the QOF table by practice and then
inner-join the two results. Here the rows of both tables are stacked — each side's columns
next to NULLs for the other's, plus a source tag — and grouped once by practice:

* one shuffle of map-side partial aggregates instead of two aggregations and a join;
* "present on both sides" is a per-source row count above zero, which is exactly the inner
  join of the two per-practice results;
* a missing practice id forms one group, matching a missing id on the other side, as
  dplyr's joins do — with no extra shuffle for a null-safe join key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RX = "rx"
QOF = "qof"


def stacked(rx: DataFrame, rx_cols: dict[str, Column], qof: DataFrame,
            qof_cols: dict[str, Column]) -> DataFrame:
    """(practiceid, _source, <rx_cols>, <qof_cols>): the rows of both tables in one schema.

    ``rx`` is keyed by ``practiceid``, ``qof`` by ``orgcode``. A column of one side is NULL
    on the other side's rows, so aggregates over it ignore those rows.
    """
    names = list(dict.fromkeys([*rx_cols, *qof_cols]))

    def side(df: DataFrame, key: str, tag: str, cols: dict[str, Column]) -> DataFrame:
        return df.select(F.col(key).alias("practiceid"), F.lit(tag).alias("_source"),
                         *[(cols[n] if n in cols else F.lit(None)).alias(n) for n in names])

    return side(rx, "practiceid", RX, rx_cols).unionByName(side(qof, "orgcode", QOF, qof_cols))


def side_counts() -> list[Column]:
    """Aggregates counting each side's rows (for the inner-join condition)."""
    return [F.count_if(F.col("_source") == RX).alias("_rx_rows"),
            F.count_if(F.col("_source") == QOF).alias("_qof_rows")]


def on_both_sides(grouped: DataFrame) -> DataFrame:
    """Keep practices with rows on both sides (the inner join of the two aggregates)."""
    return grouped.filter((F.col("_rx_rows") > 0) & (F.col("_qof_rows") > 0))


# A null-safe practice key as two plain columns: (is the id missing, the id or ''). Grouping on
# them equals grouping on the id (NULL forms one group), and a plain equi-join on them equals
# the null-safe join ``<=>`` — but, unlike ``<=>`` on the id, it can reuse the partitioning
# the grouping produced, so the per-practice side is not shuffled again.
KEY_COLUMNS = ("_key_missing", "_key")


def key_columns(column: str = "practiceid") -> list[Column]:
    c = F.col(column)
    return [c.isNull().alias(KEY_COLUMNS[0]), F.coalesce(c, F.lit("")).alias(KEY_COLUMNS[1])]


def practice_from_key() -> Column:
    return F.when(~F.col(KEY_COLUMNS[0]), F.col(KEY_COLUMNS[1])).alias("practiceid")


def group_by_practice_key(rows: DataFrame):
    """``rows.groupBy`` on the two-column null-safe practice key."""
    return rows.groupBy(*key_columns())


def join_address(per_practice: DataFrame, address: DataFrame, how: str = "inner") -> DataFrame:
    """Attach ``postcode`` to a table grouped by the two-column key; restores ``practiceid``."""
    addr = address.select(*key_columns(), "postcode")
    joined = per_practice.join(addr, list(KEY_COLUMNS), how)
    rest = [c for c in joined.columns if c not in KEY_COLUMNS]
    return joined.select(practice_from_key(), *rest)

