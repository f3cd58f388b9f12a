"""Joins on the practice key with the analysed code's NULL semantics.

dplyr's joins match a missing key with a missing key (and ``group_by`` keeps a missing key
as its own group, as SQL ``GROUP BY`` does). Spark's ``join(on="practiceid")`` drops NULL
keys, so the joins here compare keys with ``<=>``; Spark still plans them as hash or
sort-merge joins, on (coalesce(key, ''), isnull(key)).

Used by the written forms kept for equivalence (full-join rate, two-scan share) and by the
generic ``rate_pairs``. The hot paths avoid the join altogether (``cogroup``) or group on the
same two-column key beforehand (``cogroup.key_columns``) so that their partitioning is reused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FULL = ("full", "outer", "full_outer", "fullouter")


def join_on(left: DataFrame, right: DataFrame, how: str = "inner",
            key: str = "practiceid") -> DataFrame:
    """``left`` joined to ``right`` on ``key`` (NULL matches NULL), with one ``key`` column."""
    other = "_right_" + key
    r = right.withColumnRenamed(key, other)
    joined = left.join(r, left[key].eqNullSafe(r[other]), how)
    if how in _FULL or how in ("right", "right_outer", "rightouter"):
        rest = [c for c in joined.columns if c not in (key, other)]
        return joined.select(F.coalesce(left[key], r[other]).alias(key), *rest)
    return joined.drop(other)
