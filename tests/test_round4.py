"""Ingest: the practice tables from the test tables, on odd rows and by plan."""

from __future__ import annotations

from collections import defaultdict

from gpsight.operators.register import AREAS
from gpsight.sources.fixtures import gp_data_view, qof_view

from conftest import SF001
from test_plans import executed

LINES = ("l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp, l_quantity double, "
         "l_extendedprice double, l_discount double")


def _code(key):
    return None if key is None else "W" + str(key).rjust(5, "0")


def test_qof_counts_patients_of_odd_rows(spark, tmp_path):
    """Every remainder of a part key, of either sign, in every area; nulls and repeated rows."""
    parts = [(k, "n", s) for s in range(19) for k in (600 + 3 * s, 601 + 3 * s, 602 + 3 * s, -601 - 3 * s, -602 - 3 * s)]
    parts += [(9001, "n", None), (9002, "n", -4), (parts[0][0], "n", 5), parts[1]]
    orders = [(o, o % 7 if o % 11 else None) for o in range(60)] + [(3, 3), (4, 100)]
    lines = [(i % 60 if i % 29 else None, i, parts[i % len(parts)][0] if i % 31 else None,
              (None, 1, 2, -3, 123456)[i % 5], None, 1.0, 1.0, 0.0) for i in range(900)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(lines, LINES).write.parquet(f"{tmp_path}/lineitem.parquet")
    held, lists = defaultdict(set), defaultdict(set)
    for o, _, p, s, *_ in lines:
        for key, cust in orders:
            for part, _, size in parts:
                if key == o and part == p and None not in (s, cust, size) and size >= 0:
                    rest = abs(part) % 3 * (1 if part > 0 else -1) + 1
                    held[_code(s), AREAS[size % 19][1] + str(rest).rjust(3, "0")].add(cust)
                    lists[_code(s)].add(cust)
    want = {(*k, len(v), len(lists[k[0]])) for k, v in held.items()}
    for indicator in {i for _, _, i in ((0, *k) for k in held)}:
        of = [(n, size) for _, i, n, size in want if i == indicator and _ != "WAL"]
        want = want | {("WAL", indicator, sum(n for n, _ in of), sum(size for _, size in of))}
    got = [tuple(r) for r in qof_view(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def _joins(df, column):
    return [n for n in executed(df) if n.getClass().getSimpleName().endswith("JoinExec") and column in n.simpleString(100)]


def test_line_items_meet_their_orders_once(spark):
    """One grouping gives the counts of indicators and the list sizes: no second join of the facts."""
    assert len(_joins(qof_view(spark, SF001), "o_orderkey")) == 1


def test_line_items_are_exchanged_before_their_strings_are_built(spark):
    """A file that can't be split is read by one task, which has only numbers to hand on."""
    join, = _joins(gp_data_view(spark, SF001, row_key=True), "p_partkey")
    assert join.getClass().getSimpleName() == "ShuffledHashJoinExec"


def test_a_file_has_the_rows_of_a_few_megabytes():
    from gpsight.sources import store
    assert store.TARGET_FILE_BYTES <= 64 * 1024 * 1024  # a task's sort stays in memory
