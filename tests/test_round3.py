"""Order-independent sums, one scan a fact table, pushed regex prefixes, general areas, ordered output, NA policy by origin."""

from __future__ import annotations

import math
import os
import random
import re
from collections import Counter
from fractions import Fraction

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

import builders as b
from gpsight.functions.exact import exact_mean, exact_sum
from gpsight.functions.expr import literal_prefix, str_detect
from gpsight.operators import correlate, drugs, profile, rates, register, spend
from test_plans import _formatted, executed


# --- sums that don't depend on the order of the rows ---

def test_exact_sum_is_the_rounded_true_sum(spark):
    rng = random.Random(1)
    for scale in (1e-6, 1.0, 1e9):
        values = [rng.uniform(-scale, scale) for _ in range(2000)]
        got = spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum("x")).first()[0]
        true = float(sum(map(Fraction, values)))
        assert math.isclose(got, true, rel_tol=4e-16, abs_tol=2000 * 2.0 ** -79)


def test_exact_sum_of_special_values(spark):
    def total(*values):
        return spark.createDataFrame([(v,) for v in values], "x double").agg(exact_sum("x"), exact_mean("x")).first()
    assert tuple(total(None, None)) == (None, None)
    assert tuple(total(1.5, None, 2.5)) == (4.0, 2.0)
    assert total(math.inf, 1.0)[0] == math.inf and total(-math.inf)[0] == -math.inf
    assert math.isnan(total(math.inf, -math.inf)[0]) and math.isnan(total(math.nan, 1.0)[0])
    assert total(1e300, 1.0)[0] == 1e300 and total(-0.5, -0.25)[0] == -0.75


@pytest.fixture(scope="module")
def noisy(spark):
    rng = random.Random(3)
    return [(f"W{i:05d}", rng.choice(["CF", "SA", "LL"]) + "1", rng.lognormvariate(0, 3), rng.lognormvariate(0, 1))
            for i in range(3000)]


def test_results_are_the_same_bits_for_every_partitioning(spark, noisy):
    seen = set()
    for n in (1, 7, 64):
        rows = noisy[:]
        random.Random(n).shuffle(rows)
        df = spark.createDataFrame(rows, "practiceid string, postcode string, x double, y double").repartition(n)
        test = correlate.pearson_test(df, "x", "y").first()
        areas = spend.area_peer_stats(df.withColumn("spend_per_patient", F.col("x"))).select("area", "area_mean").distinct().collect()
        seen.add((tuple(test), tuple(sorted(tuple(a) for a in areas))))
    assert len(seen) == 1


def test_pearson_needs_no_lucky_scale(spark):
    import numpy as np
    rng = np.random.default_rng(5)
    x = rng.normal(size=500)
    y = 0.6 * x + rng.normal(size=500)
    want = np.corrcoef(x, y)[0, 1]
    for shift, unit in ((0, 1.0), (1e6, 1.0), (0, 1e-12), (0, 1e15), (5, 1e-3)):
        got = correlate.pearson_test(b.pairs(spark, list(zip(x * unit + shift, y * unit - shift))), "x", "y").first()["r"]
        assert got == pytest.approx(want, abs=1e-9)
    constant = correlate.pearson_test(b.pairs(spark, [(0.1, i) for i in range(7)]), "x", "y").first()
    assert constant["r"] is None and constant["n"] == 7


# --- one scan of each fact table ---

def _scans(df) -> Counter:
    """Scans that ran, by table and whether they are the national rows only."""
    seen: Counter = Counter()
    for node in executed(df):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            text = node.toString()
            columns = re.search(r"\[(.*?)\]", text).group(1)
            table = "qof" if "orgcode" in columns else "address" if "postcode" in columns else "rx"
            seen[table, "WAL" in text] += 1
    return seen


def test_profile_scans_each_fact_table_once(tables01):
    df = profile.practice_profile(tables01.rx, tables01.qof, tables01.address)
    seen = _scans(df)
    assert seen["rx", False] == 1
    assert seen["qof", False] == 1 and seen["qof", True] <= 1


def test_correlation_scans_each_fact_table_once(tables01):
    seen = _scans(correlate.cor_diabetes_insulin(tables01.rx, tables01.qof))
    assert seen == {("rx", False): 1, ("qof", False): 1}


# --- ingest of inputs that can't be split ---

def test_one_row_group_is_spread_when_asked(spark, tmp_path):
    from conftest import SF001
    from gpsight.sources.fixtures import BASE_TABLES, load_fixture_tables, read_base
    from gpsight.sources.store import SPREAD_SETTING, ingest
    from gpsight.sources.tables import read_parquet_tables
    for name in BASE_TABLES:
        table = pq.read_table(f"{SF001}/{name}.parquet")
        if name == "lineitem":  # one order holds nearly all lines, as a hot key
            lines = pa.array(range(table.num_rows), table.schema.field("l_linenumber").type)
            table = table.set_column(table.schema.get_field_index("l_linenumber"), "l_linenumber", lines)
            order = table["l_orderkey"][0].as_py()
            keys = pa.array([order if i % 10 else k for i, k in enumerate(table["l_orderkey"].to_pylist())],
                            table["l_orderkey"].type)
            table = table.set_column(table.schema.get_field_index("l_orderkey"), "l_orderkey", keys)
        pq.write_table(table, tmp_path / f"{name}.parquet", row_group_size=1 << 30)
    sizes = read_base(spark, str(tmp_path), "lineitem", 8).groupBy(F.spark_partition_id()).count().collect()
    total = sum(r["count"] for r in sizes)
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < total / 4
    spark.conf.set(SPREAD_SETTING, "8")
    try:
        root = ingest(spark, str(tmp_path), location=str(tmp_path / "stored"))
    finally:
        spark.conf.unset(SPREAD_SETTING)
    stored, direct = read_parquet_tables(spark, root), load_fixture_tables(spark, str(tmp_path))
    for name in ("rx", "qof", "address"):
        assert getattr(stored, name).exceptAll(getattr(direct, name)).isEmpty()
        assert getattr(stored, name).count() == getattr(direct, name).count()


# --- prefixes of names and patterns ---

def test_case_insensitive_prefix_reaches_the_scan(spark, tables01):
    from conftest import SF01
    from gpsight.plans.queries import registry
    df = registry()["metformin_rows"](spark, SF01)
    assert "StringStartsWith(bnfname_folded,metformin)" in _formatted(df)
    plain = drugs.name_prefix_rows(tables01.rx, None, "Metformin")
    assert df.columns == plain.columns == tables01.rx.columns
    assert df.count() == plain.count() > 0 and df.exceptAll(plain).isEmpty()


def test_literal_prefixes():
    assert literal_prefix("^DM0[1-3]") == ("DM0", False)
    assert literal_prefix("^SMO") == ("SMO", True)
    assert literal_prefix("SMO") == ("", False)
    assert literal_prefix("^DM0*1") == ("DM", False)
    assert literal_prefix("^DM0+1") == ("DM0", False)
    assert literal_prefix("^A|B") == ("", False)
    assert literal_prefix("^A(B|C)") == ("A", False)
    assert literal_prefix("^A[|]") == ("A", False)
    assert literal_prefix(r"^A\.B\d") == ("A.B", False)
    assert literal_prefix("^W[0-9]{5}$") == ("W", False)
    assert literal_prefix("^") == ("", True) and literal_prefix("(?i)^a") == ("", False)
    assert literal_prefix("^AB{0,1}C") == ("A", False) and literal_prefix("^AB$") == ("AB", False)


@pytest.mark.parametrize("pattern", ["^DM0[1-3]", "^SMO", "^DM00?1$", "^(AF|CHD)", "0+1$", "^AST|^AF", r"^S.O\d", "^D+M", "^", "M0"])
def test_str_detect_equals_the_regex(spark, tables01, pattern):
    names = [r[0] for r in tables01.qof.select("indicator").distinct().collect()] + ["", "D", "^DM", "xDM001", None]
    df = spark.createDataFrame([(n,) for n in names], "s string")
    got = {r["s"] for r in df.filter(str_detect("s", pattern)).collect()}
    assert got == {n for n in names if n is not None and re.search(pattern, n)}


def test_str_detect_pushes_anchored_prefixes_only(tables01):
    assert "StringStartsWith(indicator,DM0)" in _formatted(rates.indicator_rows(tables01.qof, "^DM0[1-3]"))
    smo = _formatted(rates.indicator_rows(tables01.qof, "^SMO"))
    assert "StringStartsWith(indicator,SMO)" in smo and "RLIKE" not in smo
    assert "StringStartsWith" not in _formatted(rates.indicator_rows(tables01.qof, "DM0"))


# --- areas from the given table ---

def test_overlapping_areas_count_as_the_stacked_filters_do(spark):
    areas = [(0, "D", "All of D"), (1, "DM", "Diabetes"), (2, "DM0", "Diabetes"), (3, "DEM", "Dementia"), (4, "DM", "Again"),
             (5, "X", "Nothing"), (6, "DM001LONG", "Long")]
    q = b.qof(spark, [("WAL", "DM001", 5, 10), ("WAL", "DM1", 7, 10), ("WALX", "DEM01", 2, 9), ("WAL", "D", 1, 9),
                      ("W00001", "DM001", 50, 10), ("WAL", None, 3, 9), ("WAL", "DM001LONGER", 11, 9), ("WAL", "", 4, 9)])
    one = register.disease_register(q, register.area_table(spark, areas))
    stacked = register.disease_register_union(q, areas)
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, stacked.collect()))
    assert one.columns == stacked.columns


# --- ordered, committed results ---

def test_written_results_are_ordered_and_whole(spark, tmp_path):
    from gpsight.session import checkpoint_dir, materialize
    from gpsight.sources.sink import ordered_rows, write_ordered
    rows = [(random.Random(i).randrange(500), i) for i in range(5000)] + [(None, -1)]
    df = materialize(spark.createDataFrame(rows, "k int, v int").repartition(9), "to-order")
    out = str(tmp_path / "result")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several files of this little
    try:
        write_ordered(df, out, ["k"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted(f for f in os.listdir(out) if f.endswith(".parquet"))
    read = [r for f in parts for r in zip(*(pq.read_table(f"{out}/{f}")[c].to_pylist() for c in ("k", "v")))]
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert read == want and len(parts) > 1
    assert [tuple(r) for r in ordered_rows(df, ["k"])] == want
    write_ordered(df.limit(3), out, clean=True)  # replaced as a whole, copies removed
    assert spark.read.parquet(out).count() == 3
    assert os.listdir(tmp_path) == ["result"]
    left = f"{checkpoint_dir(spark).removeprefix('file:')}/gpsight-materialized/{spark.sparkContext.applicationId}"
    assert not any(f.startswith("to-order") for f in os.listdir(left))


def test_a_failed_write_leaves_the_older_result(spark, tmp_path):
    from gpsight.sources.sink import write_ordered
    out = str(tmp_path / "result")
    write_ordered(spark.range(4).toDF("k"), out)
    with pytest.raises(Exception):
        write_ordered(spark.range(9).select(F.assert_true(F.col("id") < 5).alias("k")), out)
    assert spark.read.parquet(out).count() == 4 and os.listdir(tmp_path) == ["result"]


# --- NA policy by origin: what the original adds up in SQL skips, what it adds up in R propagates ---

def test_sql_sums_skip_and_r_sums_propagate(spark):
    r = b.rx(spark, [("W1", "201501", "0601011", "Insulin", 4, 6, 1), ("W1", "201501", "x", "y", None, None, 2),
                     ("W1", "201502", "x", "y", 4, 4, None)])
    q = b.qof(spark, [("W1", "DM001", 5, 10), ("W1", "AF001", 1, None)])
    a = b.address(spark, [("W1", "n", "CF1")])
    # SQL: quantity and net ingredient cost
    assert drugs.total_quantity_by_practice(r).first()["total_drugs_prescribed"] == 8
    for na in ("skip", "propagate"):
        assert drugs.drug_share(r, drugs.is_insulin(), "s", na=na).first()["s"] == 0.5
        assert correlate.diabetes_insulin_pairs(r, q, na=na).first()["rate_insulin"] == 0.5
        assert profile.practice_profile(r, q, a, na=na).first()["total_costs"] == 10
    # R: quantities of the drug's rows, list sizes, monthly cost
    unknown = b.rx(spark, [("W1", "201501", "0601011", "Insulin", None, 1, 1), ("W1", "201501", "x", "y", 8, 1, 1)])
    assert drugs.drug_share(unknown, drugs.is_insulin(), "s", na="propagate").first()["s"] is None
    assert spend.spend_per_patient(r, q, a).first()["total_pop"] == 10
    assert spend.spend_per_patient(r, q, a, na="propagate").first()["spend_per_patient"] is None
    assert spend.area_peers_of(r, q, a, "W1", na="propagate").first()["total_pop"] is None
    months = {str(x["month"]): x for x in spend.monthly_cost_per_patient(r, q.filter("field4 IS NOT NULL"), na="propagate").collect()}
    assert months["2015-01-01"]["avg_cost"] == 0.0 and months["2015-02-01"]["avg_cost"] is None
    assert all(x["avg_cost"] is None for x in spend.monthly_cost_per_patient(r, q, na="propagate").collect())
