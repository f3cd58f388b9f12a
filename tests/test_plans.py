"""Physical-plan checks: pushdown, pruning, join choice, no Python in the data path."""

from __future__ import annotations

import re

from gpsight.operators import drugs, profile, rates, register, spend


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _formatted(df) -> str:
    jvm = df.sparkSession.sparkContext._jvm
    return jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def executed(df):
    """The nodes that ran for ``df``, its subqueries' included; what a reused exchange repeats isn't run."""
    df.collect()
    todo, stages = [df._jdf.queryExecution().executedPlan()], set()
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        elif name != "ReusedExchangeExec" and not (name == "ShuffleExchangeExec" and node.id() in stages):
            stages |= {node.id()} if name == "ShuffleExchangeExec" else set()
            yield node
            for children in (node.children(), node.subqueries()):
                it = children.iterator()
                while it.hasNext():
                    todo.append(it.next())


def test_practice_filter_reaches_the_scan(tables01):
    plan = _formatted(spend.practice_prescriptions(tables01.rx, "W00004"))
    assert "PushedFilters: [IsNotNull(practiceid), EqualTo(practiceid,W00004)]" in plan


def test_drug_code_prefix_reaches_the_scan(tables01):
    plan = _formatted(drugs.drug_rows(tables01.rx, drugs.is_insulin()))
    assert "StringStartsWith(bnfcode,060101)" in plan


def test_national_prefix_reaches_the_scan(tables01):
    plan = _formatted(register.disease_register(tables01.qof, tables01.area))
    assert "StringStartsWith(orgcode,WAL)" in plan


def test_aggregations_read_only_needed_columns(tables01):
    plan = _formatted(rates.indicator_rate(tables01.qof))
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas == ["struct<orgcode:string,indicator:string,numerator:bigint,field4:bigint>"]
    plan = _formatted(drugs.total_quantity_by_practice(tables01.rx))
    assert re.findall(r"ReadSchema: (struct<[^>]*>)", plan) == [
        "struct<practiceid:string,quantity:double>"]


def test_register_uses_hash_join_not_nested_loop(tables01):
    plan = _formatted(register.disease_register(tables01.qof, tables01.area))
    assert "BroadcastHashJoin" in plan
    assert "NestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_drug_share_is_one_aggregation_without_join(tables01):
    plan = _formatted(drugs.drug_share(tables01.rx, drugs.is_insulin(), "r"))
    assert "Join" not in plan
    assert len(re.findall(r"^\(\d+\) Scan parquet", plan, re.M)) == 1


def test_no_python_in_headline_plans(tables01):
    from gpsight.operators.correlate import cor_diabetes_insulin
    for df in (cor_diabetes_insulin(tables01.rx, tables01.qof),
               profile.practice_profile(tables01.rx, tables01.qof, tables01.address)):
        plan = _formatted(df)
        assert "ArrowEvalPython" not in plan and "BatchEvalPython" not in plan
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


def test_partial_aggregation_before_shuffle(tables01):
    plan = _formatted(spend.total_cost_by_practice(tables01.rx))
    assert "partial_sum" in plan


def _scan_output_rows(spark, df) -> int:
    """Rows the Parquet scan produced for ``df`` (after row-group skipping, before filters)."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        df.collect()
        plan = df._jdf.queryExecution().executedPlan()
        nodes, total = [plan], 0
        while nodes:
            node = nodes.pop()
            if node.nodeName().startswith("Scan parquet"):
                total += node.metrics().apply("numOutputRows").value()
            it = node.children().iterator()
            while it.hasNext():
                nodes.append(it.next())
        return total
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_one_practice_lookup_skips_most_row_groups(spark, tables01):
    from pyspark.sql import functions as F
    total = tables01.rx.count()
    read = _scan_output_rows(spark, tables01.rx.filter(F.col("practiceid") == "W00004"))
    assert read < total / 3
    qof_total = tables01.qof.count()
    national = _scan_output_rows(spark, tables01.qof.filter(F.col("orgcode") == "WAL"))
    assert national < qof_total / 3


def test_written_profile_reads_each_fact_table_once(tables01):
    from gpsight.operators.profile import practice_base
    base_plan = _formatted(practice_base(tables01.rx, tables01.qof, tables01.address))
    scans = re.findall(r"^\(\d+\) Scan parquet.*?\nOutput \[\d+\]: \[([^\]]*)\].*?Location: \w+ \[([^\]]*)\]",
                       base_plan, re.M | re.S)
    folders = sorted(loc.rsplit("/", 1)[-1] for _, loc in scans)
    assert folders == ["address", "gp_data_up_to_2015", "qof_achievement"]
    final_plan = _formatted(profile.practice_profile(tables01.rx, tables01.qof, tables01.address,
                                                     materialize=True))
    assert "gp_data_up_to_2015" not in final_plan  # the final job reads the per-practice table


def test_headline_queries_keep_their_shuffle_counts(spark):
    """Regression guard on the executed (adaptive) plans at sf0.01."""
    from conftest import SF01
    from gpsight.plans.queries import registry

    expected = {"diabetes_rate_by_practice": 1, "insulin_rate": 1, "diabetes_insulin_pairs": 1,
                "spend_per_patient": 1, "disease_register": 1, "avg_monthly_spend": 2,
                # the practices' exchange once, and two global aggregations
                "cor_diabetes_insulin": 3}
    for name, most in expected.items():
        shuffles = sum(node.getClass().getSimpleName() == "ShuffleExchangeExec" for node in executed(registry()[name](spark, SF01)))
        assert shuffles <= most, (name, shuffles)
