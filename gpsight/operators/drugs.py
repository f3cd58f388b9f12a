"""Share of one drug group in a practice's prescribing.

The analysed code reads the matching prescriptions, sums their quantity per practice,
reads the total quantity per practice with a second query and inner-joins the two. Both
sides group the same table by the same key, so one conditional aggregation gives the same
rows: ``sum(quantity if match)``, ``sum(quantity)`` and ``count_if(match)``; practices with
no matching row (absent after the inner join) are removed by ``count_if > 0``. One scan,
one shuffle of partial aggregates, no join. The two-scan form is kept for equivalence tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gpsight.functions.expr import ratio, starts_with, starts_with_ci, sum_na, sum_where
from gpsight.operators.keys import join_on

# The stored column of ``gpsight.sources.tables`` that holds the drug's name in lower case.
FOLDED_NAME = "bnfname_folded"

# The drug groups of the analysed code — insulin by BNF code prefix, metformin
# by a case-insensitive drug-name prefix.
INSULIN_BNF_PREFIX = "060101"
METFORMIN_NAME_PREFIX = "metformin"


def is_insulin(rx_bnfcode: str = "bnfcode") -> Column:
    return starts_with(rx_bnfcode, INSULIN_BNF_PREFIX)


def is_metformin(rx_bnfname: str = "bnfname") -> Column:
    return starts_with_ci(rx_bnfname, METFORMIN_NAME_PREFIX)


def drug_rows(rx: DataFrame, predicate: Column) -> DataFrame:
    """Prescriptions matching ``predicate`` (``where bnfcode like '060101%'`` and the like)."""
    return rx.filter(predicate)


def name_prefix_rows(rx: DataFrame, rx_folded: DataFrame | None, prefix: str) -> DataFrame:
    """``where lower(bnfname) like 'prefix%'``.

    With the stored folded name (``PracticeTables.rx_folded``) the test is a plain prefix that reaches
    the scan and skips row groups by their min/max; otherwise every name is folded.
    """
    if rx_folded is None:
        return rx.filter(starts_with_ci("bnfname", prefix))
    return rx_folded.filter(starts_with(FOLDED_NAME, prefix.lower())).select(*rx.columns)


def total_quantity_by_practice(rx: DataFrame) -> DataFrame:
    """(practiceid, total_drugs_prescribed): total quantity per practice.

    A sum of the original's SQL, so missing quantities are skipped; it has no NA policy.
    """
    return rx.groupBy("practiceid").agg(F.sum("quantity").alias("total_drugs_prescribed"))


def drug_quantity(rx: DataFrame, predicate: Column, name: str, na: str = "skip") -> DataFrame:
    """(practiceid, <name>): quantity of the matching prescriptions per practice."""
    return drug_rows(rx, predicate).groupBy("practiceid").agg(sum_na("quantity", na).alias(name))


def drug_share(rx: DataFrame, predicate: Column, name: str, na: str = "skip") -> DataFrame:
    """(practiceid, <name>): matching quantity / total quantity, practices with a match only.

    ``na`` is the policy of the matching quantity, which the original adds up in R; the total
    comes from its SQL and skips missing quantities.
    """
    return (rx.groupBy("practiceid")
            .agg(sum_where(predicate, "quantity", na).alias("_drug"),
                 F.sum("quantity").alias("_total"),
                 F.count_if(predicate).alias("_matches"))
            .filter(F.col("_matches") > 0)
            .select("practiceid", ratio("_drug", "_total").alias(name)))


def drug_share_two_scans(rx: DataFrame, predicate: Column, name: str, na: str = "skip") -> DataFrame:
    """The same share as written: matching sum INNER JOIN total sum."""
    drug = drug_quantity(rx, predicate, "_drug", na)
    total = total_quantity_by_practice(rx)
    return (join_on(drug, total)
            .select("practiceid", ratio("_drug", "total_drugs_prescribed").alias(name)))


def drug_shares(rx: DataFrame, groups: dict[str, Column]) -> DataFrame:
    """Several shares in one pass: (practiceid, <name>... ) with NULL where a group is absent."""
    aggs = [F.sum("quantity").alias("_total")]
    for name, predicate in groups.items():
        aggs.append(F.sum(F.when(predicate, F.col("quantity"))).alias(f"_{name}"))
        aggs.append(F.count_if(predicate).alias(f"_{name}_n"))
    grouped = rx.groupBy("practiceid").agg(*aggs)
    return grouped.select(
        "practiceid",
        *[F.when(F.col(f"_{name}_n") > 0, ratio(f"_{name}", "_total")).alias(name)
          for name in groups],
    )
