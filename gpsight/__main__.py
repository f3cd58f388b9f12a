"""Run the analyses of the original scripts as one batch job.

    python -m gpsight --testdata /root/testdata/sf0.01 --practice W00004
    python -m gpsight --tables /data/gp --practice W00004 --out /data/out

``--tables`` reads stored practice tables (gp_data_up_to_2015/, qof_achievement/, address/);
``--testdata`` builds them from the driver's test tables. For the chosen practice: the id
and data checks, the profile row, its postcode-area peers and the comparison with the
national rate; then, over all practices, both correlation tests and the disease register.
With ``--out`` each result is written as Parquet under that folder, in the order of its columns
and complete or not at all; otherwise the results are printed row by row, as the original
scripts print them. Intermediate copies are removed at the end.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from gpsight.operators import correlate, profile, rates, register, spend, validate
from gpsight.session import build_session, remove_written
from gpsight.sources.sink import ordered_rows, write_ordered
from gpsight.sources.store import practice_tables
from gpsight.sources.tables import read_parquet_tables


def reports(spark: SparkSession, tables, practice: str) -> dict[str, DataFrame]:
    ids = spark.createDataFrame([(practice,)], "practiceid string")
    return {
        "checks": validate.check_practices(ids, tables.rx, tables.qof),
        "profile": profile.one_practice_profile(tables.rx, tables.qof, tables.address, practice),
        "area_peers": spend.area_peers_of(tables.rx, tables.qof, tables.address, practice),
        "rate_vs_national": rates.compare_rate(rates.indicator_rate(tables.qof), practice),
        "cor_diabetes_insulin": correlate.cor_diabetes_insulin(tables.rx, tables.qof),
        "cor_diabetes_metformin": correlate.cor_diabetes_metformin(tables.rx, tables.qof),
        "disease_register": register.disease_register(tables.qof, tables.area),
    }


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, DataFrame]:
    parser = argparse.ArgumentParser(prog="python -m gpsight", description=__doc__.split("\n\n")[0])
    source = parser.add_mutually_exclusive_group(required=True)
    source.add_argument("--tables", help="folder with the stored practice tables")
    source.add_argument("--testdata", help="folder with the driver's test tables")
    parser.add_argument("--practice", required=True, help="practice id, e.g. W00004")
    parser.add_argument("--out", help="write each result as Parquet under this folder")
    args = parser.parse_args(argv)

    spark = spark or build_session()
    tables = (read_parquet_tables(spark, args.tables) if args.tables
              else practice_tables(spark, args.testdata))
    results = reports(spark, tables, args.practice)
    try:
        for name, df in results.items():
            if args.out:
                write_ordered(df, f"{args.out.rstrip('/')}/{name}")
            else:
                print(f"== {name}", *df.columns, sep="\t")
                for row in ordered_rows(df):
                    print(*row, sep="\t")
    finally:
        remove_written(spark)
    return results


if __name__ == "__main__":
    main()
