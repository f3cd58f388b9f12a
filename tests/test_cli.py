"""The batch entry point runs the original scripts' analyses for one practice."""

from __future__ import annotations

import pyarrow.parquet as pq

from conftest import SF01
from gpsight.__main__ import main


def test_cli_writes_every_report(spark, tmp_path):
    out = tmp_path / "out"
    results = main(["--testdata", SF01, "--practice", "W00004", "--out", str(out)], spark=spark)
    assert set(results) == {"checks", "profile", "area_peers", "rate_vs_national",
                            "cor_diabetes_insulin", "cor_diabetes_metformin", "disease_register"}
    checks = pq.read_table(out / "checks").to_pylist()
    assert checks == [{"practiceid": "W00004", "is_valid": True, "has_med": True,
                       "has_qof": True, "has_both": True}]
    assert pq.read_table(out / "profile").num_rows == 1
    assert pq.read_table(out / "rate_vs_national").num_rows == 2
    assert pq.read_table(out / "disease_register").num_rows == 19
    assert pq.read_table(out / "cor_diabetes_metformin").column("n").to_pylist() == [100]


def test_cli_prints_reports(spark, capsys):
    from conftest import SF001
    main(["--testdata", SF001, "--practice", "W00004"], spark=spark)
    out = capsys.readouterr().out
    for name in ("checks", "profile", "area_peers", "rate_vs_national", "disease_register"):
        assert f"== {name}" in out
    assert "W00004" in out
