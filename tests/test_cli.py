import os

import pytest

from panelstats.__main__ import main, parse
from panelstats.session import shared_dir
from panelstats.sources.io import write_table
from tests.fixtures import answers_frame


def test_frac_test_validation_exits_1():
    assert main(["--analysis", "x.csv", "--out", "o", "--frac-test", "0.05"]) == 1
    assert main(["--analysis", "x.csv", "--out", "o", "--frac-test", "1.0"]) == 1
    _, p = parse(["--analysis", "x.csv", "--out", "o", "--frac-test", "0.1", "--fit-intercept", "false"])
    assert p.fracTest == 0.1 and p.fitIntercept is False


def test_cli_runs_study_then_models_on_written_table(spark):
    src = shared_dir(spark, "cli_answers")
    write_table(answers_frame(spark), src, fmt="csv")
    out = shared_dir(spark, "cli_out")
    assert main(["--answers", src, "--out", out]) == 0
    names = set(os.listdir(out.replace("file:", "")))
    assert {"wide", "analysis", "describe_participants", "regression_coefficients", "association_gamma"} <= names
    analysis_csv = shared_dir(spark, "cli_analysis")
    write_table(spark.read.parquet(os.path.join(out, "analysis")), analysis_csv, fmt="csv")
    out2 = shared_dir(spark, "cli_out2")
    assert main(["--analysis", analysis_csv, "--out", out2, "--reg-param", "0.1"]) == 0
    assert "regression_test_metrics" in set(os.listdir(out2.replace("file:", "")))


def test_requires_a_source():
    with pytest.raises(SystemExit):
        parse(["--out", "o"])
