"""Command line: run the study on an answers file, or the models on an analysis table.

    spark-submit -m panelstats --answers answers.csv --out results/  [model options]
    python -m panelstats --analysis analysis.csv --out results/ --reg-param 0.1

With ``--answers`` the whole study runs (wrangle, analysis table, reports,
regression, association analyses); with ``--analysis`` an existing analysis
table is read and the descriptive report and the regression run, as the
model job of the study did.  Large tables are written as parquet, reports as
small CSV files.  Invalid options exit with status 1.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession

from .operators.model import RegressionParams
from .plans import questionnaire as q
from .sources.io import ANSWERS_SCHEMA, read_csv, read_table, write_table


def _bool(s: str) -> bool:
    if s.lower() in ("true", "1", "yes"):
        return True
    if s.lower() in ("false", "0", "no"):
        return False
    raise argparse.ArgumentTypeError(f"not a boolean: {s}")


def parse(argv: list[str]) -> tuple[argparse.Namespace, RegressionParams]:
    d = RegressionParams()
    p = argparse.ArgumentParser(prog="panelstats", description="Panel questionnaire analysis on Spark")
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--answers", help="long answers table (one row per answered question)")
    src.add_argument("--analysis", help="analysis table written by an earlier run")
    p.add_argument("--format", default="csv", choices=["csv", "parquet"], help="input format (default csv)")
    p.add_argument("--out", required=True, help="output folder")
    p.add_argument("--min-assessments", type=int, default=25,
                   help="keep participants with more than this many assessments (default 25)")
    p.add_argument("--elastic-net", type=float, default=d.elasticNetParam)
    p.add_argument("--fit-intercept", type=_bool, default=d.fitIntercept)
    p.add_argument("--max-iter", type=int, default=d.maxIter)
    p.add_argument("--reg-param", type=float, default=d.regParam)
    p.add_argument("--standardization", type=_bool, default=d.standardParam)
    p.add_argument("--tol", type=float, default=d.tol)
    p.add_argument("--frac-test", type=float, default=d.fracTest, help="held-out fraction, in [0.1, 1)")
    p.add_argument("--seed", type=int, default=d.seed)
    a = p.parse_args(argv)
    params = RegressionParams(elasticNetParam=a.elastic_net, fitIntercept=a.fit_intercept, maxIter=a.max_iter,
                              regParam=a.reg_param, standardParam=a.standardization, tol=a.tol,
                              fracTest=a.frac_test, seed=a.seed)
    return a, params


def _report(frames: dict[str, DataFrame], out: str, prefix: str) -> None:
    for name, df in frames.items():
        safe = "".join(ch if ch.isalnum() or ch in "-_" else "_" for ch in name)
        write_table(df, os.path.join(out, f"{prefix}{safe}"), fmt="csv", single_file=True)


def main(argv: list[str] | None = None) -> int:
    try:
        args, params = parse(sys.argv[1:] if argv is None else argv)
    except ValueError as e:
        print(f"panelstats: {e}", file=sys.stderr)
        return 1
    spark = SparkSession.builder.appName("panelstats").getOrCreate()
    if args.answers:
        answers = (read_csv(spark, args.answers, schema=ANSWERS_SCHEMA) if args.format == "csv"
                   else read_table(spark, args.answers))
        res = q.run_study(answers, params, args.min_assessments)
        write_table(res["wide"], os.path.join(args.out, "wide"))
        write_table(res["analysis"], os.path.join(args.out, "analysis"))
        analysis = res["analysis"]
        _report(res["association"], args.out, "association_")
    else:
        analysis = (read_csv(spark, args.analysis) if args.format == "csv" else read_table(spark, args.analysis))
        res = {"describe": q.describe_report(analysis), "regression": q.regression_job(analysis, params)}
    _report(res["describe"], args.out, "describe_")
    _report(res["regression"], args.out, "regression_")
    print(f"panelstats: {analysis.count()} analysis rows; results in {args.out}")
    return 0


if __name__ == "__main__":
    sys.exit(main())
