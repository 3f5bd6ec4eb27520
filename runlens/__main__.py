"""Command line: ``python -m runlens <command> ...`` (submit with spark-submit
on a cluster; the session comes from the cluster's configuration).

  reports  --runs PATH [--csv] [--orthogonal] --out DIR [--format csv|parquet]
  pending  --runs PATH [--csv] [--orthogonal] [--include-failed] --out DIR
  ingest   --raw DIR --table DIR --checkpoint DIR
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from runlens.session import configure


def _runs(spark, args):
    from runlens.sources import files

    return files.read_runs_csv(spark, args.runs) if args.csv else files.read_runs(spark, args.runs)


def cmd_reports(spark, args):
    from runlens.sinks.files import write_orthogonal_reports, write_reports

    write = write_orthogonal_reports if args.orthogonal else write_reports
    for name, path in write(_runs(spark, args), args.out, fmt=args.format).items():
        print(f"{name}\t{path}")


def cmd_pending(spark, args):
    from runlens.operators.reports import with_repeat_idx
    from runlens.plans import design as D
    from runlens.plans import resume as RS

    runs = RS.with_keys_from_names(_runs(spark, args))
    if args.orthogonal:
        designs = D.orthogonal_designs()
        keys = ["group_id", "scene_id", "scheme_key", "model", "temperature"]
        r = with_repeat_idx(runs, keys) if "repeat_idx" not in runs.columns else runs
        done = RS.completed_keys(r, RS.orthogonal_key(), include_failed=args.include_failed)
    else:
        designs = D.exploratory_designs()
        keys = ["scene_id", "model", "scheme", "param_set"]
        r = with_repeat_idx(runs, keys) if "repeat_idx" not in runs.columns else runs
        r = RS.with_design(r)
        done = RS.completed_keys(r, RS.exploratory_key(r), include_failed=args.include_failed)
    plan = D.plan(spark, designs)
    RS.pending(plan, done).write.mode("overwrite").option("header", True).csv(args.out)
    RS.progress(plan, done).show(truncate=False)   # one row per design


def cmd_ingest(spark, args):
    from runlens.streaming.ingest import start_ingest

    start_ingest(spark, args.raw, args.table, args.checkpoint).awaitTermination()


def main(argv=None):
    p = argparse.ArgumentParser(prog="runlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    r = sub.add_parser("reports")
    r.add_argument("--runs", required=True)
    r.add_argument("--csv", action="store_true")
    r.add_argument("--out", required=True)
    r.add_argument("--format", default="csv", choices=["csv", "parquet"])
    r.add_argument("--orthogonal", action="store_true")
    q = sub.add_parser("pending")
    q.add_argument("--runs", required=True)
    q.add_argument("--csv", action="store_true")
    q.add_argument("--orthogonal", action="store_true")
    q.add_argument("--include-failed", action="store_true")
    q.add_argument("--out", required=True)
    i = sub.add_parser("ingest")
    i.add_argument("--raw", required=True)
    i.add_argument("--table", required=True)
    i.add_argument("--checkpoint", required=True)
    args = p.parse_args(argv)
    spark = configure(SparkSession.builder.appName(f"runlens-{args.cmd}").getOrCreate())
    {"reports": cmd_reports, "pending": cmd_pending, "ingest": cmd_ingest}[args.cmd](spark, args)


if __name__ == "__main__":
    main()
