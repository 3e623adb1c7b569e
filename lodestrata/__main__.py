"""Command line: scan a repository, analyze a stored history, or all of a folder."""

from __future__ import annotations

import argparse
import datetime as dt
import json
import sys
import traceback

from pyspark.sql import SparkSession

from lodestrata.operators.features import latest_commits, split_timestamp
from lodestrata.plans import report
from lodestrata.session import build_session
from lodestrata.sources import files
from lodestrata.sources.config import load_config
from lodestrata.sources.ingest import ingest

#: Where `analyze-all` looks for histories if no folder is named.
HOME = "scan"


def epoch(date: str) -> int:
    """Seconds of a day's start in UTC."""
    return int(dt.datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=dt.UTC).timestamp())


def _split(spark: SparkSession, folder: str, at: str | None, fraction: float | None) -> int | None:
    if at:
        return epoch(at)
    if fraction:
        commits = spark.read.parquet(f"{files.history_folder(spark, folder)}/commits.parquet")
        return split_timestamp(latest_commits(commits), fraction).first().split_ts
    return None


def _stored_history(spark: SparkSession, target: str) -> str | None:
    """The history that a target means: itself, or the one that a scan of it has written beside it."""
    for folder in (target.rstrip("/"), history_of(target)):
        if files.exists(spark, f"{files.history_folder(spark, folder)}/commits.parquet"):
            return folder
    return None


def history_of(repo: str) -> str:
    return f"{repo.rstrip('/')}-history"


def run_scan(spark: SparkSession, args: argparse.Namespace) -> int:
    out = args.out or history_of(args.repo)
    if args.fresh and files.exists(spark, f"{out}/meta.json"):
        files.remove(spark, out)
    ingest(
        spark, args.repo, out, load_config(args.config, args.ignore), since=args.since, until=args.until, max_count=args.max_commits,
        want_units=not args.no_units, want_szz=not args.no_szz, wmc_context=args.wmc_context, progress_path=args.progress_file,
    )
    print(f"history: {out}")
    return 0


def run_analyze(spark: SparkSession, args: argparse.Namespace) -> int:
    folder = _stored_history(spark, args.folder)
    if folder is None:
        print(f"no stored history at {args.folder}: scan it first", file=sys.stderr)
        return 2
    split = _split(spark, folder, args.split_at, args.split_frac)
    meta = json.loads(files.read_text(spark, f"{folder}/meta.json") or "{}")
    repo = meta.get("repo_path") if files.exists(spark, f"{meta.get('repo_path', folder)}/.git") else None
    report.analyze(spark, folder, args.out or f"{folder}-report", split_ts=split, exclude_tests=not args.include_tests, repo=repo)
    return 0


def run_analyze_all(spark: SparkSession, args: argparse.Namespace) -> int:
    found = sorted({*files.folders_with(spark, f"{args.folder}/*/commits.parquet"), *files.folders_with(spark, f"{args.folder}/*/{files.CURRENT}")})
    failed = 0
    for folder in [] if args.summary_only else found:
        try:
            split = None if args.concurrent else _split(spark, folder, args.split_at, args.split_frac)
            report.analyze(spark, folder, f"{folder}-report", split_ts=split, exclude_tests=not args.include_tests)
        except Exception:  # noqa: BLE001 - one bad history does not stop the others
            failed += 1
            print(f"{folder}:\n{traceback.format_exc()}", file=sys.stderr)
    if not files.folders_with(spark, f"{args.folder}/*-report/stats.json"):
        print(f"no reports under {args.folder}", file=sys.stderr)
        return 2
    report.summarize(spark, f"{args.folder}/*-report/stats.json", args.out or args.folder)
    return 1 if failed else 0


def arguments() -> argparse.ArgumentParser:
    """The commands. The names of commands and options, which users' scripts give."""
    parser = argparse.ArgumentParser(prog="lodestrata")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("analyze", help="statistics and report of a stored history")
    many = commands.add_parser("analyze-all", help="reports of all histories in a folder, and a summary")
    scan = commands.add_parser("scan", help="read a git repository into Parquet relations")
    for command, run in ((one, run_analyze), (many, run_analyze_all), (scan, run_scan)):
        command.set_defaults(run=run)
        command.add_argument("--out")
    one.add_argument("folder")
    many.add_argument("folder", nargs="?", default=HOME)
    scan.add_argument("repo")
    for command, fraction in ((one, None), (many, 0.75)):
        command.add_argument("--split-at", metavar="YYYY-MM-DD")
        command.add_argument("--split-frac", type=float, default=fraction)
        command.add_argument("--include-tests", action="store_true")
    for flag in ("--concurrent", "--summary-only"):
        many.add_argument(flag, action="store_true")
    for flag in ("--fresh", "--no-units", "--no-szz"):
        scan.add_argument(flag, action="store_true")
    for option in ("--config", "--since", "--progress-file"):
        scan.add_argument(option)
    scan.add_argument("--until", default="HEAD")
    scan.add_argument("--max-commits", type=int)
    scan.add_argument("--ignore", action="append", default=[])
    scan.add_argument("--wmc-context", choices=("before", "after"), default="before")
    return parser


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    return args.run(build_session(), args)


if __name__ == "__main__":
    raise SystemExit(main())
