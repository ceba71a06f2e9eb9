"""Command line: ``python -m basemill run|sheet|evaluate|report``. 0 done, 1 a sample failed, 2 nothing could be done."""

from __future__ import annotations

import argparse
import json
import sys
import time

from pyspark.sql import SparkSession

from .operators.trimming import TrimConfig
from .plans import published, run
from .sources import tables


def arguments() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="basemill", description="Quality control and trimming of reads.")
    out.add_argument("--timing", action="store_true", help="seconds taken, as one JSON line on stderr")
    parts = out.add_subparsers(dest="command", required=True)
    one = parts.add_parser("run", help="one sample")
    one.add_argument("r1")
    one.add_argument("r2", nargs="?")
    one.add_argument("--sample", required=True)
    sheet = parts.add_parser("sheet", help="all samples of a sheet; without --out it is only checked")
    sheet.add_argument("sheet")
    for p in (one, sheet):
        p.add_argument("--out", required=p is one)
        p.add_argument("--trim", action="store_true", help="the full trimming profile")
        p.add_argument("--min-length", type=int, help="shortest read that the profile keeps")
    evaluate = parts.add_parser("evaluate", help="evaluate the published tables of a run")
    report = parts.add_parser("report", help="write the page of a run from its published tables")
    for p in (evaluate, report):
        p.add_argument("folder")
        p.add_argument("--tables", help="folder of the tables within the run")
        p.add_argument("--output", help="path of the result")
    for p in (one, sheet, evaluate, report):
        p.add_argument("--ruleset", help="JSON ruleset in place of the standard one")
    return out


def main(argv: list[str] | None = None) -> int:
    a = arguments().parse_args(argv)
    began = time.perf_counter()
    spark = SparkSession.builder.appName("basemill").getOrCreate()
    started = time.perf_counter()
    try:
        if a.command in ("run", "sheet"):
            config = TrimConfig.full(**({} if a.min_length is None else {"min_length": a.min_length})) if a.trim else None
            code = run.run_sheet(spark, a.sheet, a.out, config, a.ruleset) if a.command == "sheet" else 0
            if a.command == "run":
                print(json.dumps(run.process_sample(spark, a.sample, a.r1, a.r2, a.out, config, a.ruleset)))
        else:
            code = 0
            found = published.evaluate_run(spark, a.folder, a.tables, tables.read_ruleset(a.ruleset)[0] if a.ruleset else None)
            page = a.command == "report"
            path = a.output or f"{a.folder}/{'report.html' if page else 'qc_evaluation.json'}"
            sample = published.read_manifest(f"{a.folder}/run_manifest.json")["sample_id"] if page else ""
            run.write_atomically(path, run.report_html(sample, found) if page else json.dumps(found, indent=2) + "\n")
            print(path)
    except (OSError, ValueError) as e:
        print(f"basemill: {e}", file=sys.stderr)
        code = 2
    if a.timing:
        print(json.dumps({"session_seconds": round(started - began, 3), "work_seconds": round(time.perf_counter() - started, 3)}), file=sys.stderr)
    return code


if __name__ == "__main__":
    sys.exit(main())
