"""A run over one sample or a sheet of samples: read, check, measure, trim, measure again, evaluate, write, publish.

Only distributions come to the driver; they have at most some hundred rows each, but for over-represented sequences, of
which there are 1000 at most by their definition. Reads stay distributed and are written by partitions.
"""

from __future__ import annotations

import datetime
import hashlib
import html
import json
import os
import secrets
import shutil
from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import adapters as A
from ..operators import metrics as M
from ..operators import pairs as P
from ..operators import rules as R
from ..operators import trimming as T
from ..operators import validation as V
from ..sources import fastq, tables
from ..sources.shared import written


def six(x) -> str:
    """Six significant digits; nan where a value is not evaluated."""
    return "nan" if x is None else f"{x:.6g}"


def fixed(n: int) -> Callable:
    return lambda x: f"{x:.{n}f}"


#: File name, header, columns with their format, of each distribution; made of the profile and the duplication counts.
METRICS: dict[str, tuple[Callable[[DataFrame, DataFrame], DataFrame], list[str], list[tuple[str, Callable]], list[str]]] = {
    "per_cycle": (lambda d, _: M.quality_by_group(M.quality_by_position(M.quality_histogram(d))).withColumn("cycle", F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))),
                  ["cycle", "mean_quality", "lower_quartile", "median"], [("cycle", str), ("mean_quality", six), ("lower_quartile", six), ("median", six)], ["first"]),
    "per_sequence_quality": (lambda d, _: M.read_quality(d), ["mean_quality", "read_count", "read_count_truncate"], [("mean_quality", str), ("read_count", str), ("read_count_truncate", str)], ["mean_quality"]),
    "per_base_sequence_content": (lambda d, _: M.base_content(d), ["position", "A", "C", "G", "T", "N"], [("position", str), *[(f"{b}_percent", six) for b in "acgtn"]], ["position"]),
    "per_base_n_content": (lambda d, _: M.base_content(d), ["position", "N_percent"], [("position", str), ("n_percent", fixed(4))], ["position"]),
    "per_sequence_gc_content": (lambda d, _: M.gc_distribution(d), ["gc_percent", "raw_read_count", "fastqc_observed_count"], [("bin", str), ("reads", str), ("observed", six)], ["bin"]),
    "sequence_length_distribution": (lambda d, _: M.length_distribution(d), ["length", "reads"], [("length", str), ("reads", str)], ["length"]),
    "sequence_duplication_levels": (lambda _, c: M.duplication_levels(c), ["duplication_level", "total_sequences_percent", "deduplicated_sequences_percent"], [("duplication_level", str), ("total_percent", fixed(10)), ("deduplicated_percent", fixed(10))], ["level_index"]),
    "overrepresented_sequences": (lambda _, c: M.overrepresented(c), ["sequence", "count", "percentage"], [("sequence", str), ("reads", str), ("percent", fixed(10))], ["-reads", "sequence"]),
}


def write_atomically(path: str, text: str) -> None:
    with open(f"{path}.tmp", "w", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    os.replace(f"{path}.tmp", path)


def write_metrics(reads: DataFrame, folder: str, sample: str, read: str, source: str = "") -> None:
    """The metric tables of one read direction. The duplication summary comes last; a marker stands until then."""
    os.makedirs(folder, exist_ok=True)
    own = reads.where(F.col("read") == read)
    profile, counts = M.profile(own), written(M.duplication_counts(own), "duplication")
    marker = f"{folder}/.{sample}_{read}_duplication.incomplete"
    open(marker, "w").close()
    for name, (metric, header, columns, order) in METRICS.items():
        rows = [r.asDict() for r in metric(profile, counts).collect()]
        rows.sort(key=lambda r: [-r[c[1:]] if c[0] == "-" else r[c] for c in order])
        write_atomically(f"{folder}/{name}_{sample}_{read}.tsv", "\n".join(["\t".join(header), *["\t".join(f(r[c]) for c, f in columns) for r in rows], ""]))
    names = [n for n, _ in A.for_read(read)]
    content: dict[int, dict[str, float]] = {}
    for r in M.adapter_content(profile).collect():
        content.setdefault(r["position"], {})[r["adapter"]] = r["percent"]
    write_atomically(f"{folder}/adapter_content_{sample}_{read}.tsv", "\n".join(["\t".join(["pos", *names]), *["\t".join([str(p), *[f"{content[p][n]:.4f}" for n in names]]) for p in sorted(content)], ""]))
    basic = M.basic_statistics(profile).first()
    write_atomically(f"{folder}/{sample}_{read}_summary.txt", "".join(f"{k}: {v:.2f}\n" if isinstance(v, float) else f"{k}: {v}\n" for k, v in (basic.asDict() if basic else {}).items()))
    s = M.duplication_summary(counts).first()
    total, unique, left = (s["total_reads"], s["unique_sequences"], 100 * s["unique_sequences"] / s["total_reads"]) if s else (0, 0, 100.0)
    row = ["native_fastq", "exact-prefix-v1", "".join("_" if c in "\t\n\r" else c for c in os.path.basename(source)), "50", str(total), str(unique), f"{left:.10f}"]
    write_atomically(f"{folder}/sequence_duplication_summary_{sample}_{read}.tsv", "source_kind\talgorithm\tsource_fastq\tprefix_length\ttotal_reads\tunique_sequences\tdeduplicated_remaining_percent\n" + "\t".join(row) + "\n")
    os.remove(marker)


def evaluation(reads: DataFrame, ruleset: R.Ruleset, digest: str) -> dict:
    """Statuses of all metrics and reads, with reasons."""
    rows = R.evaluate(R.observations(reads), R.rule_table(reads.sparkSession, ruleset.rules)).orderBy("read", "ord").collect()
    found = []
    for read in sorted({r["read"] for r in rows}):
        for metric in dict.fromkeys(m for m, *_ in ruleset.rules):
            own = [r for r in rows if (r["read"], r["metric_id"]) == (read, metric)]
            known = [R.SEVERITY.index(r["status"]) for r in own if r["status"] != "not_evaluated"]
            status = R.SEVERITY[max(known)] if len(known) == len(own) else "not_evaluated"
            found.append({"read": read, "metric_id": metric, "status": status, "observations": {r["observation"]: r["value"] for r in own}, "reasons": R.reasons(own)})
    counts = {s: sum(e["status"] == s for e in found) for s in (*R.SEVERITY, "not_evaluated")}
    overall = next((s for s in reversed(R.SEVERITY) if counts[s]), "not_evaluated")
    return {"ruleset": {"id": ruleset.id, "version": ruleset.version, "sha256": digest}, "summary": counts | {"overall": overall}, "evaluations": found}


def trimming_report(statistics: dict, positions: dict[int, int]) -> dict:
    """The report of a trimming; its sums are checked first."""
    s = {k: statistics.get(k, 0) for k in ("total_pairs", "passed_pairs", "discarded_pairs", "output_reads", "mate_discarded_reads", "merged_pairs")} | statistics
    if s["passed_reads"] + s["discarded_reads"] != s["total_reads"] or s["bases_before"] - s["bases_after"] != s["bases_trimmed"] or s["passed_pairs"] + s["discarded_pairs"] != s["total_pairs"]:
        raise ValueError("the counts of the trimming don't add up")
    return {
        "reads": {"total": s["total_reads"], "passed": s["passed_reads"], "discarded": s["discarded_reads"]},
        "bases": {"before": s["bases_before"], "after": s["bases_after"], "trimmed": s["bases_trimmed"]},
        "trimming": {
            "quality_trimmed_reads": s["quality_trimmed_reads"], "adapter_trimmed_reads": s["adapter_trimmed_reads"], "polyG_trimmed_reads": s["poly_g_trimmed_reads"], "polyX_trimmed_reads": s["poly_x_trimmed_reads"],
            "corrected_reads": s["corrected_reads"], "corrected_bases": s["corrected_bases"], "merged_pairs": s["merged_pairs"], "umi_processed_reads": s["umi_processed_reads"], "umi_failed_reads": s["umi_failed_reads"], "umi_bases": s["umi_bases"],
        },
        "filtering": {"too_short_reads": s["too_short_reads"]},
        "output": {"reads": s["output_reads"], "mate_discarded_reads": s["mate_discarded_reads"], "total_pairs": s["total_pairs"], "passed_pairs": s["passed_pairs"], "discarded_pairs": s["discarded_pairs"]},
        "adapter_positions": {str(k): v for k, v in sorted(positions.items())},
    }


def report_html(sample: str, evaluated: dict, before_after: list | None = None) -> str:
    """A page with the statuses and, after trimming, the lengths before and after."""
    cell = lambda x: f"<td>{html.escape(str(x))}</td>"
    rows = "".join(f"<tr class='{e['status']}'>{cell(e['read'])}{cell(e['metric_id'])}{cell(e['status'])}{cell('; '.join(e['reasons']))}</tr>" for e in evaluated["evaluations"])
    more = "".join(f"<tr>{''.join(map(cell, r))}</tr>" for r in before_after or [])
    table = f"<h2>Before and after</h2><table><tr><th>read</th><th>length</th><th>before</th><th>after</th><th>delta</th></tr>{more}</table>" if more else ""
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(sample)}</title></head><body><h1>{html.escape(sample)}: {evaluated['summary']['overall']}</h1><table><tr><th>read</th><th>metric</th><th>status</th><th>reasons</th></tr>{rows}</table>{table}</body></html>"


def publish(staging: str, out: str) -> None:
    """Puts a finished folder in its place; if that fails what was published before is there again."""
    old = f"{staging}.old"
    if os.path.exists(out):
        os.rename(out, old)
    try:
        os.rename(staging, out)
    except BaseException:
        if os.path.exists(old):
            os.rename(old, out)
        raise
    shutil.rmtree(old, ignore_errors=True)


def process_sample(spark: SparkSession, sample: str, r1: str, r2: str | None, out: str, config: T.TrimConfig | None = None, ruleset: str | None = None) -> dict:
    """One sample into the folder ``out``, which appears whole or not at all."""
    rules, digest = tables.read_ruleset(ruleset) if ruleset else (R.Ruleset("standard", "1", R.STANDARD), hashlib.sha256(repr(R.STANDARD).encode()).hexdigest())
    for path in filter(None, (r1, r2)):
        if os.path.realpath(path).startswith(os.path.realpath(out) + os.sep):
            raise ValueError("an input lies in the output folder")
    run_id = datetime.datetime.now(datetime.UTC).strftime("%Y%m%dT%H%M%SZ") + "-" + secrets.token_hex(8)
    staging = f"{os.path.dirname(os.path.abspath(out))}/.{os.path.basename(out)}.tmp-{run_id}"
    os.makedirs(staging)
    try:
        scanned = {k: fastq.read_fastq(spark, p).repartition(spark.sparkContext.defaultParallelism).withColumn("read", F.lit(k)) for k, p in zip(("R1", "R2") if r2 else ("SE",), filter(None, (r1, r2)), strict=True)}
        reads = scanned["R1"].unionByName(scanned["R2"]) if r2 else scanned["SE"]
        reads = reads.persist()
        V.first_fault(V.read_faults(reads))
        if r2:
            V.first_fault(V.mate_problems(scanned["R1"], scanned["R2"]))
        sources = {"R1": r1, "R2": r2, "SE": r1}
        before = f"{staging}/qc/before" if config else f"{staging}/qc"
        for k in scanned:
            write_metrics(reads, before, sample, k, sources[k])
        evaluated = evaluation(reads, rules, digest)
        delta = None
        if config:
            if r2:
                pairs = P.trim_pairs(P.join_mates(reads.where("read = 'R1'"), reads.where("read = 'R2'")), config).persist()
                own = P.mates(pairs)
                statistics, kept = P.pair_statistics(pairs).first().asDict(), own.where("pair_passed")
            else:
                own = T.trim_reads(reads, config).persist()
                statistics, kept = T.trim_statistics(own).first().asDict(), own.where("passed")
                statistics["output_reads"] = statistics["passed_reads"]
            positions = {r["position"]: r["reads"] for r in T.adapter_positions(own).collect()}
            write_atomically(f"{staging}/trimming_report.json", json.dumps(trimming_report(statistics, positions), indent=2) + "\n")
            for k in scanned:
                write_metrics(kept, f"{staging}/qc/after", sample, k, sources[k])
                fastq.write_fastq(kept.where(F.col("read") == k).withColumn("separator", F.lit("+")), f"{staging}/trimmed_{k}")
            if r2 and config.merge:
                merged = P.merge_overlaps(P.with_overlap(pairs.where("passed AND merged IS NOT NULL"), config, "last"), "last")
                fastq.write_fastq(merged, f"{staging}/merged")
            evaluated = evaluation(kept, rules, digest)
            a, b = ({(r["read"], r["length"]): r["reads"] for r in M.length_distribution(d).collect()} for d in (reads, kept))
            delta = [(*k, a.get(k, 0), b.get(k, 0), b.get(k, 0) - a.get(k, 0)) for k in sorted(a.keys() | b.keys())]
        write_atomically(f"{staging}/qc_evaluation.json", json.dumps({"reads": sorted(scanned), **evaluated}, indent=2) + "\n")
        write_atomically(f"{staging}/report.html", report_html(sample, evaluated, delta))
        artifacts = sorted(os.path.relpath(f"{d}/{f}", staging) for d, _, fs in os.walk(staging) for f in fs if not f.endswith(".crc"))
        manifest = {"schema_version": 1, "run_id": run_id, "sample_id": sample, "reads": sorted(scanned), "inputs": {k: v for k, v in sources.items() if v and k in scanned}, "trimming": asdict(config) if config else None, "artifacts": artifacts}
        write_atomically(f"{staging}/run_manifest.json", json.dumps(manifest, indent=2) + "\n")
        spark.catalog.clearCache()
        publish(staging, out)
        return {"sample_id": sample, "qc_status": "passed", "overall": evaluated["summary"]["overall"], "run_id": run_id}
    except BaseException:
        shutil.rmtree(staging, ignore_errors=True)
        raise


def run_sheet(spark: SparkSession, sheet: str, out: str | None = None, config: T.TrimConfig | None = None, ruleset: str | None = None) -> int:
    """All samples of a sheet, one after the other; one that fails is recorded and the rest go on. 1 if any failed.

    Without ``out`` the sheet is only checked.
    """
    table = tables.read_sheet(spark, sheet)
    fault = V.sheet_faults(table).orderBy("line").first()
    if fault:
        raise ValueError(f"line {fault['line']}: {fault['fault']}")
    for r in V.case_roles(table).where("status = 'error'").orderBy("patient_id").limit(1).collect():
        raise ValueError(f"patient {r['patient_id']}: tumor DNA needs normal DNA with the same reference")
    rows = table.orderBy("line").collect()  # a sheet is a file that the driver has read
    missing = [p for r in rows for p in (r["r1"], r["r2"]) if p and not os.path.isfile(p)]
    if missing:
        raise ValueError(f"no such file: {missing[0]}")
    if out is None:
        return 0
    cases: dict[str, list[dict]] = {}
    for r in rows:
        folder = f"{out}/{r['patient_id']}"
        os.makedirs(folder, exist_ok=True)
        try:
            done = process_sample(spark, r["sample_id"], r["r1"], r["r2"] or None, f"{folder}/{r['sample_id']}", config, ruleset)
        except Exception as e:  # noqa: BLE001  the next samples go on
            done = {"sample_id": r["sample_id"], "qc_status": "failed", "error": str(e)[:500]}
        cases.setdefault(r["patient_id"], []).append(done | {"role": r["sample_role"]})
    for patient, samples in cases.items():
        status = "passed" if all(s["qc_status"] == "passed" for s in samples) else "failed"
        write_atomically(f"{out}/{patient}/case_summary.json", json.dumps({"patient_id": patient, "status": status, "samples": samples}, indent=2) + "\n")
    return int(any(s["qc_status"] == "failed" for samples in cases.values() for s in samples))
