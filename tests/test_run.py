import json

import pytest

from basemill.operators import metrics as M
from basemill.operators import trimming as T
from basemill.plans import run
from basemill.streaming import landing


def fastq(path, reads, mate=""):
    path.write_text("".join(f"@r{i}{mate}\n{s}\n+\n{'I' * len(s)}\n" for i, s in enumerate(reads)))
    return str(path)


def test_sample(spark, tmp_path):
    r1 = fastq(tmp_path / "a.fq", ["ACGTACGTAC", "ACGTAC", "GGGGCCCCAA", "AC"], "/1")
    r2 = fastq(tmp_path / "b.fq", ["ACGTACGTAC", "ACGTACGGGG", "GGGGCCCCAA", "ACGTACGTAA"], "/2")
    done = run.process_sample(spark, "s", r1, r2, str(tmp_path / "out"), T.TrimConfig(min_length=4, poly_g=4))
    assert done["qc_status"] == "passed"
    report = json.loads((tmp_path / "out/trimming_report.json").read_text())
    assert report["reads"] == {"total": 8, "passed": 7, "discarded": 1} and report["output"]["passed_pairs"] == 3
    manifest = json.loads((tmp_path / "out/run_manifest.json").read_text())
    assert manifest["reads"] == ["R1", "R2"] and "qc/after/per_cycle_s_R1.tsv" in manifest["artifacts"]
    lines = (tmp_path / "out/qc/before/sequence_length_distribution_s_R1.tsv").read_text().splitlines()
    assert lines == ["length\treads", "2\t1", "6\t1", "10\t2"]
    assert json.loads((tmp_path / "out/qc_evaluation.json").read_text())["summary"]["overall"] in ("warning", "fail")


def test_mates_differ(spark, tmp_path):
    r1, r2 = fastq(tmp_path / "a.fq", ["ACGT", "ACGT"], "/1"), fastq(tmp_path / "b.fq", ["ACGT"], "/2")
    with pytest.raises(ValueError, match="r2_missing"):
        run.process_sample(spark, "s", r1, r2, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() and len(list(tmp_path.iterdir())) == 2


def test_sheet(spark, tmp_path):
    good, bad = fastq(tmp_path / "a.fq", ["ACGT"] * 3), tmp_path / "b.fq"
    bad.write_text("@r\nACGT\n+\nIII\n")
    sheet = tmp_path / "s.csv"
    head = "patient_id,sample_id,sample_role,material,r1,r2,platform,library_type,reference\n"
    sheet.write_text(head + f"P1,N1,normal,dna,{good},,x,wes,GRCh38\nP2,N2,normal,dna,{bad},,x,wes,GRCh38\n")
    assert run.run_sheet(spark, str(sheet)) == 0
    assert run.run_sheet(spark, str(sheet), str(tmp_path / "o")) == 1
    assert json.loads((tmp_path / "o/P1/case_summary.json").read_text())["status"] == "passed"
    assert json.loads((tmp_path / "o/P2/case_summary.json").read_text())["status"] == "failed"
    for line, fault in ((f",S,normal,dna,{good},,x,wes,G", "patient_id"), (f"P,S,tumor_rna,dna,{good},,x,wes,G", "material rna"), (f"P,S,tumor,dna,{good},,x,wes,G", "normal DNA"), (f"P,S,normal,dna,{good},{good},x,wes,G", "twice")):
        sheet.write_text(head + line + "\n")
        with pytest.raises(ValueError, match=fault):
            run.run_sheet(spark, str(sheet))


def test_stream(spark, tmp_path):
    row = lambda i, s: (i, "R1", "@r", s, "+", "I" * len(s))
    for k, reads in enumerate((["ACGT", "AC"], ["ACGT"])):
        spark.createDataFrame([row(i, s) for i, s in enumerate(reads)], landing.SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
        q = landing.running_metric(landing.landing_reads(spark, str(tmp_path / "in")), M.length_distribution, f"lengths{k}", str(tmp_path / f"c{k}"))
        q.awaitTermination()
        got = {r.length: r["reads"] for r in spark.table(f"lengths{k}").collect()}
    assert got == {4: 2, 2: 1}
