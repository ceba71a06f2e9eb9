import json
import shutil

import pytest

from basemill import __main__ as cli
from basemill.plans import published, run
from tests.test_run import fastq


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("runs")
    reads = ["ACGTACGTAC", "ACGTACGTAC", "GGCATCCCAA", "ACGTTN", "TTGACCATGA" * 6] * 40  # quartiles need 100 reads
    return spark, run.process_sample(spark, "s", fastq(folder / "a.fq", reads), None, str(folder / "out")), folder / "out"


@pytest.fixture
def own(made, tmp_path):
    shutil.copytree(made[2], tmp_path / "out")
    return made[0], tmp_path / "out"


def status(spark, folder):
    return {e["metric_id"]: (e["status"], e.get("code")) for e in published.evaluate_run(spark, str(folder))["evaluations"]}


def test_same_as_from_reads(made):
    spark, _, out = made
    direct = {(e["read"], e["metric_id"]): e for e in json.loads((out / "qc_evaluation.json").read_text())["evaluations"]}
    again = published.evaluate_run(spark, str(out))["evaluations"]
    assert len(again) == len(direct) == 8
    for e in again:
        d = direct[e["read"], e["metric_id"]]
        assert e["status"] == d["status"] and "code" not in e
        for k, x in e["observations"].items():
            assert x == pytest.approx(d["observations"][k], abs=1e-3)


def test_undeclared_absent_broken(own):
    spark, out = own
    sound = status(spark, out)
    manifest = json.loads((out / "run_manifest.json").read_text())
    manifest["artifacts"].remove("qc/per_base_n_content_s_SE.tsv")
    (out / "run_manifest.json").write_text(json.dumps(manifest))
    (out / "qc/adapter_content_s_SE.tsv").unlink()
    (out / "qc/.s_SE_duplication.incomplete").touch()
    found = status(spark, out)
    wrong = {"per_base_n_content": "source_not_published", "adapter_content": "source_not_found", "sequence_duplication_levels": "data_invalid"}
    assert found == {k: ("not_evaluated", wrong[k]) if k in wrong else v for k, v in sound.items()}


@pytest.mark.parametrize(
    ("metric", "rows", "fault"),
    [
        ("sequence_length_distribution", "length\treads\n4\t1\n4\t2\n", "rise"),
        ("sequence_length_distribution", "length\treads\n4\t1.5\n", "whole"),
        ("sequence_length_distribution", "length\treads\n4\t-1\n", "negative"),
        ("sequence_length_distribution", "length\treads\n", "no rows"),
        ("sequence_length_distribution", "length\treads\n4\t0\n", "no length"),
        ("sequence_length_distribution", "length\tlength\n4\t0\n", "repeated"),
        ("sequence_length_distribution", "length\treads\n4\t0\t1\n", "columns of the header"),
        ("per_base_n_content", "position\tN_percent\n1\t100.5\n", "above 100"),
        ("per_base_n_content", "position\tN_percent\n1\tnan\n", "finite"),
        ("per_base_n_content", "position\tother\n1\t1\n", "no column"),
        ("per_base_n_content", "position\tN_percent\tother\n1\t1\t1\n", "doesn't have"),
        ("per_base_sequence_content", "position\tA\tC\tG\tT\tN\n1\t50\t20\t0\t0\t0\n", "sum to 100"),
        ("per_sequence_gc_content", "gc_percent\traw_read_count\tfastqc_observed_count\n1\t1\t1\n", "bins"),
        ("per_base_quality", "cycle\tmean_quality\tlower_quartile\tmedian\n1-5\t30\t30\t30\n5\t1\t1\t1\n", "rise"),
    ],
)
def test_invariants(spark, tmp_path, metric, rows, fault):
    (tmp_path / f"{published.KINDS[metric].name}_s_SE.tsv").write_text(rows)
    with pytest.raises(published.Unsound, match=fault):
        published.metric_observations(spark, str(tmp_path), "s", "SE", metric)


def test_gaps_are_left_out(spark, tmp_path):
    (tmp_path / "per_cycle_s_SE.tsv").write_text("cycle\tmean_quality\tlower_quartile\tmedian\n1\tnan\tnan\tnan\n2-6\t30\t28\t31\n")
    assert published.metric_observations(spark, str(tmp_path), "s", "SE", "per_base_quality") == {"minimum_lower_quartile": 28, "minimum_median": 31}


def test_duplication_agrees(own):
    _, out = own
    path = out / "qc/sequence_duplication_summary_s_SE.tsv"
    head, row = path.read_text().splitlines()
    levels = published.read_metric(str(out / "qc/sequence_duplication_levels_s_SE.tsv"), published.KINDS["sequence_duplication_levels"])
    assert published.remaining_percent(str(out / "qc"), "s", "SE", levels) == pytest.approx(2)
    cells = row.split("\t")
    for place, value, fault in ((3, "40", "another method"), (5, "6", "add up"), (6, "81", "add up")):
        path.write_text(f"{head}\n" + "\t".join([*cells[:place], value, *cells[place + 1 :]]) + "\n")
        with pytest.raises(published.Unsound, match=fault):
            published.remaining_percent(str(out / "qc"), "s", "SE", levels)


@pytest.mark.parametrize(("key", "value"), [("schema_version", 2), ("run_id", " "), ("reads", ["R2"]), ("artifacts", ["a", "a"]), ("artifacts", ["/a"]), ("artifacts", ["../a"]), ("artifacts", "a")])
def test_manifest(tmp_path, key, value):
    sound = {"schema_version": 1, "run_id": "r", "sample_id": "s", "reads": ["SE"], "artifacts": ["a"]}
    path = tmp_path / "run_manifest.json"
    path.write_text(json.dumps(sound))
    assert published.read_manifest(str(path)) == sound
    path.write_text(json.dumps(sound | {key: value}))
    with pytest.raises(published.Unsound):
        published.read_manifest(str(path))


def test_command_line(own, capsys):
    _, out = own
    assert cli.main(["--timing", "evaluate", str(out), "--output", str(out / "e.json")]) == 0
    assert json.loads((out / "e.json").read_text())["summary"]["not_evaluated"] == 0
    assert "work_seconds" in capsys.readouterr().err
    assert cli.main(["report", str(out)]) == 0 and "<table>" in (out / "report.html").read_text()
    assert cli.main(["evaluate", str(out / "qc")]) == 2


def test_publish_puts_the_old_run_back(tmp_path):
    (tmp_path / "out").mkdir()
    (tmp_path / "out/a").touch()
    with pytest.raises(OSError):
        run.publish(str(tmp_path / "none"), str(tmp_path / "out"))
    assert (tmp_path / "out/a").exists()
