"""Published example values of the read metrics."""

import gzip

import pytest
from pyspark.sql import functions as F

from basemill.functions import expressions as E
from basemill.operators import metrics as M
from basemill.operators import rules as R
from basemill.operators import validation as V
from basemill.sources import fastq


def reads_of(spark, *pairs, read="SE"):
    rows = [(i, read, f"@r{i}", s, "+", q) for i, (s, q) in enumerate(pairs, 1)]
    return spark.createDataFrame(rows, "record_number long, read string, header string, sequence string, separator string, quality string")


def by(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_numeric_regression(spark):
    d = reads_of(spark, ("ACGT", "IIII"), ("GGCC", "5555"), ("NNNN", "!!!!"), ("ATGC", "####"))
    s = M.basic_statistics(d).first()
    assert (s.reads, s.bases, s.min_length, s.max_length, s.avg_length) == (4, 16, 4, 4, 4.0)
    assert (s.n_a, s.n_c, s.n_g, s.n_t, s.n_n) == (2, 4, 4, 2, 4)
    assert (s.gc_percent, s.n_percent, s.q20_percent, s.q30_percent, s.adapter_percent) == (50, 25, 50, 25, 0)
    positions = M.quality_by_position(M.quality_histogram(d)).collect()
    assert sorted(p.position for p in positions) == [1, 2, 3, 4] and all(p.mean_quality == 15.5 and p.lower_quartile is None and p["median"] is None for p in positions)
    q = {r.mean_quality: (r.read_count, r.read_count_truncate) for r in M.read_quality(d).collect()}
    assert len(q) == 41 and {k: v for k, v in q.items() if v != (0, 0)} == {0: (1, 1), 2: (1, 1), 20: (1, 1), 40: (1, 1)}
    g = {r.bin: (r["reads"], r.observed) for r in M.gc_distribution(d).collect()}
    assert len(g) == 101 and (g[0], g[50], g[100]) == ((1, 1.0), (2, 2.0), (1, 1.0)) and sum(v[0] for v in g.values()) == 4
    assert [(r.length, r["reads"]) for r in M.length_distribution(d).collect()] == [(4, 4)]


def test_gc_of_mixed_lengths(spark):
    d = reads_of(spark, ("AAAA", "!!!!"), ("CCCCCCCC", "!" * 8), ("AATT", "!!!!"))
    g = {r.bin: (r["reads"], r.observed) for r in M.gc_distribution(d).collect()}
    assert {k: g[k] for k in (0, 1, 12, 13, 94, 95, 99, 100)} == {0: (2, 2.0), 1: (0, 2.0), 12: (0, 2.0), 13: (0, 1.0), 94: (0, 0.5), 95: (0, 1.0), 99: (0, 1.0), 100: (1, 1.0)}


def test_n_denominator(spark):
    d = reads_of(spark, ("ACGTN", "IIIII"), ("ACGNN", "IIIII"))
    assert [r.n_percent for r in M.base_content(d).orderBy("position").collect()] == [0, 0, 0, 50, 100]


def test_duplication(spark):
    seqs = ["A" * 60] * 4 + ["C" * 55] * 2 + ["G" * 50, "T" * 50, "ACGT" * 13, "TTTTTTTTTTTT"]
    c = M.duplication_counts(reads_of(spark, *[(s, "I" * len(s)) for s in seqs]))
    levels = {r.duplication_level: (r.total_percent, r.deduplicated_percent) for r in M.duplication_levels(c).collect()}
    assert len(levels) == 16 and (levels["1"], levels["2"], levels["4"]) == ((40.0, 66.666667), (20.0, 16.666667), (40.0, 16.666667))
    s = M.duplication_summary(c).first()
    assert (s.total_reads, s.unique_sequences, s.deduplicated_remaining_percent) == (10, 6, 60.0)


def test_duplication_bins(spark):
    got = {r.n: r.b for r in spark.createDataFrame([(n,) for n in (1, 9, 10, 50, 51, 100, 101, 500, 501, 1000, 1001, 5000, 5001, 10000, 10001)], "n long").select("n", E.duplication_bin(F.col("n")).alias("b")).collect()}
    assert got == {1: 0, 9: 8, 10: 9, 50: 9, 51: 10, 100: 10, 101: 11, 500: 11, 501: 12, 1000: 12, 1001: 13, 5000: 13, 5001: 14, 10000: 14, 10001: 15}


def test_overrepresented_bound(spark):
    def counts(n):
        return spark.createDataFrame([("SE", "A", 1), ("SE", "B", n - 1)], "read string, key50 string, n long")

    assert M.overrepresented(counts(1000)).count() == 2 and M.overrepresented(counts(1001)).count() == 1


def test_adapter_content(spark):
    own = "TGGAATTCTCGG"
    d = reads_of(spark, ("C" * 30 + own + "A", "I" * 43), (own + own, "I" * 24), ("C" * 10 + own[:11] + "C", "I" * 22), ("C" * 10 + own.lower(), "I" * 22))
    at = {r.position: r.percent for r in M.adapter_content(d).where("adapter = \"SmallRNA3'\"").collect()}
    assert (at[1], at[24], at[25], at[30], at[31], at[43]) == (25, 25, 0, 0, 25, 25)


def test_base_groups():
    assert E.base_groups(75)[-1] == (75, 75) and len(E.base_groups(0)) == 0
    for n in (76, 101, 150, 151, 300, 1000, 5000):
        g = E.base_groups(n)
        assert len(g) < 75 and g[0] == (1, 1) and g[-1][1] == n and all(b[0] == a[1] + 1 for a, b in zip(g, g[1:], strict=False))
    assert E.base_groups(101)[9:11] == [(10, 11), (12, 13)]


def test_rules(spark):
    rules = R.rule_table(spark)
    values = {80.0: "pass", 79.999: "warning", 50.0: "warning", 49.999: "fail"}
    for remaining, status in values.items():
        o = spark.createDataFrame([("SE", "deduplicated_loss_percent", 100 - remaining)], "read string, observation string, value double")
        e = {r.observation: r.status for r in R.evaluate(o, rules).collect()}
        assert e["deduplicated_loss_percent"] == status and e["minimum_median"] == "not_evaluated"


def test_faults(spark):
    d = reads_of(spark, ("ACGT", "IIII"), ("ACGX", "IIII"), ("ACGT", "III"), ("ACGT", "II I"))
    assert {r.record_number: r.rule for r in V.read_faults(d).collect()} == {2: "alphabet", 3: "length", 4: "quality_range"}
    with pytest.raises(ValueError, match="record 2"):
        V.first_fault(V.read_faults(d))


GOOD = b"@r1 x\nACGT\n+\nIIII\n@r2\nAC\n+r2\n!~\n"


@pytest.mark.parametrize("data, fault", [
    (b"", "no records"), (b"r1\nACGT\n+\nIIII\n", "must start with @"), (b"@r\nACGT\nSEQ\nIIII\n", "separator"), (b"@r\nACGT\n+\nIIIII\n", "bases"), (GOOD + b"@r3\n", "missing"),
    (b"@r\nACGT\n\nIIII\n", "separator"), (b"@r\n\n+\nIIII\n", "sequence"), (b"@r\nACGT\n+\n\n", "quality"), (b"@r\nACGT\n+\nIIII\n\n@q\nA\n+\nI\n", "header"), (b"@r\nAC\n+\nI \n", "at 2"), (b"@r\nAC\n+\nI\x7f\n", "at 2"),
])
def test_malformed_files(tmp_path, data, fault):
    p = tmp_path / "x.fq"
    p.write_bytes(data)
    with pytest.raises(fastq.FastqError, match=fault):
        list(fastq.records(str(p)))


def test_files(tmp_path):
    p = tmp_path / "x.bin"
    p.write_bytes(gzip.compress(GOOD.replace(b"\n", b"\r\n")))
    assert [(r[0], r[1], r[3], r[4]) for r in fastq.records(str(p))] == [("@r1 x", "ACGT", "IIII", 1), ("@r2", "AC", "!~", 2)]
    p.write_bytes(gzip.compress(GOOD * 2000)[:-8])
    with pytest.raises(fastq.FastqError, match="damaged"):
        list(fastq.records(str(p)))


def test_round_trip(spark, tmp_path):
    d = reads_of(spark, *[("ACGT" * (1 + i % 7), "I" * 4 * (1 + i % 7)) for i in range(200)])
    fastq.write_fastq(d.repartition(5), str(tmp_path / "out"), 3)
    fastq.join_parts(str(tmp_path / "out"), str(tmp_path / "one.fq.gz"))
    back = fastq.read_fastq(spark, str(tmp_path / "one.fq.gz"))
    assert back.count() == 200
    assert back.select("header", "sequence", "quality", "record_number").exceptAll(d.select("header", "sequence", "quality", "record_number")).isEmpty()
