"""Published example values of trimming, overlaps and merging."""

import random

import pytest

from basemill.operators import pairs as P
from basemill.operators import trimming as T

C = T.TrimConfig


def trimmed(spark, config, *reads):
    rows = [(i, "@r", s, q) for i, (s, q) in enumerate(reads)]
    d = spark.createDataFrame(rows, "record_number long, header string, sequence string, quality string")
    return T.trim_reads(d, config)


def one(spark, config, s, q=None):
    return trimmed(spark, config, (s, q or "I" * len(s))).first()


@pytest.mark.parametrize("config, s, q, want", [
    (C(), "ACGTACGT", "IIIIIIII", "ACGTACGT"),
    (C(adapter_trimming=True, adapters=("AGATCGGA",)), "ACGTAGATCGGA", None, "ACGT"),
    (C(cut_tail=True), "ACGTACGT", "IIIIII!!", "ACGTAC"),
    (C(poly_g=4), "ACGTGGGG", None, "ACGT"),
    (C(poly_x=4), "ACGTAAAA", None, "ACGT"),
    (C(cut_front=True), "ACGTACGT", "!!IIIIII", "GTACGT"),
    (C(cut_right=True), "ACGTACGT", "IIII!!!!", "ACG"),
    (C(umi_length=4), "ACGTGATT", "12345678", "GATT"),
])
def test_steps(spark, config, s, q, want):
    assert one(spark, config, s, q).sequence == want


def test_short(spark):
    r = one(spark, C(min_length=4), "ACG")
    assert not r.passed and r.failed == "TOO_SHORT"
    r = one(spark, C(umi_length=9, front=2), "ACGTGATT")
    assert not r.passed and r.failed == "UMI_TOO_SHORT" and r.sequence == "ACGTGATT"
    assert one(spark, C(umi_length=8), "ACGTGATT").sequence == ""


@pytest.mark.parametrize("adapter, read, position", [
    ("AGATCGGA", "TTTTAGATCGGA", 4), ("AGATCGGA", "TTTTAGATCG", 4), ("AGATCGGA", "TTTTAGATC", -1), ("AGATCGGA", "AGATCGGA", 0), ("AGATCGGA", "TTTTAGATCGTA", 4),
    ("ACGTACGTACGTACGT", "TTTTACGTTCGTTCGTACGT", 4), ("AAAAAA", "CCCCCC", -1),
])
def test_adapter_search(adapter, read, position):
    assert T.first_adapter([read.encode()], [adapter.encode()])[0] == position


def test_adapter_search_against_all_positions():
    rng = random.Random(3)
    adapters = [b"AGATCGGAAGAGC", b"CTGTCTCTTATACACATCT", b"AAAAAAAAAAAA"]
    reads = ["".join(rng.choice("ACGTNa") for _ in range(rng.randrange(0, 50))) for _ in range(400)]
    reads += [r[:20] + "".join(c if rng.random() > 0.1 else "A" for c in "CTGTCTCTTATACACATCT") for r in reads[:200]]

    def plain(read):
        r = read.upper().encode()
        for p in range(len(r) - 5):
            for a in adapters:
                n = min(len(a), len(r) - p)
                if sum(x != y for x, y in zip(r[p : p + n], a[:n], strict=True)) <= n // 8:
                    return p
        return -1

    assert list(T.first_adapter([r.encode() for r in reads], adapters)) == [plain(r) for r in reads]


def test_single_end_report(spark):
    config = C(cut_tail=True, adapter_trimming=True, adapters=("TTTTTT",), poly_g=4, poly_x=4, min_length=4)
    d = trimmed(spark, config, ("ACGTACGT", "I" * 8), ("ACGTACTTTTTT", "I" * 12), ("ACGTACGT", "IIIIII!!"), ("ACGTACGGGG", "I" * 10), ("ACGTACAAAA", "I" * 10), ("ACGGGG", "I" * 6))
    s = T.trim_statistics(d).first()
    assert (s.total_reads, s.passed_reads, s.discarded_reads, s.bases_before, s.bases_after, s.bases_trimmed) == (6, 5, 1, 54, 34, 20)
    assert (s.quality_trimmed_reads, s.adapter_trimmed_reads, s.poly_g_trimmed_reads, s.poly_x_trimmed_reads, s.too_short_reads) == (1, 1, 2, 1, 1)
    assert [(r.position, r["reads"]) for r in T.adapter_positions(d).collect()] == [(6, 1)]


def rc(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def test_overlap():
    found = P.find_overlaps([b"AAAACCCC"], [rc("TCCCGGGG").encode()], 4, 2, 25)
    assert list(found[0]) == [4, 0, 4, 1]


def plain_overlap(a, b, m, most, percent):
    r, best = rc(b).replace("", ""), None
    for shift in range(m - len(r), len(a) - m + 1):
        s1, s2 = max(shift, 0), max(-shift, 0)
        n = min(len(a) - s1, len(r) - s2)
        if n < m:
            continue
        wrong = sum(x != y for x, y in zip(a[s1 : s1 + n], r[s2 : s2 + n], strict=True))
        if wrong <= min(most, n * percent // 100):
            key = (-n, wrong, s1, s2)
            best = key if best is None or key < best else best
    return [-1] if best is None else [best[2], best[3], -best[0], best[1]]


def test_overlap_against_all_shifts():
    rng = random.Random(5)
    a, b = [], []
    for _ in range(500):
        f = "".join(rng.choice("ACGTN") for _ in range(rng.randrange(5, 60)))
        x, y = f[: rng.randrange(1, 40)], rc(f)[: rng.randrange(1, 40)]
        a.append("".join(c if rng.random() > 0.05 else "A" for c in x))
        b.append(y)
    found = P.find_overlaps([x.encode() for x in a], [y.encode() for y in b], 4, 2, 25)
    for got, x, y in zip(found, a, b, strict=True):
        want = plain_overlap(x, y, 4, 2, 25)
        assert list(got) == want if want != [-1] else got[0] == -1


def test_correction_and_merging():
    s2, low = rc("TCCCGGGG").encode(), b"IIII!III"
    a, _, _, _, n1, n2 = P.correct_pair(b"AAAACCCC", low, s2, b"IIIIIIII", 4, 0, 4)
    assert (a, n1, n2) == (b"AAAATCCC", 1, 0)
    _, _, b, _, n1, n2 = P.correct_pair(b"AAAACCCC", b"IIIIIIII", s2, b"IIIIIII!", 4, 0, 4)
    assert (rc(b.decode()), n1, n2) == ("CCCCGGGG", 0, 1)
    assert P.correct_pair(b"AAAACCCC", b"IIIIIIII", s2, b"IIIIIIII", 4, 0, 4)[4:] == (0, 0)
    assert P.correct_pair(b"AAAANCCC", low, s2, b"IIIIIIII", 4, 0, 4)[0] == b"AAAATCCC"
    assert P.merge_pair(b"AAAACCCC", b"I" * 8, rc("CCCCGGGG").encode(), b"I" * 8, 4, 0, 4)[0] == b"AAAACCCCGGGG"
    assert P.merge_pair(b"AAAACCCC", b"I" * 8, s2, b"I" * 8, 4, 0, 4)[0] == b"AAAANCCCGGGG"
    assert P.merge_pair(b"ACGTACAAAA", b"I" * 10, b"GTACGTCCCC", b"I" * 10, 0, 4, 6)[0] == b"ACGTAC"


def test_paired_report(spark):
    config = C(cut_tail=True, adapter_trimming=True, adapters=("TTTTTT",), poly_g=4, poly_x=4, min_length=4)
    firsts = [("ACGTACGT", "I" * 8), ("ACGTACTTTTTT", "I" * 12), ("ACGTACGT", "IIIIII!!"), ("ACGTACGGGG", "I" * 10), ("ACGGGG", "I" * 6)]
    rows = [(i, "@a/1", s, q, "@a/2", "ACGTACGT", "I" * 8) for i, (s, q) in enumerate(firsts)]
    d = spark.createDataFrame(rows, "record_number long, header1 string, sequence1 string, quality1 string, header2 string, sequence2 string, quality2 string")
    s = P.pair_statistics(P.trim_pairs(d, config)).first()
    assert (s.total_reads, s.passed_reads, s.discarded_reads, s.output_reads, s.mate_discarded_reads, s.total_pairs, s.passed_pairs, s.discarded_pairs) == (10, 9, 1, 8, 1, 5, 4, 1)


def test_full_pairs(spark):
    f = "ACGTTGCATGCATTAGGCTAACGTACGATCGA" * 1
    bad = f[:10] + ("A" if f[10] != "A" else "C") + f[11:]
    d = spark.createDataFrame([(1, "@p/1", bad, "I" * 10 + "!" + "I" * 21, "@p/2", rc(f), "I" * 32)], "record_number long, header1 string, sequence1 string, quality1 string, header2 string, sequence2 string, quality2 string")
    s = P.pair_statistics(P.trim_pairs(d, C(correction=True, merge=True))).first()
    assert (s.corrected_reads, s.corrected_bases, s.merged_pairs) == (1, 1, 1)


def test_config():
    for bad in ({"quality": 94}, {"window": 0}, {"adapters": ("ACX",)}, {"adapter_trimming": True, "adapters": ("ACG",)}, {"min_length": -1}):
        with pytest.raises(ValueError):
            C(**bad)
    assert C.full(min_length=30).min_length == 30 and C.full().poly_x == 10
