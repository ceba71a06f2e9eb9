"""The registered queries op1 to op10 and the pipeline on the smallest tables: contract columns, against brute force."""

import hashlib
import re
import zlib

import duckdb
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_llm import brute_components, brute_lines, brute_repeat

import corpus_pipeline
from basemill.llm import bpe, op2, op6, op7, op9, registry

SF = "/root/testdata/sf0.001"
QUERIES = registry.queries()
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def rows(spark, name):
    return QUERIES[name](spark, SF).collect()


def sha(x):
    return hashlib.sha256(x).hexdigest()


def held_out(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_op1(spark, docs):
    found = rows(spark, "op1_media")
    assert len(found) == len(docs)
    features = {}
    for r in found:
        text = (docs[r.doc_id].text or "").encode()
        payload = text + b"\xff" * (max(1, -(-len(text) // 576)) * 576 - len(text))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(text), len(payload), sha(payload), zlib.crc32(payload[-32:]))
        assert r.media_bytes > r.payload_bytes and (r.position, r.n_parts) == (1, 3) and r.caption == f"samples of {r.doc_id}"
        assert features.setdefault(text, (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


@pytest.mark.parametrize("op", [op2, op6, op9], ids=lambda m: m.NAME)
def test_oracles(spark, op):
    db = duckdb.connect()
    for t in ("documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.sql(op.ORACLE)
    found = rows(spark, op.NAME)
    assert sorted(tuple(r[c] for c in want.columns) for r in found) == sorted(want.fetchall())


@pytest.mark.parametrize("name, threshold", [("op3_toxicity", 0.3), ("op5_quality_classifier", 0.7)])
def test_classifiers(spark, docs, name, threshold):
    found = rows(spark, name)
    assert sorted(r.doc_id for r in found) == sorted(docs)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= threshold) for r in found)


def test_op4(spark, docs):
    found = rows(spark, "op4_quality_rules")
    assert len(found) == len(docs)
    for r in found:
        text = docs[r.doc_id].text or ""
        words, lines = WORD.findall(text), [x for x in text.split("\n") if WORD.search(x)]
        repeats = brute_repeat(words)
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), repeats)
        assert r.base_failed == (len(words) < 50 or 100 * repeats > 50 * len(words)) and not (r.kept and r.base_failed)


def test_op7(spark, docs):
    codec = bpe.Codec(public_tokenizers.path(op7.VOCABULARY), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    found = rows(spark, "op7_byte_bpe")
    assert len(found) == len(docs)
    for r in found:
        text = docs[r.doc_id].text or ""
        ids = ref.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha(text.encode()))


def test_op8(spark, docs):
    ids = sorted(docs)
    want = {ids[i]: (n, ids[c]) for i, (n, c) in brute_components([docs[i].text for i in ids]).items()}
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows(spark, "op8_jaccard_join")} == want


def test_op10(spark, docs):
    found = rows(spark, "op10_language_id")
    assert len(found) == len(docs) and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 for r in found)
    known = [r for r in found if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(r.lang_pred == docs[r.doc_id].lang for r in known) >= 0.9 * len(known)
    assert all((r.lang_pred == "und") == (not any(map(str.isalpha, docs[r.doc_id].text or ""))) for r in found)


def test_pipeline(spark, tmp_path):
    """Each stage on its own input against brute force."""
    stages, now = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in stages.items():
        stage(spark, now, SF).write.parquet(str(tmp_path / name))
        seen[name] = now.collect(), spark.read.parquet(str(tmp_path / name)).collect()
        now = spark.read.parquet(str(tmp_path / name))
        if name != "byte_bpe":
            assert now.columns == columns

    given, kept = seen["toxicity"]
    scores = {r.doc_id: r.predicted for r in rows(spark, "op3_toxicity")}
    assert {r.doc_id for r in kept} == {r.doc_id for r in given if not scores[r.doc_id]}
    given, kept = seen["line_dedup"]
    ordered = sorted(given, key=lambda r: r.doc_id)
    want = {ordered[i].doc_id: text for i, (_, _, text) in brute_lines([r.text for r in ordered]).items()}
    assert {r.doc_id: r.text or "" for r in kept} == want
    given, kept = seen["jaccard_join"]
    ordered = sorted(given, key=lambda r: r.doc_id)
    assert {r.doc_id for r in kept} == {ordered[i].doc_id for i, (_, c) in brute_components([r.text for r in ordered]).items() if c == i}
    given, mixed = seen["mixing"]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/jaccard_join/*.parquet'")
    times = dict(db.sql("WITH" + op2.MIX_SQL.replace("FROM_DOCUMENTS", "documents") + " SELECT doc_id, times_taken FROM mixed").fetchall())
    assert sorted(r.doc_id for r in mixed) == sorted(i for i, n in times.items() for _ in range(n))
    codec = bpe.Codec(public_tokenizers.path(op7.VOCABULARY), public_tokenizers.PATTERN)
    ref = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    texts = {r.doc_id: r.text for r in mixed}
    assert len(seen["byte_bpe"][1]) == len(mixed) and all(r.ids == ref.encode_ordinary(texts[r.doc_id] or "") for r in seen["byte_bpe"][1])


def test_pipeline_edges(spark, tmp_path):
    """Nulls, empty and long texts, repeated rows, ties, further columns with clashing names, and an empty table."""
    odd = [(None, None, None), (1, "", "a"), (2, "word " * 20_000, "a"), (2, "word " * 20_000, "a"), (3, None, None), (4, "x" * 30_000, "b"), (5, "one two three", "b"), (6, "one two three", "b")]
    table = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in odd], "doc_id long, text string, lang string, source string, n_chars long")
    for given in (table.withColumns({c: F.lit(1) for c in ("id", "drops", "gone", "key", "size", "ids")}), table.limit(0)):
        now = given
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            path = str(tmp_path / f"{name}-{len(given.columns)}")
            stage(spark, now, SF).write.parquet(path)
            now = spark.read.parquet(path)
            assert k == 4 or now.columns == given.columns
            if name == "jaccard_join" and "gone" in given.columns:
                assert sorted((r.doc_id is None, r.doc_id) for r in now.select("doc_id").collect()) == [(False, i) for i in (1, 2, 2, 3, 4, 5)] + [(True, None)]
