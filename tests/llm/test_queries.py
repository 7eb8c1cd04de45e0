"""Every query of the training-data operators on the smallest tables, against brute force, a library or DuckDB."""

import hashlib
import os
import sys
import zlib

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from likeness.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return dict(duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet'").fetchall())


@pytest.fixture(scope="module")
def run(spark):
    return lambda name: [r.asDict(recursive=True) for r in Q.QUERIES[name](spark, SF).collect()]


def ids_by(tokenizer, text, end):
    return np.array([*tokenizer.encode(text, add_special_tokens=False).ids, end], "<u4")


def test_gru_scoring(run, docs):
    rows, want = run("op1_gru_scoring"), brute.base_scores(docs)
    assert len(rows) == len(docs)
    for r in rows:
        held, n, known, total, base = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held, n, known, total)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_sentencepiece(run, docs):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=Q.tokenizer_file("piece_bpe_32k.model"))
    rows = run("op2_sentencepiece")
    assert len(rows) == len(docs)
    for r in rows:
        ids = model.encode(docs[r["doc_id"]], add_eos=True)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(model.decode(ids).encode()).hexdigest()
        assert r["covered_bytes"] == len(docs[r["doc_id"]].encode())


def test_simple8b(run, docs):
    from tokenizers import Tokenizer

    tok, at = Tokenizer.from_file(Q.tokenizer_file("byte_bpe_50k.json")), 0
    rows = {r["doc_id"]: r for r in run("op3_simple8b")}
    for d in sorted(docs):
        ids = ids_by(tok, docs[d], 2)
        assert rows[d] == {"doc_id": d, "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        at += len(ids)


def test_quality_rules(run, docs):
    rows = run("op4_quality_rules")
    assert len(rows) == len(docs)
    for r in rows:
        n, chars, symbols, lines, repeats = brute.statistics(docs[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        assert r["base_failed"] == (n < 50 or 100 * repeats > 50 * n)
        assert not (r["base_failed"] and r["kept"])


def test_hyperminhash(run, docs):
    want = brute.groups(docs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in run("op5_hyperminhash")}
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_suffix_array(run, docs):
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in run("op7_suffix_array")}
    assert got == brute.stripped_bytes(docs)


def test_recompression(run, docs):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in run("op8_recompression")}
    assert got == {d: (n, k, brute.sha(rest)) for d, (n, k, rest) in brute.stripped_words(docs).items()}


def test_packing(run, docs):
    from tokenizers import Tokenizer

    tok, by = Tokenizer.from_file(Q.tokenizer_file("word_bpe_49k.json")), {}
    rows = run("op9_packing")
    assert sorted(r["sequence_id"] for r in rows) == list(range(len(rows)))
    for r in rows:
        assert r["offset"] == 0 and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 2048
        by.setdefault(r["doc_id"], []).append(r)
    for d, text in docs.items():
        ids, at = ids_by(tok, text, 1), 0
        for r in sorted(by[d], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    toxic = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = Q.QUERIES["op10_toxicity"](spark, sf).select("doc_id", "held_out", "score", "predicted").collect()
    held = [(r["predicted"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    hits = sum(p and y for p, y in held)
    assert hits >= 0.85 * sum(y for _, y in held) and hits >= 0.85 * sum(p for p, _ in held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_against_sql(spark):
    from tests.compare import compare, duck

    con = duck(SF)
    for name, sql in Q.ORACLES.items():
        assert compare(spark, con, Q.QUERIES[name], sql, SF) is None, name


def test_pipeline_stages(spark):
    """Each stage on its own input, against a plain version of what it must leave."""
    sf = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{sf}/documents.parquet")
    columns = df.columns
    rejected = {r["doc_id"] for r in Q.op10_toxicity(spark, sf).where("predicted = 1").collect()}
    docs = {r["doc_id"]: r["text"] or "" for r in df.collect()}
    for name, stage in Q.STAGES[:-1]:
        df = stage(spark, df, sf)
        path = f"{os.environ.get('TMPDIR', '/tmp')}/likeness-stage-{os.getpid()}-{name}"
        df.write.mode("overwrite").parquet(path)
        df = spark.read.parquet(path)
        assert df.columns == columns
        got = {r["doc_id"]: r["text"] or "" for r in df.collect()}
        if name == "toxicity":
            want = {d: t for d, t in docs.items() if d not in rejected}
        elif name == "exact_dedup":
            seen = {}
            for d in sorted(docs):
                seen.setdefault(" ".join(brute.re.split(r"[\x20\x09-\x0D]+", docs[d])), d)
            want = {d: docs[d] for d in seen.values()}
        elif name == "near_dedup":
            want = {d: docs[d] for d, (_, c) in brute.groups(docs).items() if c == d}
        else:
            cut = brute.stripped_words(docs)
            want = {d: rest.decode() if k else docs[d] for d, (_, k, rest) in cut.items() if rest or not k}
        assert got == want, name
        docs = got
    pieces = Q.STAGES[-1][1](spark, df, sf)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == set(docs)
