"""Centroid clustering, personal data with its telling terms, and the audit of filters: whole results against plain versions, and odd inputs."""

import hashlib
import os
import random
import re
import sys
from fractions import Fraction

import duckdb
import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from likeness.llm import audit, disclosure, lookup  # noqa: E402
from likeness.llm import queries as Q  # noqa: E402

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, v string, c string, cluster string, distance string, codes string"
DOCS = "doc_id long, text string, lang string, part string, digest string, fails string, row string, spans string, h string, n string"
LABELS = "doc_id long, quality int, toxic int, part string, good string"


# --- clusters ------------------------------------------------------------------------------


def vectors(n=60, seed=3):
    rng = random.Random(seed)
    return [(i, [rng.uniform(-1, 1) + (i % 3) for _ in range(64)]) for i in range(n)]


def placed(df):
    return sorted(((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in df.collect()), key=repr)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, *["clash"] * 5) for i, v in rows], VECTORS).repartition(parts)


def test_clusters_with_odd_vectors(spark):
    good = vectors()
    odd = [(70, None), (71, []), (72, [0.5] * 63), (73, [0.5] * 65), (74, [None] + [0.0] * 63), (75, [float("nan")] + [0.0] * 63), (76, [float("inf")] + [0.0] * 63), (None, None)]
    odd += [(77, [1e30] + [0.0] * 63)]  # kept by no long distance: left out
    again = [good[0], good[1], (90, good[2][1]), (91, good[2][1]), (None, good[4][1])]  # repeated rows, ties, a row without id
    got = placed(lookup.cluster(frame(spark, good + odd + again), block=7))
    assert got == sorted(brute.clusters(good + again), key=repr)


@pytest.mark.parametrize("n", [0, 1, 5, 41])
def test_few_vectors(spark, n):
    got = placed(lookup.cluster(frame(spark, vectors(n), 2)))
    assert got == sorted(brute.clusters(vectors(n)), key=repr)


def test_ties_go_to_the_smaller_number(spark):
    same = [(i, [0.25] * 64) for i in range(50)]
    got = lookup.cluster(frame(spark, same)).select("cluster", "distance", "inertia").distinct().collect()
    assert [tuple(r) for r in got] == [(0, 0, 0)]


def test_tables_hold_wide_integers():
    rng = np.random.default_rng(1)
    m = rng.integers(-(2**26), 2**26, (50, 64))
    where, far = lookup.Block.of(m).nearest(m[:5].copy(), at_once=8)
    want = ((m[:, None, :] - m[None, :5, :]) ** 2).sum(2)
    assert (where == want.argmin(1)).all() and (far == want.min(1)).all()


# --- personal data --------------------------------------------------------------------------

SIGNS = ["a.b@c.de", "x@y", "x@y.z@q.r", "@a.b", "a@b.c.d-e", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1", "0255.001.1.1", "4111 1111 1111 1111", "4111111111111111", "4111-1111-1111-1112", "12 34",
         "+1 (555) 123-4567", "+123456789", "+12345678", "+1234567890123456", "+1--2", "a+1 2 3 4 5 6 7 8 9b", "++1 22333444555", "und.34@mail7.example.com", "9" * 4000, "é@ü.de", "..@-.-", "79927398713000"]


def test_base_spans_are_those_of_the_patterns():
    rng = random.Random(5)
    for _ in range(3000):
        text = "".join(rng.choice(SIGNS + [" ", ",", "x", ".", "-", "+", "@"]) for _ in range(rng.randint(1, 7)))
        assert disclosure.base_spans(text) == brute.personal(text), text


def test_long_runs_take_linear_time():
    for run in ("a" * 400_000, "7" * 400_000, "1." * 200_000, "+1" * 200_000, "a@" * 200_000):
        disclosure.base_spans(run)


def check(texts, rows):
    """``rows`` (by place of the text) against the plain version."""
    for text, (spans, hide), r in zip(texts, brute.disclosures(texts), rows, strict=True):
        counts = [sum(k == i for _, k, *_ in spans) for i in range(4)]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts
        base = [(a, k, b) for a, k, b, _ in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        for m in re.finditer(r"[^\x20\x09-\x0D]+", text):
            whole = brute.terms(m.group())
            if whole and whole[0] in hide and not any(a < m.end() and m.start() < b for a, _, b in base):
                a = m.start() + m.group().lower().index(whole[0])
                base.append((a, 4, a + len(whole[0])))
        assert r["spans"] == ",".join(f"{disclosure.KINDS[k]}:{a}:{b}" for a, k, b in sorted(base))


def filler(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "of", "the", "in"]) for _ in range(n))


def people(n=300, seed=7):
    """Two people whose names stand with their address; common words stand anywhere."""
    rng, texts = random.Random(seed), []
    for i in range(n):
        t = filler(rng, 20)
        if i % 30 == 0:
            t += " write to Zebulon, (Quartermain) at zeb@example.org " + filler(rng, 12) + " zebulon again"
        elif i % 30 == 1:
            t += " call Quarterly Hobbins +1 (555) 010-9999 " + filler(rng, 12)
        elif i % 7 == 0:
            t += f" card {4111111111111111} or 10.0.0.{i % 200} mail user{i}@example.org call +1 555 010 {1000 + i}"
        texts.append(t)
    return texts


def test_telling_terms_are_hidden(spark):
    texts = people()
    df = spark.createDataFrame([(i, t, "en", *["clash"] * 7) for i, t in enumerate(texts)], DOCS).repartition(4)
    rows = [r.asDict() for r in disclosure.sanitise(df).orderBy("doc_id").collect()]
    check(texts, rows)
    clean = rows[0]["sanitised"].lower()
    assert "zebulon" not in clean and "[email]" in clean and "alpha" in clean
    assert "Quar" not in rows[30]["sanitised"] or "Quar*" in rows[30]["sanitised"]
    assert rows[2]["sanitised"] is None and rows[2]["spans"] == ""
    assert rows[0]["n_term"] >= 3


def test_a_prefix_that_discloses_is_removed(spark):
    texts = [t.replace("Quarterly", "Sixthly") for t in people()]  # now "quar" stands with one person only
    df = spark.createDataFrame([(i, t, "en", *["clash"] * 7) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["sanitised"] for r in disclosure.sanitise(df).where("doc_id in (0, 31)").collect()}
    assert "Quar" not in got[0]
    general = {r["doc_id"]: r["sanitised"] for r in disclosure.sanitise(spark.createDataFrame([(i, t) for i, t in enumerate(people())], "doc_id long, text string")).where("doc_id = 0").collect()}
    assert "Quar*" in general[0]


def test_personal_data_in_odd_rows(spark):
    long = "word " * 60_000 + "last@mail.example.org"
    rows = [(1, "a@b.cd Name"), (1, "a@b.cd Name"), (1, "other"), (None, "a@b.cd Name"), (None, None), (3, ""), (4, long), (5, " \t\n")]
    df = spark.createDataFrame([(i, t, None, *[None] * 7) for i, t in rows], DOCS)
    got = disclosure.sanitise(df).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] or 0, r["n_email"]) for r in got) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 1), (3, 0), (4, 1), (5, 0)]
    assert {r["spans"] for r in got if r["doc_id"] == 4} == {f"email:{len(long) - 21}:{len(long)}"}
    assert disclosure.sanitise(spark.createDataFrame([], DOCS)).count() == 0
    none = spark.createDataFrame([(1, "no data at all")], "doc_id long, text string")
    assert disclosure.sanitise(none).first()["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_disclosure_query(spark):
    docs = duckdb.sql(f"SELECT doc_id, coalesce(text, '') FROM '{SF}/documents.parquet' ORDER BY doc_id").fetchall()
    rows = [r.asDict() for r in Q.op12_pii_disclosure(spark, SF).orderBy("doc_id").collect()]
    assert [r["doc_id"] for r in rows] == [d for d, _ in docs]
    check([t for _, t in docs], rows)


# --- filters --------------------------------------------------------------------------------


def audited(df):
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[x] for x in names) for r in df.collect()}


def test_audit_of_odd_rows(spark):
    rng = random.Random(11)
    pool = ["", None, "short", "SHOUT " * 250, "same words " * 150, " ".join(f"w{i}" for i in range(260)), " ".join(f"w{i}" for i in range(260)) + " #", "é" * 40, "a|b", " \n\t"]
    rows = [(i if i % 11 else None, rng.choice(pool), rng.choice(["en", "de", "", None])) for i in range(120)]
    rows += [(500, "twice", "en"), (500, "twice", "de"), (501, "twice", None)]
    docs = spark.createDataFrame([(d, t, p, *["clash"] * 7) for d, t, p in rows], DOCS).repartition(3)
    marks = [(i, i % 2, int(i % 3 == 0), "x", "y") for i in range(0, 120, 2)] + [(4, 1, 1, "x", "y"), (None, 1, 1, "x", "y"), (6, None, None, "x", "y"), (500, 1, 0, "x", "y")]
    labels = spark.createDataFrame(marks, LABELS)
    good, toxic = {d for d, q, *_ in marks if q == 1 and d is not None}, {d for d, _, t, *_ in marks if t == 1 and d is not None}
    assert audited(audit.audit(docs, labels)) == brute.audited(rows, good, toxic)


def test_audit_of_empty_tables(spark):
    docs, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, None, None, *[None] * 7)], DOCS)
    got = audited(audit.audit(one, labels))
    assert len(got) == 600 and {v[-1] for (_, order, step), v in got.items() if order[step - 1] == "A"} == {120}


def test_least_squares_gives_shapley_values():
    rng = random.Random(13)
    for m in range(1, 6):
        counts = [rng.randint(0, 50) for _ in range(1 << m)]
        worth = audit.coalitions(counts)
        # a document that fails k filters is shared out evenly among them
        want = [sum(Fraction(n, s.bit_count()) for s, n in enumerate(counts) if s >> i & 1) for i in range(m)]
        assert audit.shapley(worth, m) == want


def test_audit_query_against_plain_orders(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()
    marks = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SF}/labels.parquet'").fetchall()
    got = audited(Q.op13_filter_audit(spark, SF))
    assert got == brute.audited(docs, {d for d, q, _ in marks if q == 1}, {d for d, _, t in marks if t == 1})
