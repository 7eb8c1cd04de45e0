"""Links found in the data, against plain sets."""

import random

import pytest
from pyspark.sql import functions as F

from likeness.operators import keys as K
from likeness.operators import summaries as S


def tables_of(spark, seed=1):
    """Keys of several sizes and kinds, children that lie in them wholly, nearly and not at all."""
    rng = random.Random(seed)
    big = [i * 7 + 3 for i in range(1500)]
    words = [f"w{i}" for i in range(600)]
    data = {
        "big": ([(k, f"n{k % 40}", None if i % 9 == 0 else k) for i, k in enumerate(big)], "id long, name string, hole long"),
        "words": ([(w, i) for i, w in enumerate(words)], "code string, place int"),
        "child": (
            [(rng.choice(big), rng.choice(big) if rng.random() < 0.97 else -i, rng.choice(words) if i % 5 else None, i % 7, rng.random(), -i) for i in range(3000)],
            "big_id long, almost long, word string, small short, x double, other int",
        ),
        "empty": ([], "id long, code string"),
        "self": ([(i, rng.randrange(500)) for i in range(500)], "id long, boss long"),
    }
    return {t: spark.createDataFrame(*d) for t, d in data.items()}, {t: ([c.split() for c in s.split(", ")], rows) for t, (rows, s) in data.items()}


def plain(data, min_overlap, self_links=False):
    kinds = {"long": "whole", "int": "whole", "short": "whole", "string": "text"}
    cols = {(t, c): (kinds[k], [r[i] for r in rows]) for t, (names, rows) in data.items() for i, (c, k) in enumerate(names) if k in kinds}
    out = {}
    for (pt, pc), (pk, pv) in cols.items():
        if not pv or None in pv or len(set(pv)) < len(pv):
            continue
        for (ct, cc), (ck, cv) in cols.items():
            have = {v for v in cv if v is not None}
            both = have & set(pv)
            if ck == pk and (ct != pt or self_links) and (ct, cc) != (pt, pc) and both and len(both) >= min_overlap * len(have):
                out[ct, cc, pt, pc] = (len(have), len(set(pv)), len(both))
    return out


@pytest.mark.parametrize("sketch,min_overlap,self_links", [(4096, 0.95, False), (4096, 1.0, True), (64, 0.95, False), (64, 0.5, True)])
def test_links_are_those_of_plain_sets(spark, monkeypatch, sketch, min_overlap, self_links):
    monkeypatch.setattr(S, "SKETCH", sketch)
    tables, data = tables_of(spark)
    rows = K.discover_links(tables, min_overlap, self_links).collect()
    got = {tuple(r[c] for c in K.LINK): (r["child_keys"], r["parent_keys"], r["shared_keys"]) for r in rows}
    assert got == plain(data, min_overlap, self_links)
    for r in rows:
        assert r["overlap"] == r["shared_keys"] / r["child_keys"] and r["coverage"] == r["shared_keys"] / r["parent_keys"]
    best = {}
    for r in rows:
        key = (-r["coverage"], r["to_table"], r["to_column"])
        best[r["from_table"], r["from_column"]] = min(best.get((r["from_table"], r["from_column"]), key), key)
    assert all(r["best"] == (best[r["from_table"], r["from_column"]] == (-r["coverage"], r["to_table"], r["to_column"])) for r in rows)


def test_sketches_drop_most_pairs(spark, monkeypatch):
    monkeypatch.setattr(S, "SKETCH", 256)
    tables = {f"t{i}": spark.range(i * 10_000, i * 10_000 + 2000).select("id", (F.col("id") + 5_000).alias("far")) for i in range(6)}
    found, sketches = K.candidates(tables)
    assert len(found) == 12 and not K.plausible(found, sketches, 0.9)


def test_hot_values_do_not_multiply_rows(spark):
    hot = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, F.lit(1)).otherwise(F.col("id")).alias("k"))
    parent = spark.range(30_000).withColumnRenamed("id", "k")
    got = K.shared_keys({"c": hot, "p": parent}, [("c", "k", "p", "k"), ("p", "k", "c", "k")]).collect()
    n = len({1 if i % 3 == 0 else i for i in range(20_000)})
    assert {(r["from_table"], r["child_keys"], r["parent_keys"], r["shared_keys"]) for r in got} == {("c", n, 30_000, n), ("p", 30_000, n, n)}


def test_nothing_to_find(spark):
    assert K.discover_links({"a": spark.range(0), "b": spark.range(5).select((F.col("id") * 1.5).alias("x"))}).count() == 0
    assert K.discover_links({"a": spark.range(4), "b": spark.range(10, 15)}).count() == 0
