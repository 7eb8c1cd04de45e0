"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns for every operator; and properties of its parts."""

import os
import random
import sys
import tempfile

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from likeness.llm import common, components, crf, exact, gru, hyperminhash, induced, packing, pieces, quality, recompress, simple8b, suffix  # noqa: E402

TOK = "/opt/tokenizers"
LONG = " ".join(f"w{i * i % 977}" for i in range(30_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
TEXTS = {
    1: "one two three four five six seven", 2: "one  two\tthree four\nfive six seven", 3: None, 4: "", 5: " \n\t ", 6: "word", 7: "Word", 8: LONG, 9: LONG + " tail",
    10: "start " + PASSAGE + " end", 11: PASSAGE + " other words after it", 12: "aaa " * 80, 13: "bbb " * 3 + "aaa " * 80, 14: "ÄÖ ü ﬁ 日本語 🙂 x\x00y\x1cz", 15: "one two three four five six seven",
    16: "<|endoftext|> and <|startoftext|>", 17: "a",
}
SCHEMA = "doc_id long, text string, key string, node string, words string, ids string, score string, h string, salt string, digest string, component string, source string"


def clean(t):
    return t or ""


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(d, t, *["clash"] * 10) for d, t in TEXTS.items()], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and rows without an id."""
    return spark.createDataFrame([(1, "same text here", *[None] * 10), (1, "same text here", *[None] * 10), (None, "same text here", *[None] * 10), (None, None, *[None] * 10)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(d, d % 2, int(d % 3 == 0)) for d in TEXTS] + [(1, None, None), (2, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


NO_LABELS = "doc_id long, quality int, toxic int"
PLAIN = {d: clean(t) for d, t in TEXTS.items()}


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_exact(spark, docs, odd, empty):
    got = rows(exact.DigestIndex(spark).add(docs))
    assert (got[2]["keep_id"], got[2]["group_size"], got[2]["kept"]) == (1, 3, False)
    assert got[3]["keep_id"] == got[4]["keep_id"] == 3 and got[5]["keep_id"] == 5 and got[7]["kept"]
    kept = exact.DigestIndex(spark).add(odd).collect()
    assert len(kept) == 4 and [r["kept"] for r in kept if r["doc_id"] == 1] == [True, True]
    assert exact.DigestIndex(spark).add(empty).count() == 0
    assert exact.deduplicate(docs).columns == docs.columns


def test_exact_keeps_rows_without_id(spark, odd):
    got = exact.deduplicate(odd).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in got) == [(0, ""), (1, "same text here"), (1, "same text here")]
    mixed = spark.createDataFrame([(None, "alone"), (None, "with id"), (3, "with id"), (1, "other"), (3, "other"), (None, "twice"), (None, "twice")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact.deduplicate(mixed).collect()) == [(0, "alone"), (0, "twice"), (0, "twice"), (1, "other"), (3, "with id")]


def test_exact_index_remembers(spark, docs):
    index = exact.DigestIndex(spark, buckets=3)
    first = index.add(docs.where("doc_id < 10"))
    first.count()
    second = rows(index.add(docs))
    assert second[15]["keep_id"] == 1 and second[10]["kept"]
    assert index.table().count() == len({" ".join(brute.re.split(r"[\x20\x09-\x0D]+", t)) for t in PLAIN.values()})


def test_quality(spark, docs, odd, empty, labels):
    got, rules = quality.judge(docs, labels)
    for d, r in rows(got).items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute.statistics(PLAIN[d])
    assert quality.judge(odd, spark.createDataFrame([], NO_LABELS))[0].count() == 4
    assert quality.judge(empty, labels)[0].count() == 0


def test_rules_are_found(spark):
    rng = random.Random(1)
    data, marks = [], []
    for d in range(400):
        low = d % 5 == 0
        data.append((d, " ".join(rng.choice("abcdefghij") * rng.randint(2, 6) + ("***" if low else "") for _ in range(80))))
        marks.append((d, 1 - int(low)))
    got, rules = quality.judge(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int"))
    assert {r["doc_id"] for r in got.where("not kept and not base_failed").collect()} == {d for d in range(400) if d % 5 == 0}
    assert len(rules.rules) == 1 and "symbols" in str(rules)


def test_hyperminhash(spark, docs, odd, empty):
    want = brute.groups(PLAIN)
    got = rows(hyperminhash.groups(docs))
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert hyperminhash.groups(odd).count() == 4 and hyperminhash.groups(empty).count() == 0
    assert hyperminhash.deduplicate(docs).columns == docs.columns


def test_groups_that_straddle_the_bar(spark):
    """Texts of one family around a similarity of 0.75: every link counts, also those that the smallest text does not have."""
    rng = random.Random(2)
    base = [f"t{i}" for i in range(120)]
    texts = {}
    for d in range(90):
        w = list(base)
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts[d] = " ".join(w)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.groups(df).collect()}
    assert got == brute.groups(texts)


def test_repeated_ids_keep_the_links_of_each_text(spark):
    """Two texts under one doc_id, with a near copy of each under other ids."""
    one, two = [f"a{i}" for i in range(200)], [f"b{i}" for i in range(200)]
    near = lambda w: " ".join([*w[:100], "changed", *w[101:]])
    rows = [(1, " ".join(one)), (1, " ".join(two)), (2, near(one)), (3, near(two)), (4, " ".join(two)), (0, " ".join(f"c{i}" for i in range(50)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in hyperminhash.groups(df).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 1, False)]
    kept = hyperminhash.deduplicate(df).collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept) == sorted([rows[0], rows[1], rows[5]])
    lower = spark.createDataFrame([*rows, (-1, near(two))], "doc_id long, text string")  # now one of the texts of 1 goes, the other stays
    assert sorted((r["doc_id"], r["text"]) for r in hyperminhash.deduplicate(lower).collect()) == sorted([(-1, near(two)), rows[0], rows[5]])


def test_a_template_below_the_bar_costs_few_pairs(spark, monkeypatch):
    """600 texts that share a template at a similarity of about 0.72, with some pairs above the bar hidden among them."""
    rng = random.Random(9)
    base = [f"t{i}" for i in range(400)]
    texts = {}
    for d in range(600):
        w = list(base)
        for i in rng.sample(range(5, 395), 14):
            w[i] = f"x{d}_{i}"
        texts[d] = " ".join(w)
    for d in (600, 601, 602):
        texts[d] = texts[d - 500].replace(f" t{d - 590}", " other", 1)
    made, counted = hyperminhash._by_rare_shingles, []

    def counting(*args):
        out = made(*args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(hyperminhash, "_by_rare_shingles", counting)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.groups(df).collect()}
    assert got == brute.groups(texts)
    assert len(counted) == 1 and counted[0] < 20 * len(texts)


@pytest.mark.parametrize("edits", [(1, 2, 3, 4, 5, 6), (4,)])
def test_copies_of_one_text_cost_few_pairs(spark, monkeypatch, edits):
    """400 copies of a text with some words changed: with few changes they link to the least changed ones; with four each, all lie below the bar."""
    rng = random.Random(11)
    base = [f"t{i}" for i in range(150)]
    texts = {}
    for d in range(400):
        w = list(base)
        for i in rng.sample(range(5, 145), rng.choice(edits)):
            w[i] = f"x{d}_{i}"
        texts[d] = " ".join(w)
    made, counted = hyperminhash._by_rare_shingles, []

    def counting(*args):
        out = made(*args)
        counted.append(out.count())
        return out

    monkeypatch.setattr(hyperminhash, "_by_rare_shingles", counting)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in hyperminhash.groups(df).collect()}
    assert got == brute.groups(texts)
    assert sum(counted) < 5 * len(texts)


def test_parities_bound_how_sets_differ(spark):
    """Never more bits than shingles differ, and about as many where few do."""
    rng = np.random.default_rng(3)
    sets = {0: np.sort(rng.integers(0, 1 << 63, 150))}
    for n in range(1, 40):
        sets[n] = np.sort(np.concatenate([sets[0][n:], rng.integers(0, 1 << 63, rng.integers(0, 400) if n % 4 else n)]))
    df = spark.createDataFrame([(n, s.astype(np.uint64).tobytes()) for n, s in sets.items()], "node long, hashes binary").repartition(3)
    got = {r["node"]: [v % (1 << 64) for v in r[1:]] for r in hyperminhash._parities(df).collect()}
    assert set(got) == set(sets)
    for n, s in sets.items():
        bits, differ = sum((x ^ y).bit_count() for x, y in zip(got[0], got[n])), len(np.setxor1d(sets[0], s))
        assert bits <= differ and (bits - differ) % 2 == 0 and (differ > 10 or bits >= differ - 4)


def test_estimate_corrects_for_chance():
    m, p = hyperminhash._constants(4096, 1), hyperminhash._constants(4096, 2)
    h = hyperminhash._mix(np.arange(1, 3001, dtype=np.uint64))
    a, b = hyperminhash.registers(h[:2000], m, p), hyperminhash.registers(h[1000:], m, p)
    assert abs(hyperminhash.estimate(a, b, 2000, 2000) - 1 / 3) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(200)] + [(1000, 1001)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(201)}, 1000: 1000, 1001: 1000}


def test_recompression(spark, docs, odd, empty):
    want = brute.stripped_words(PLAIN)
    got = rows(recompress.strip(docs))
    assert {d: (r["n_words"], r["n_removed"], r["kept_sha256"]) for d, r in got.items()} == {d: (n, k, brute.sha(x)) for d, (n, k, x) in want.items()}
    assert recompress.strip(odd).where("n_removed = 0").count() == 4 and recompress.strip(empty).count() == 0
    left = rows(recompress.stripped(docs))
    assert left[3]["text"] is None and left[10]["text"] == TEXTS[10] and left[11]["text"] == "other words after it" and recompress.stripped(docs).columns == docs.columns


def test_repeated_ids_are_cut_by_their_own_text(spark):
    """Rows of one doc_id with different, longer and equal texts that share passages with a smaller document and with each other."""
    other = " ".join(f"own{i}" for i in range(40))
    data = [(1, "start " + PASSAGE), (2, PASSAGE + " " + other), (2, "x y z " * 30 + PASSAGE + " tail"), (2, PASSAGE + " " + other), (2, "short"), (3, other + " end"), (None, PASSAGE), (None, PASSAGE), (1, PASSAGE)]
    df = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(data)], "doc_id long, text string, line int").repartition(3)

    def wanted(cut):
        """Each row against all rows of smaller ids, by the plain version."""
        out = []
        for d, t in data:
            before = {i: x for i, (e, x) in enumerate(data) if d is not None and e is not None and e < d}
            out.append((d or 0, *cut({**before, len(data): t})[len(data)]))
        return sorted(out, key=str)

    words = [(r["doc_id"] or 0, r["n_words"], r["n_removed"], r["kept_sha256"]) for r in recompress.strip(df).collect()]
    assert sorted(words, key=str) == sorted([(d, n, k, brute.sha(x)) for d, n, k, x in wanted(brute.stripped_words)], key=str)
    raw = [(r["doc_id"] or 0, r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix.strip(df).collect()]
    assert sorted(raw, key=str) == wanted(brute.stripped_bytes)
    left = {r["line"]: r["text"] for r in recompress.stripped(df).collect()}
    want = {}
    for i, (d, t) in enumerate(data):
        before = {j: x for j, (e, x) in enumerate(data) if d is not None and e is not None and e < d}
        _, k, rest = brute.stripped_words({**before, len(data): t})[len(data)]
        if rest or not k:
            want[i] = rest.decode() if k else t
    assert left == want and recompress.stripped(df).count() == len(want)


def test_equal_windows_have_equal_anchors():
    rng = random.Random(3)
    for _ in range(60):
        size = rng.choice([2, 5, 50])
        seen = {}
        passage = [rng.randrange(size) for _ in range(40)]
        for _ in range(4):
            a = [rng.randrange(size) for _ in range(rng.randrange(30))] + passage + [rng.randrange(size) for _ in range(rng.randrange(30))]
            h = hyperminhash._mix(np.array(a, np.uint64) + np.uint64(1))
            for i, k in enumerate(recompress.anchors(h).tolist()):
                assert seen.setdefault(tuple(a[i : i + 13]), k) == k


def test_suffixes(spark, docs, odd, empty):
    got = rows(suffix.strip(docs))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute.stripped_bytes(PLAIN)
    assert suffix.strip(odd).where("n_removed = 0").count() == 4 and suffix.strip(empty).count() == 0


def test_hot_anchors_are_spread(spark, monkeypatch):
    """One line in every document between different words: no key gets a row of each document, and the result is whole."""
    monkeypatch.setattr(suffix, "HOT", 20)
    monkeypatch.setattr(suffix, "SHARDS", 64)
    rng = random.Random(6)
    line = " ".join(f"line{i}" for i in range(12))
    texts = {d: " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(5)), line, *(f"v{rng.randrange(10**6)}" for _ in range(5))]) for d in range(400)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    docs = common.id_text_part(common.with_part(df))
    keys = suffix.shared_anchors(docs, lambda: suffix.anchors_of)
    sent = suffix._piece_rows(common.packed(docs), keys).where("piece is not null").groupBy("key").count().agg({"count": "max"}).first()[0]
    assert suffix.hot_anchors(keys) and sent < 100
    got = rows(suffix.strip(df))
    assert {d: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for d, r in got.items()} == brute.stripped_bytes(texts)


@pytest.mark.parametrize("direct, held", [(0, 3), (10, 1000), (10**6, 10**6)])
def test_induced_order(direct, held):
    rng = random.Random(4)
    for _ in range(40):
        k = rng.choice([1, 2, 26])
        parts = [bytes(rng.choice(range(97, 97 + k)) for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 9))]
        parts += [p[: rng.randint(1, len(p))] for p in parts]
        raw = b"".join(p + b"\0" for p in parts)
        with tempfile.TemporaryDirectory() as d:
            out = [(int(p), int(x)) for a, b in induced.sorted_suffixes(np.frombuffer(raw + b"\0" * 8, np.uint8), d, 50, direct, held) for p, x in zip(a, b)]
        texts = [raw[p : raw.index(b"\0", p)] for p, _ in out]
        assert sorted(p for p, _ in out) == [i for i, c in enumerate(raw) if c]
        assert texts == sorted(texts, reverse=True)
        for a, b, (_, x) in zip(texts, texts[1:], out[1:]):
            assert x == min(50, len(os.path.commonprefix([a, b])))


def test_pieces(spark, docs, odd, empty):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{TOK}/piece_bpe_32k.model")
    for d, r in rows(pieces.encode_spans(docs, f"{TOK}/piece_bpe_32k.model")).items():
        assert r["ids"] == model.encode(PLAIN[d])
        assert r["begins"][1:] == r["ends"][:-1] and (not r["ids"] or (r["begins"][0], r["ends"][-1]) == (0, len(PLAIN[d].encode())))
    assert pieces.digests(odd, f"{TOK}/piece_bpe_32k.model").count() == 4 and pieces.digests(empty, f"{TOK}/piece_bpe_32k.model").count() == 0


def _trie(entries):
    """A character map as model files hold it, built the slow way: units placed where they do not collide."""
    import struct

    strings, at = b"", {}
    for _, v in entries:
        at[v] = len(strings)
        strings += v + b"\0"
    tree = {}
    for k, v in entries:
        node = tree
        for c in k:
            node = node.setdefault(c, {})
        node[None] = at[v]
    units, used = {0: 0}, {0}

    def place(node, index):
        labels = [0 if c is None else c for c in node]
        offset = next(o for o in range(1, 1 << 16) if all((index ^ o ^ c) not in used for c in labels) and o < 1 << 21)
        units[index] = units.get(index, 0) | offset << 10 | (0x100 if None in node else 0)
        for c in labels:
            used.add(index ^ offset ^ c)
        for c, child in node.items():
            spot = index ^ offset ^ (0 if c is None else c)
            if c is None:
                units[spot] = child | 0x80000000
            else:
                units[spot] = c
                place(child, spot)

    place(tree, 0)
    blob = struct.pack(f"<{max(units) + 1}I", *[units.get(i, 0) for i in range(max(units) + 1)])
    return struct.pack("<I", len(blob)) + blob + strings


def test_character_map_takes_the_longest_prefix_and_keeps_the_source():
    m = pieces.CharacterMap(_trie([("ﬁ".encode(), b"fi"), (b"ab", b"X"), (b"abc", b"YZ"), ("é".encode(), b"e")]))
    assert m.longest(b"abcd", 0) == (3, b"YZ") and m.longest(b"abd", 0) == (2, b"X") and m.longest(b"ad", 0) is None
    model = pieces.PieceModel(f"{TOK}/piece_bpe_32k.model")
    model.map, model.by_word = m, False
    text, starts, ends = model.normalise("aé ﬁabc")
    assert text == "▁ae▁fiYZ" and starts == [0, 0, 1, 3, 4, 4, 7, 7] and ends == [0, 1, 3, 4, 7, 7, 10, 10]
    ids, begins, ends = model.encode("aé ﬁabc")
    assert model.decode(ids.tolist()) == "ae fiYZ" and begins[0] == 0 and ends[-1] == 10


def test_general_path_equals_words():
    model = pieces.PieceModel(f"{TOK}/piece_bpe_32k.model")
    for text in [*PLAIN.values()][:7] + [PLAIN[14], "  two  spaces ▁ mark", "tab\tline\n"]:
        model.by_word = True
        fast = model.encode(text)
        model.by_word = False
        slow = model.encode(text)
        assert all((a == b).all() for a, b in zip(fast, slow)), text


def test_token_files(spark, docs, odd, empty):
    from tokenizers import Tokenizer

    path, at = f"{TOK}/byte_bpe_50k.json", 0
    tok = Tokenizer.from_file(path)
    got = rows(simple8b.token_files(docs, path, files=3, block=64))
    for d in sorted(TEXTS):
        ids = [*tok.encode(PLAIN[d], add_special_tokens=False).ids, 2]
        assert (got[d]["start"], np.frombuffer(got[d]["ids"], "<u4").tolist()) == (at, ids)
        at += len(ids)
    assert simple8b.token_files(odd, path).count() == 2 and simple8b.token_files(empty, path).count() == 0


def test_simple8b_words():
    rng = np.random.default_rng(5)
    for n in (0, 1, 5, 240, 1000):
        for top in (0, 1, 9, 16, 31, 59, 60, 63):
            ids = rng.integers(0, 1 << top, n, np.uint64, endpoint=True) if top < 63 else rng.integers(0, (1 << 64) - 1, n, np.uint64, endpoint=True)
            ids[rng.random(n) < 0.5] >>= np.uint64(top // 2)
            words, literals, blocks = simple8b.encode(ids, 64)
            assert (simple8b.decode(words, literals) == ids).all()
            for k in range(len(blocks)):  # any block by itself
                a, b = (int(blocks[j, 0]) if j < len(blocks) else len(words) for j in (k, k + 1))
                assert (simple8b.decode(words[a:b], literals[int(blocks[k, 1]) :]) == ids[64 * k : 64 * k + 64]).all()


def test_packing(spark, docs, odd, empty):
    path = f"{TOK}/word_bpe_49k.json"
    got = packing.pack(docs, path, size=64).collect()
    assert sorted(r["sequence_id"] for r in got) == list(range(len(got)))
    by_id = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_id] == sorted((r["length"] for r in got), reverse=True)
    assert {r["doc_id"] for r in got} == set(TEXTS) and [r["length"] for r in got if r["doc_id"] == 3] == [1]
    assert all(len(r["ids"]) == 4 * r["length"] for r in got)
    assert packing.pack(odd, path).select("doc_id", "start").count() > 0 and packing.pack(empty, path).count() == 0


def test_chunks_give_the_ids_of_the_whole_text():
    from tokenizers import Tokenizer

    from likeness.llm.tokens import BARE_WORDS, BYTE_LEVEL, ChunkEncoder

    rng = random.Random(6)
    signs = "ab cdÉéßİΣσς’'`́̈ \t\n\r\x0b\x0c\x1c\x85\xa0 ​　.,;:!?*%$&#|()12²½ª×中🙂\x00<|>sStTmMdD'''    "
    for name, cut, folds in (("word_bpe_49k", BARE_WORDS, True), ("byte_bpe_50k", BYTE_LEVEL, False)):
        enc, tok = ChunkEncoder(f"{TOK}/{name}.json", cut, limit=50, folds=folds), Tokenizer.from_file(f"{TOK}/{name}.json")
        texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) + rng.choice(["", "", "<|endoftext|> x"]) for _ in range(3000)]
        for t, ids in zip(texts, enc.encode(texts)):
            assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_toxicity(spark, docs, odd, empty, labels):
    got = crf.judge(docs, labels).collect()
    assert len(got) == len(TEXTS) and all(0 <= r["score"] <= 1 for r in got)
    none = spark.createDataFrame([], NO_LABELS)
    assert {r["score"] for r in crf.judge(odd, none).collect()} == {0.0}
    assert crf.judge(empty, labels).count() == 0 and crf.clean(docs, none).count() == len(TEXTS)
    assert crf.clean(docs, labels).columns == docs.columns


def test_toxic_spans_are_found(spark):
    rng = random.Random(7)
    plain = [f"w{i}" for i in range(200)]
    data, marks = [], []
    for d in range(900):
        w = [rng.choice(plain) for _ in range(40)]
        if d % 4 == 0:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(["vile", "nastyxa", "nastyyo"])
        data.append((d, " ".join(w)))
        marks.append((d, int(d % 4 == 0)))
    got = crf.judge(spark.createDataFrame(data, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")).collect()
    assert all(r["predicted"] == int(r["doc_id"] % 4 == 0) for r in got if r["held_out"])
    for r in got:
        for s in r["spans"]:
            assert set(dict(data)[r["doc_id"]].encode()[s["begin"] : s["end"]].decode().split()) <= {"vile", "nastyxa", "nastyyo"}


def test_marginals_equal_all_paths():
    import itertools

    rng = np.random.default_rng(8)
    for _ in range(20):
        sizes = rng.integers(1, 6, 4)
        x, pairs = rng.normal(0, 2, sizes.sum()), rng.normal(0, 1, (2, 2))
        first = np.zeros(len(x), bool)
        first[np.cumsum(sizes) - sizes] = True
        got, pair, _ = crf.marginals(x, first, pairs)
        at, want, want_pair = 0, [], np.zeros((2, 2))
        for n in sizes:
            paths = list(itertools.product((0, 1), repeat=int(n)))
            w = np.array([np.exp(sum(x[at + i] * y for i, y in enumerate(p)) + sum(pairs[a, b] for a, b in zip(p, p[1:]))) for p in paths])
            w /= w.sum()
            want += [sum(v for v, p in zip(w, paths) if p[i]) for i in range(n)]
            for v, p in zip(w, paths):
                for a, b in zip(p, p[1:]):
                    want_pair[a, b] += v
            at += n
        assert np.allclose(got, want) and np.allclose(pair, want_pair)


def test_gru(spark, docs, odd, empty):
    got, want = rows(gru.score(docs, listed=64, classes=8, size=8)), brute.base_scores(PLAIN)
    for d, r in got.items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[d][:4]
        assert r["base_score"] == pytest.approx(want[d][4], rel=1e-9) and np.isfinite(r["score"])
    assert gru.score(odd).count() == 4 and gru.score(empty).count() == 0


def _small_network():
    v = gru.Vocabulary(np.array([gru.END, 100, 200, 300, 400], np.uint64), np.array([5.0, 9, 7, 3, 1]), 2, np.full(gru.SHAPES, 2.0), 30, 12)
    net = gru.Network(v, 5, seed=3)
    net.w = [x + np.random.default_rng(i).normal(0, 0.3, x.shape).astype(np.float32) for i, x in enumerate(net.w)]
    return net


def test_state_runs_across_windows():
    net, rng = _small_network(), np.random.default_rng(9)
    docs = [rng.integers(0, 20, n) for n in (1, 70, 3, 33, 8)]
    whole = [gru.log_likelihoods(net, [d], 1, 1000)[0] for d in docs]
    assert np.allclose(gru.log_likelihoods(net, docs, 2, 4), whole, rtol=1e-4)


def test_probabilities_sum_to_one():
    net = _small_network()
    total = sum(np.exp(gru.log_likelihoods(net, [np.array([t])], 1, 4)[0]) for t in range(5 + gru.SHAPES))
    assert total == pytest.approx(1, abs=1e-5)


@pytest.mark.parametrize("few", [0, 1 << 20])
@pytest.mark.parametrize("size_of_weights", [1, 60])
def test_classes_taken_together(monkeypatch, few, size_of_weights):
    """Shares and gradients are those of the plain formula, classes alone or together, scores inside the float's range or beyond."""
    monkeypatch.setattr(gru, "FEW", few)
    rng = np.random.default_rng(12)
    v = gru.Vocabulary(np.array([gru.END, *range(100, 123)], np.uint64), np.arange(24.0, 0, -1), 6, np.full(gru.SHAPES, 2.0), 300, 90)
    net = gru.Network(v, 5, seed=4)
    net.w = [(x + rng.normal(0, 0.3, x.shape)) * size_of_weights for x in net.w]
    s, target = rng.uniform(-1, 1, (200, 5)), rng.integers(0, 24 + gru.SHAPES, 200)
    wc, bc, wo, bo = net.w[4:]
    grads = [np.zeros_like(x) for x in net.w]
    got, ds = net.losses(s, target, grads)
    want, by = np.zeros(200), [np.zeros((200, 5)), *[np.zeros_like(x) for x in (wc, bc, wo, bo)]]

    def plain(i, w, b, k):
        y = w @ s[i] + b
        p = np.exp(y - y.max())
        p /= p.sum()
        want[i] += np.log(p[k]) if p[k] else y[k] - y.max() - np.log(np.exp(y - y.max()).sum())
        p[k] -= 1
        return p

    for i, t in enumerate(target):
        p = plain(i, wc.T, bc, t // v.width if t < 24 else v.classes + t - 24)
        by[0][i] += p @ wc.T
        by[1] += np.outer(s[i], p)
        by[2] += p
        if t < 24:
            a = t // v.width * v.width
            p = plain(i, wo[a : a + v.width], bo[a : a + v.width], t - a)
            by[0][i] += p @ wo[a : a + v.width]
            by[3][a : a + v.width] += np.outer(p, s[i])
            by[4][a : a + v.width] += p
    assert np.allclose(got, want) and np.allclose(net.losses(s, target)[0], want)
    for x, y in zip([ds, *grads[4:]], by):
        assert np.allclose(x, y)


def test_gradients():
    net, rng = _small_network(), np.random.default_rng(10)
    net.w = [x.astype(np.float64) for x in net.w]
    docs = [rng.integers(0, 20, 6), rng.integers(0, 20, 3)]

    def loss():
        return -gru.log_likelihoods(net, docs, 2, 8).sum()

    (ids, fresh, target, doc, live), = gru.windows(docs, net, 2, 8)
    states, _, tape = net.states(ids, fresh, np.zeros((live, 5)), True)
    grads = [np.zeros_like(x) for x in net.w]
    real = np.flatnonzero(doc.reshape(-1) >= 0)
    _, ds = net.losses(states.reshape(-1, 5)[real], target.reshape(-1)[real], grads)
    full = np.zeros((states.size // 5, 5))
    full[real] = ds
    net.back(ids, fresh, tape, full.reshape(states.shape).astype(np.float32), grads)
    for w, g in zip(net.w, grads):
        for _ in range(4):
            spot = tuple(rng.integers(0, k) for k in w.shape)
            old, step = w[spot], 1e-2
            w[spot] = old + step
            up = loss()
            w[spot] = old - step
            down = loss()
            w[spot] = old
            assert g[spot] == pytest.approx((up - down) / (2 * step), abs=2e-2, rel=5e-2)


@pytest.mark.parametrize("operator", [recompress.strip, recompress.stripped, suffix.strip])
def test_texts_are_shuffled_once(spark, operator):
    """Both joins of the packed texts read one shuffle of them, and rows travel deflated."""
    rng = random.Random(8)
    texts = {d: " ".join([*(f"w{rng.randrange(10**6)}" for _ in range(30)), PASSAGE, f"v{d}"]) for d in range(40)}
    df = spark.createDataFrame([(d, t, d * 1.5, "x") for d, t in texts.items()], "doc_id int, text string, rest double, part string").repartition(4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = operator(df)
        plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
        below = [b for a, b in zip(plan, plan[1:]) if "Exchange hashpartitioning(doc_id" in a and "ReusedExchange" not in a]
        assert sum("packed" in x for x in below) == 1 and any("ReusedExchange" in x and "packed" in x for x in plan)
        if operator is recompress.stripped:
            want = {d: kept.decode() for d, (_, _, kept) in brute.stripped_words(texts).items()}
            assert {r["doc_id"]: (r["text"], r["rest"], r["part"]) for r in out.collect()} == {d: (t, d * 1.5, "x") for d, t in want.items()} and out.schema == df.schema
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_only_contested_windows_are_sorted(monkeypatch):
    """Pieces that share their anchor by chance leave before the sort, and what is told is that of the plain version."""
    import pyarrow as pa

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    passage = " ".join(word() for _ in range(30))
    gram = "sixteen byte gram "
    pieces = [(" ".join(word() for _ in range(4)) + gram + " ".join(word() for _ in range(8)))[:90].ljust(90, "x") for _ in range(300)]
    for d in range(0, 300, 10):
        pieces[d] = passage[d // 10 : d // 10 + 100]
    rows = [(7, 0, d, "", 1000, len(t), t.encode()) for d, t in enumerate(pieces)]
    rng.shuffle(rows)
    names = ["key", "salt", "doc_id", "part", "at", "size", "piece"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows[a : a + 100]), kinds)], names) for a in range(0, 300, 100)]
    sorted_bytes, plain = [], suffix.sorted_suffixes

    def counting(text, *args):
        sorted_bytes.append(len(text))
        return plain(text, *args)

    monkeypatch.setattr(suffix, "sorted_suffixes", counting)
    gone = {d: set() for d in range(300)}
    for out in suffix._shard(batches):
        for r in out.to_pylist():
            gone[r["doc_id"]].update(range(r["first"] - 1000, r["end"] - 1000))
    want = brute.stripped_bytes(dict(enumerate(pieces)))
    assert {d: len(x) for d, x in gone.items()} == {d: w[1] for d, w in want.items()} and sum(map(len, gone.values()))
    assert 0 < sum(sorted_bytes) < sum(map(len, pieces)) / 3


def test_windows_of_a_group_are_small():
    """A group's tokens are dealt to lanes in order and take less than 50 bytes each (88 when they were sorted as long integers)."""
    import tracemalloc

    rng = np.random.default_rng(5)
    tokens = [rng.integers(0, 2000, n).astype(np.int32) for n in rng.integers(1, 900, 900)]
    n = sum(map(len, tokens))
    net = type("Net", (), {"start": 2064})()
    tracemalloc.start()
    seen = {d: [] for d in range(len(tokens))}
    made = gru.windows(tokens, net, 192, 24)
    first = next(made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 50 * n
    for ids, fresh, target, doc, live in [first, *made]:
        assert ids.shape == doc.shape == target.shape and ids.shape[1] == live
        for lane in range(live):
            for i, f, t, d in zip(ids[:, lane], fresh[:, lane], target[:, lane], doc[:, lane]):
                if d >= 0:
                    assert f == (not seen[d]) and i == (net.start if f else seen[d][-1])
                    seen[d].append(t)
    assert all(seen[d] == t.tolist() for d, t in enumerate(tokens))


def test_choosing_words_is_small():
    """Ids of two bytes are packed with one or two bytes of notes each where there were long integers and floats."""
    import tracemalloc

    ids = np.random.default_rng(2).integers(0, 50_000, 300_001).astype(np.uint64)
    tracemalloc.start()
    sel = simple8b._choices(simple8b._bits(ids), 4096)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * len(ids) and len(sel) == len(ids)
    for n, block in ((0, 4096), (1, 4096), (5000, 4096), (4096, 64), (300_001, 4096), (130, 7)):
        words, literals, index = simple8b.encode(ids[:n], block)
        assert (simple8b.decode(words, literals) == ids[:n]).all() and int(index[:, 2].sum()) == n


def test_hashed_words_are_the_words():
    """All words of many texts are hashed in one go: equal words alike, others apart, in the order of the texts."""
    rng = random.Random(6)
    texts = [b"", b" \t\n\x0b\x0c\r", b"x" * 200 + b" y", "é ü \u0085 \x1c a\x1fb".encode(), *(b"q" * k + b"\n" + b"q" * (k + 1) for k in range(70))]
    texts += [bytes(rng.choice(b"ab .\n\xc3") for _ in range(rng.randrange(60))) for _ in range(200)]
    names: dict[bytes, int] = {}
    for some in (texts, texts[::-1], [], [b""]):
        got = common.word_hashes(some)
        assert len(got) == len(some)
        for text, hashes in zip(some, got):
            words = common.WORDS.findall(text)
            assert words == common.plain_words(text) and len(words) == len(hashes)
            assert all(names.setdefault(w, h) == h for w, h in zip(words, hashes.tolist()))
    assert len(set(names.values())) == len(names)


def test_workers_drop_what_other_operators_keep():
    """A worker lives on from stage to stage: the next operator's task drops a vocabulary that the last one kept."""
    import gc
    import weakref

    class Thing:
        pass

    first = weakref.ref(common.kept(("a",), Thing))
    assert common.kept(("a",), Thing) is first()
    second = weakref.ref(common.kept(("b",), Thing))
    gc.collect()
    assert first() is None and second() is not None
    common.release()
    gc.collect()
    assert second() is None


@pytest.mark.parametrize("common_words", [0, 3])
def test_common_words_need_no_join(spark, docs, monkeypatch, common_words):
    """Whether a word's count is looked up in the task or joined changes no document's figures."""
    monkeypatch.setattr(gru, "COMMON", common_words)
    want = brute.base_scores(PLAIN)
    for d, r in rows(gru.score(docs, listed=8, classes=2, size=4)).items():
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == want[d][:4]
        assert r["base_score"] == pytest.approx(want[d][4], rel=1e-9)


def test_scoring_a_group_takes_few_bytes_a_token():
    """The lanes of a group are one row of four-byte tokens: less than 16 bytes a token (they took more than 30)."""
    import tracemalloc

    rng = np.random.default_rng(8)
    tokens = [rng.integers(0, 2000, n).astype(np.int32) for n in rng.integers(1, 900, 1500)]
    net = type("Net", (), {"start": 2064})()
    tracemalloc.start()
    seen = sum(int((doc >= 0).sum()) for *_, doc, _ in gru.windows(tokens, net, 192, 24))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == sum(map(len, tokens)) and peak < 16 * seen


def test_shaped_hashes_and_their_places():
    """Words' shapes follow their last byte, length and bytes beyond ASCII wherever they stand; tables find exactly what they hold."""
    rng = random.Random(15)
    pieces = [b"a", b"z.", b"9", b"\xc3\xa9", b"abcdefg", b"abcdefgh", b"x" * 40, b"y" * 63, "é".encode() + b"q" * 70, b"q" * 70 + "ü".encode() + b";", b"w" * 90, "日本".encode()]
    texts = [b"", b" \n ", *(b" ".join(rng.choice(pieces) + rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(60))]
    every, cuts = gru.shaped_hashes(texts)
    names: dict[bytes, int] = {}
    for text, a, b in zip(texts, cuts.tolist(), cuts[1:].tolist()):
        words = text.split()
        assert b - a == len(words) + 1 and every[b - 1] == gru.END
        for w, h in zip(words, every[a : b - 1].tolist()):
            kind = 0 if w[-1:].islower() else 1 if w[-1:] in b".,;:" else 2 if w[-1] < 128 else 3
            assert h & 15 == kind * 4 + 2 * (not w.isascii()) + (len(w) > 7) and h > 31
            assert names.setdefault(w, h) == h
    assert len(set(names.values())) == len(names)
    some = np.random.default_rng(3).integers(0, 1 << 63, 5000).astype(np.uint64)
    for keys in (some, some[:1], some[:0], np.arange(300, dtype=np.uint64) << np.uint64(50), np.arange(300, dtype=np.uint64)):
        asked = np.concatenate([keys[::2], keys[::-3], keys[:50] + np.uint64(1 << 40), some[:9] ^ np.uint64(5)])
        at = {int(k): i for i, k in enumerate(keys)}
        assert gru.Places(keys).find(asked).tolist() == [at.get(int(k), -1) for k in asked]


def test_pieces_are_made_for_all_texts_at_once():
    """Pieces are the runs of shared anchors, cut after 64 windows, windows of hot anchors alone; few Python calls make one (more than six did)."""
    import zlib

    import pyarrow as pa

    rng = random.Random(21)
    words = [rng.randbytes(rng.randrange(2, 9)).hex() for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=60)) for _ in range(30)]
    texts = ["", "x" * 49, "x" * 50, "ab" * 400, *(" ".join(rng.choice([*passages, rng.choice(words)]) for _ in range(rng.randrange(12))) for _ in range(300)), passages[0], "é" * 60]
    texts += texts[5:40]
    keys = [None if i % 9 == 8 else sorted(set(a.tolist())) for i, a in enumerate(suffix.anchors_of([t.encode() for t in texts]))]
    keys = [k if k is None or i % 3 else k[::2] for i, k in enumerate(keys)]
    hot = np.array(sorted({k for some in keys if some for k in some})[::40], np.uint64)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(100, 100 + len(texts)), pa.int64()), pa.array([""] * len(texts)), pa.array([zlib.compress(t.encode()) for t in texts]), pa.array(keys, pa.list_(pa.int64()))],
        ["doc_id", "part", "packed", "keys"],
    )
    want, gone = set(), {}  # plain: run by run
    least: dict[bytes, int] = {}
    every = []
    for d, (text, some) in enumerate(zip(texts, keys), 100):
        raw, (anchors,) = text.encode(), suffix.anchors_of([text.encode()])
        a = 0
        while some and a < len(anchors):
            b = a + 1
            if anchors[a] not in hot:
                while b < len(anchors) and anchors[b] == anchors[a] and b - a < 64:
                    b += 1
            if anchors[a] in some:
                every.append((d, a, raw[a : b + 49], int(suffix.window_keys(raw, np.array([a]))[0].view(np.int64)) if anchors[a] in hot else int(anchors[a])))
            a = b
    for d, _, piece, _ in every:
        least[piece] = min(d, least.get(piece, d))
    for d, a, piece, key in every:
        if least[piece] == d:
            want.add((key, 0, d, "", a, len(piece), piece))
        else:
            gone.setdefault(d, set()).update(range(a, a + len(piece)))
    calls = 0
    list(suffix._pieces(iter([batch]), hot))  # what is imported on first use does not count

    def count(frame, event, arg):
        nonlocal calls
        calls += event in ("call", "c_call")

    sys.setprofile(count)
    try:
        out = list(suffix._pieces(iter([batch.slice(0, 50), batch.slice(50)]), hot))
    finally:
        sys.setprofile(None)
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert len(every) > 3000 and len(hot) > 5
    assert {r for r in got if r[6] is not None} == want and sum(r[6] is not None for r in got) == len(want)
    told = {}
    for _, salt, d, _, at, size, piece in got:
        if piece is None:
            assert salt == 1 and not told.setdefault(d, set()) & set(range(at, at + size))
            told[d].update(range(at, at + size))
    assert told == gone and calls < 5 * len(every)


def test_equal_pieces_are_one_number():
    """Whether no smaller document has a piece; each different piece is held once."""
    rng, places = random.Random(4), {}
    texts, docs = [rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(40)], np.array([rng.randrange(-3, 9) for _ in range(40)])
    number = np.concatenate([suffix._numbered(places, texts[:25]), suffix._numbered(places, texts[25:])])
    assert [list(places)[i] for i in number] == texts and len(places) == len(set(texts))
    assert suffix._alone(number, docs).tolist() == [d == min(e for u, e in zip(texts, docs) if u == t) for t, d in zip(texts, docs)]
    assert not len(suffix._alone(suffix._numbered({}, []), docs[:0]))


def test_frequent_words_come_alone(spark):
    """No partition sends its own most frequent words to the driver: the words above the bar are picked by their counts."""
    table = spark.createDataFrame([(100 + i, c) for i, c in enumerate([9, 9, 7, 5, 5, 5, 2, 1])] + [(gru.END, 50)], "h long, c long").repartition(4)
    got = {n: sorted(gru.frequent(table, n)["c"].tolist()) for n in (0, 1, 2, 3, 5, 6, 8, 100)}
    assert got == {0: [], 1: [], 2: [9, 9], 3: [7, 9, 9], 5: [7, 9, 9], 6: [5, 5, 5, 7, 9, 9], 8: [1, 2, 5, 5, 5, 7, 9, 9], 100: [1, 2, 5, 5, 5, 7, 9, 9]}
    assert not len(gru.frequent(table.limit(0), 5))


def test_scores_do_not_depend_on_the_look_up(spark, docs, monkeypatch):
    """A word's share of its shape class is part of the score whether its count is looked up or joined."""
    got = []
    for common_words in (0, 3, 1 << 17):
        monkeypatch.setattr(gru, "COMMON", common_words)
        got.append({d: r["score"] for d, r in rows(gru.score(docs, listed=8, classes=2, size=4)).items()})
    for other in got[1:]:
        assert other == pytest.approx(got[0], rel=1e-6)
