"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Labels exist per document, so token labels are derived: a token of a toxic training text is toxic
where its word, beginning or ending is tied to toxic texts nearly as closely as the closest one
in that text. The association table comes from one part of the training rows; the field's weights
(association bins of the token, and label pairs) and the score's calibration come from the rest.
Forward-backward gives each token's marginal; a document's score is a logistic function of the
sum and the maximum of its marginals, and runs of tokens over one half are its spans.

Training takes a sample of at most about ``max_labelled`` labelled rows, chosen by a hash of the
doc_id. Scoring takes every row and whole texts. Null texts have no tokens and get the score of
no evidence. Null labels teach nothing, of repeated labels the highest counts; without labels
of both kinds nothing can be learned: every score is 0 and no text is rejected.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import WORDS, id_and_text, plain_words, release, rows_of, slices

TRIM = b"".join(bytes([c]) for c in range(33, 127) if not chr(c).isalnum())
BOUNDS = [-1.0, 0.0, 0.5, 1.0, 1.5, 2.0, 3.0, 4.0]  # of association; one more bin is "not seen"
KINDS = 4  # word, two beginnings, one ending
BINS = len(BOUNDS) + 2


def features(word: bytes) -> list[bytes]:
    """The word in lower case without punctuation around it, its first 4 and 5 characters, its last 5; short words have no parts."""
    w = word.decode(errors="replace").lower().strip(TRIM.decode())
    out = ["w" + w]
    if len(w) > 5:
        out += ["a" + w[:4], "b" + w[:5], "z" + w[-5:]]
    return [x.encode() for x in out]


def association(n1: float, n0: float, all1: float, all0: float) -> float:
    """Log odds of a feature's document counts, less 1.64 standard errors."""
    a, b = n1 + 0.5, n0 + 0.5
    return math.log(a / (all1 + 1)) - math.log(b / (all0 + 1)) - 1.64 * math.sqrt(1 / a + 1 / b)


@dataclass
class Field:
    """A trained model; plain data, so it travels to the tasks by value."""

    table: dict[bytes, float]
    emission: object  # [KINDS, BINS]
    pairs: object  # [2, 2] label before, label
    calibration: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    constant: float | None = None  # the score where nothing could be learned

    def combination(self, word: bytes) -> tuple[int, ...]:
        """Bin of each feature kind; the last bin stands for a feature without a count."""
        import bisect

        got = [0] * KINDS
        for k, f in enumerate(features(word)):
            value = self.table.get(f)
            got[k] = BINS - 1 if value is None else bisect.bisect_right(BOUNDS, value)
        for k in range(len(features(word)), KINDS):
            got[k] = BINS - 1
        return tuple(got)

    def strength(self, word: bytes) -> float:
        return max((self.table.get(f, -9.0) for f in features(word)), default=-9.0)


def marginals(x, first, pairs):
    """Forward-backward over many texts at once: (P(label 1), expected label pairs, log-likelihood's normaliser).

    ``x``: per token the score of label 1 less that of label 0; ``first``: true where a text begins.
    The texts stand in one row, cut into equal lanes. A first pass finds the 2x2 product of each
    lane, a short one joins the lanes, a second pass fills them in; a text's begin forgets what was
    before, so no state crosses texts and a very long text takes no longer than many short ones.
    """
    import numpy as np

    n = len(x)
    if not n:
        return np.zeros(0), np.zeros((2, 2)), 0.0
    steps = max(1, int(math.sqrt(n)))
    lanes = -(-n // steps)
    pad = lanes * steps - n
    e = np.exp(np.clip(np.concatenate([x, np.zeros(pad)]), -30, 30)).reshape(lanes, steps).T.copy()
    start = np.concatenate([first, np.ones(pad, bool)]).reshape(lanes, steps).T.copy()
    t = np.exp(pairs)

    def move(a, b, k):  # one step of unnormalised (label 0, label 1)
        s = a + b
        p = np.where(start[k], s * 0.5, a * t[0, 0] + b * t[1, 0])
        q = np.where(start[k], s * 0.5, a * t[0, 1] + b * t[1, 1]) * e[k]
        return p, q

    # products of lanes: images of the two unit vectors
    u, v = (np.ones(lanes), np.zeros(lanes)), (np.zeros(lanes), np.ones(lanes))
    for k in range(steps):
        u, v = move(*u, k), move(*v, k)
        scale = u[0] + u[1] + v[0] + v[1]
        u, v = (u[0] / scale, u[1] / scale), (v[0] / scale, v[1] / scale)
    a, b = np.empty(lanes), np.empty(lanes)
    p, q = 0.5, 0.5
    for i in range(lanes):
        a[i], b[i] = p, q
        p, q = p * u[0][i] + q * v[0][i], p * u[1][i] + q * v[1][i]
        s = p + q
        p, q = p / s, q / s
    f0, f1 = np.empty((steps, lanes)), np.empty((steps, lanes))
    total = 0.0
    live = np.concatenate([np.ones(n), np.zeros(pad)]).reshape(lanes, steps).T
    for k in range(steps):
        a, b = move(a, b, k)
        s = a + b
        total += float(np.log(s) @ live[k])
        a, b = a / s, b / s
        f0[k], f1[k] = a, b
    # backwards: weight of what follows given the label here
    nxt_start = np.concatenate([start.T.reshape(-1)[1:], [True]]).reshape(lanes, steps).T
    nxt_e = np.concatenate([e.T.reshape(-1)[1:], [1.0]]).reshape(lanes, steps).T

    def back(a, b, k):
        p = np.where(nxt_start[k], 1.0 * (a + b), t[0, 0] * a + t[0, 1] * nxt_e[k] * b)
        q = np.where(nxt_start[k], 1.0 * (a + b), t[1, 0] * a + t[1, 1] * nxt_e[k] * b)
        return p, q

    u, v = (np.ones(lanes), np.zeros(lanes)), (np.zeros(lanes), np.ones(lanes))
    for k in range(steps - 1, -1, -1):
        u, v = back(*u, k), back(*v, k)
        scale = u[0] + u[1] + v[0] + v[1]
        u, v = (u[0] / scale, u[1] / scale), (v[0] / scale, v[1] / scale)
    a, b = np.empty(lanes), np.empty(lanes)
    p, q = 0.5, 0.5
    for i in range(lanes - 1, -1, -1):
        a[i], b[i] = p, q
        p, q = p * u[0][i] + q * v[0][i], p * u[1][i] + q * v[1][i]
        s = p + q
        p, q = p / s, q / s
    out = np.empty((steps, lanes))
    pair = np.zeros((2, 2))
    for k in range(steps - 1, -1, -1):
        na, nb = a, b
        a, b = back(a, b, k)
        s = a + b
        a, b = a / s, b / s
        m = f0[k] * a + f1[k] * b
        out[k] = f1[k] * b / m
        w = np.array([[f0[k] * t[0, 0] * na, f0[k] * t[0, 1] * nxt_e[k] * nb], [f1[k] * t[1, 0] * na, f1[k] * t[1, 1] * nxt_e[k] * nb]])
        w = np.where(nxt_start[k], 0.0, w)
        z = w.sum((0, 1))
        pair += np.where(z > 0, w / np.where(z > 0, z, 1), 0).sum(2)
    return out.T.reshape(-1)[:n], pair, total


class Tagger:
    """Scores texts with a field; remembers each word's score."""

    def __init__(self, model: Field, limit: int = 400_000):
        self.model, self.limit, self.known = model, limit, {}

    def _score(self, word: bytes) -> float:
        return float(sum(self.model.emission[k][b] for k, b in enumerate(self.model.combination(word))))

    def marginals(self, texts: list[list[bytes]]):
        """One array of marginals per list of words."""
        import numpy as np

        if len(self.known) > self.limit:
            self.known = {}
        for w in set().union(*texts).difference(self.known):
            self.known[w] = self._score(w)
        sizes = np.array([len(t) for t in texts], np.int64)
        x = np.fromiter((s for t in texts for s in map(self.known.__getitem__, t)), float, int(sizes.sum()))
        first = np.zeros(len(x), bool)
        begins = np.cumsum(sizes) - sizes
        first[begins[sizes > 0]] = True
        p, _, _ = marginals(x, first, np.asarray(self.model.pairs))
        return [p[b : b + n] for b, n in zip(begins, sizes)]


def evidence(p) -> tuple[float, float, float]:
    """What a document's score is made of: no-token-toxic odds, sum and maximum of the marginals, all finite."""
    import numpy as np

    if not len(p):
        return 0.0, 0.0, 0.0
    return float(min(-np.log1p(-np.minimum(p, 1 - 1e-9)).sum(), 20.0)), math.log1p(float(p.sum())), float(p.max())


def _calibrated(c, e) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, c[0] + sum(w * x for w, x in zip(c[1:], e))))))


def scores(df: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, spans (byte offsets ``begin``, ``end`` in the text and the mean marginal of each toxic run), evidence."""

    def work(batches):
        import pyarrow as pa

        release()
        tagger = Tagger(model)
        for docs, texts in rows_of(batches, 2 << 20):
            out = []
            for doc, text, p in zip(docs, texts, tagger.marginals([plain_words(t) for t in texts])):
                e = evidence(p)
                spans = []
                if e[2] >= 0.5:
                    last = -2
                    for i, m in enumerate(WORDS.finditer(text)):
                        if p[i] >= 0.5:
                            if last == i - 1:
                                spans[-1]["end"] = m.end()
                                spans[-1]["marginal"] = max(spans[-1]["marginal"], float(p[i]))
                            else:
                                spans.append({"begin": m.start(), "end": m.end(), "marginal": float(p[i])})
                            last = i
                out.append((doc, model.constant if model.constant is not None else _calibrated(model.calibration, e), spans, list(e)))
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["doc_id", "score", "spans", "evidence"])

    return id_and_text(df, id_col, text_col).mapInArrow(work, "doc_id long, score double, spans array<struct<begin:long,end:long,marginal:double>>, evidence array<double>")


def training_rows() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, field_docs: int = 600, rounds: int = 60, least: int = 2) -> Field:
    """Fit on ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic); rows of the held-out fold are never read.

    ``max_labelled`` bounds the labelled rows, ``field_docs`` the texts that fit the field's
    weights, ``least`` is the number of toxic texts below which a feature is not kept.
    """
    import numpy as np

    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(training_rows())
    n, rate = marks.agg(F.count(F.lit(1)), F.coalesce(F.avg("toxic"), F.lit(0.0))).first()
    if not n or rate in (0.0, 1.0):
        return Field({}, np.zeros((KINDS, BINS)), np.zeros((2, 2)), constant=0.0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(10)), F.lit(1 << 20))
    chosen = marks.where(draw < int((1 << 20) * min(1.0, max_labelled / n)) + 1)
    sample = cut_lineage(id_and_text(docs).join(F.broadcast(chosen), "doc_id").withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3))))
    lexicon, rest = sample.where("part < 2"), sample.where("part = 2")

    def count(batches):
        import pyarrow as pa

        release()
        for batch in batches:
            got: dict[bytes, list[int]] = {}
            for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist()):
                for f in {f for w in set(plain_words(text.encode())) for f in features(w)}:
                    got.setdefault(f, [0, 0])[1 - int(toxic)] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), *[pa.array([v[i] for v in got.values()], pa.int64()) for i in (0, 1)]], ["f", "n1", "n0"])

    counted = lexicon.select("text", "toxic").mapInArrow(count, "f binary, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    sizes = {(r[0], r[1]): r[2] for r in sample.groupBy("part", "toxic").count().collect()}
    all1, all0 = (sum(v for (part, y), v in sizes.items() if part < 2 and y == label) for label in (1, 0))
    table = {bytes(r["f"]): association(r["n1"], r["n0"], all1, all0) for r in counted.where(F.col("n1") >= least).toLocalIterator()}
    order = F.xxhash64("doc_id", F.lit(12))
    picked = [r for y in (1, 0) for r in rest.where(F.col("toxic") == y).orderBy(order).limit(field_docs // 2).select("text", "toxic").collect()]
    model = Field(table, np.zeros((KINDS, BINS)), np.zeros((2, 2)))
    _fit(model, [(plain_words(r["text"].encode()), int(r["toxic"])) for r in picked], rounds)
    got = scores(rest, model).join(F.broadcast(chosen), "doc_id").select("evidence", "toxic").collect()  # at most max_labelled rows
    model.calibration = _logistic(np.array([r["evidence"] for r in got]).reshape(-1, 3), np.array([r["toxic"] for r in got], float), float(rate))
    return model


def _fit(model: Field, texts: list[tuple[list[bytes], int]], rounds: int) -> None:
    """Gradient ascent (Adam) on the conditional likelihood of the derived token labels."""
    import numpy as np

    combos, ys, first = [], [], []
    for words, toxic in texts:
        power = [model.strength(w) for w in words]
        bar = max(1.0, 0.6 * max(power, default=0.0))
        for i, w in enumerate(words):
            combos.append(model.combination(w))
            ys.append(toxic and power[i] >= bar)
            first.append(i == 0)
    if not combos:
        return
    c, y, first = np.array(combos), np.array(ys, float), np.array(first)
    at = c + BINS * np.arange(KINDS)
    goal = np.zeros(KINDS * BINS)
    for k in range(KINDS):
        goal += np.bincount(at[:, k], y, KINDS * BINS)
    before, here = y[:-1].astype(int), y[1:].astype(int)
    inner = ~first[1:]
    goal_pairs = np.bincount(2 * before[inner] + here[inner], minlength=4).reshape(2, 2).astype(float)
    w, t = np.zeros(KINDS * BINS), np.zeros((2, 2))
    w[: BINS * KINDS] = -0.5
    size = max(1.0, y.sum())
    m, s = np.zeros(KINDS * BINS + 4), np.zeros(KINDS * BINS + 4)
    for step in range(1, rounds + 1):
        p, pairs, _ = marginals(w[at].sum(1), first, t)
        grad = goal.copy()
        for k in range(KINDS):
            grad -= np.bincount(at[:, k], p, KINDS * BINS)
        g = np.concatenate([(grad - 0.1 * w) / size, ((goal_pairs - pairs) / len(y)).reshape(-1) - 0.001 * t.reshape(-1)])
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        move = 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)
        w, t = w + move[:-4], t + move[-4:].reshape(2, 2)
    model.emission, model.pairs = w.reshape(KINDS, BINS), t


def _logistic(x, y, rate: float, rounds: int = 30) -> tuple[float, ...]:
    """Ridge-penalised logistic regression by Newton steps."""
    import numpy as np

    if len(y) < 10 or y.min() == y.max():
        return (math.log((rate + 1e-3) / (1 - rate + 1e-3)) - 1.0, 1.0, 0.0, 0.0)
    a = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(4), np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        h = (a * (p * (1 - p))[:, None]).T @ a + ridge
        w = w + np.linalg.solve(h, a.T @ (y - p) - ridge @ w)
    return tuple(float(v) for v in w)


def judge(docs: DataFrame, labels: DataFrame, bar: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= ``bar``), spans; one row per document."""
    plain = id_and_text(docs, id_col, text_col)
    model = learn(plain, labels, **options)
    out = scores(plain, model)
    return out.select("doc_id", F.coalesce(~training_rows(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= bar).cast("int").alias("predicted"), "spans")


def clean(df: DataFrame, labels: DataFrame, bar: float = 0.3, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``df`` with a score below ``bar``, all columns as they are; texts are scored where they lie, without a shuffle."""
    model = learn(id_and_text(df, id_col, text_col), labels, **options)
    if model.constant is not None:  # nothing could be learned: nothing is rejected
        return df

    def work(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        release()
        tagger = Tagger(model)
        for batch in batches:
            where = batch.schema.names.index(text_col)
            sizes = pc.fill_null(pc.binary_length(batch.column(where)), 0).to_pylist()
            for a, b in slices(sizes, 2 << 20):
                part = batch.slice(a, b - a)
                words = [plain_words(t or b"") for t in part.column(where).cast(pa.binary()).to_pylist()]
                yield part.filter(pa.array([_calibrated(model.calibration, evidence(p)) < bar for p in tagger.marginals(words)], pa.bool_()))

    return df.mapInArrow(work, df.schema)
