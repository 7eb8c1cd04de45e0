"""Log-likelihood of whole documents under a gated recurrent network over words.

Tokens are words (A-Z in lower case) and one end per document. The softmax is factored into
classes: the ``listed`` most frequent tokens form ``classes`` classes by frequency with a softmax of
their own inside; all other words fall into 16 classes by their shape, where a word's share is its
count plus one over the class total (plus one for a word never seen). So the probability of a
token is P(class | state) * P(token | class, state), and rare words need no weights.

Every training document is used: in each round all tasks start from the same weights, run truncated
backpropagation (numpy) over their part of the round's documents, and the weights are averaged by
tokens in Spark. Documents stand in lanes one after the other; the state runs on from window to
window and begins anew with each document, in training as in scoring, so a document's score covers
all its tokens whatever its length. Counts cover all training documents and are joined to the rare
words of each document by a 60-bit hash; listed words and the ``COMMON`` next ones never reach that join, so it has no hot keys.

Null texts are a document of the end alone. Without training documents the weights stay as they
start. Rows that repeat a doc_id or have none are scored for themselves (ids need not be unique).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import place_hashes, release, rows_of, word_places

SHAPES = 16
FEW = 1 << 14  # scores of classes that are computed together
BLOCK = 1 << 13  # weights that are stepped together
END = 1 << 4  # the end's "hash"; words' hashes are kept away from it


#: What a word's last byte adds to its shape: a letter, a sign of a sentence, other ASCII, the rest.
KINDS = bytes(0 if 97 <= c <= 122 else 4 if c in b".,;:" else 8 if c < 128 else 12 for c in range(256))


def shaped_hashes(texts: list[bytes]):
    """(hashes, cuts): 60-bit hashes of the words of all texts (A-Z in lower case) with each word's shape in the lowest 4 bits, an end after each text; each text's range of them."""
    import numpy as np

    row, first, end, cuts = word_places(texts)
    raw = np.frombuffer(row, np.uint8)
    foreign = np.zeros(len(first), np.uint64)
    hashes = place_hashes(row, first, end, foreign)
    shape = np.frombuffer(KINDS, np.uint8).take(raw.take(end - 1))
    shape |= end - first > 7
    shape |= ((foreign & np.uint64(0x8080808080808080)) != 0).view(np.uint8) << np.uint8(1)
    n = len(texts)
    every = np.full(len(first) + n, np.uint64(END))
    word = np.ones(len(every), bool)
    word[cuts[1:] + np.arange(n)] = False
    hashes &= ~np.uint64(15)
    np.maximum(hashes, np.uint64(32), out=hashes)
    hashes |= shape
    every[word] = hashes
    return every, cuts + np.arange(n + 1)


class Places:
    """Where each of some distinct 64-bit hashes stands, by tables of slots: what finds its slot taken goes to the next table."""

    def __init__(self, hashes):
        import numpy as np

        self.hashes, self.tables = hashes, []
        left = np.arange(len(hashes), dtype=np.int32)
        while len(left):
            bits = max(4, (8 * len(left) - 1).bit_length())
            factor = np.uint64((0x9E3779B97F4A7C15 + 0xD1342543DE82EF96 * len(self.tables)) % (1 << 64))
            slot = (hashes[left] * factor) >> np.uint64(64 - bits)
            table = np.zeros(1 << bits, np.int32)
            table[slot] = left
            more = table[slot] != left
            crowded = np.unique(slot[more])
            table[crowded] = ~table[crowded]  # below zero: the next table has more of this slot
            self.tables.append((factor, np.uint64(64 - bits), table))
            left = left[more]

    def find(self, h):
        """The place of each hash, or -1."""
        import numpy as np

        out, which = np.full(len(h), -1, np.int32), None
        for factor, shift, table in self.tables:
            told = table.take(((h * factor) >> shift).view(np.int64), mode="clip")
            at = told ^ (told >> 31)  # turned back
            found = self.hashes.take(at, mode="clip") == h
            if which is None:
                np.copyto(out, at, where=found)
            else:
                out[which[found]] = at[found]
            more = np.flatnonzero((told < 0) & ~found)
            if not len(more):
                break
            h, which = h[more], more if which is None else which[more]
        return out


def training_rows() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2, F.lit(True))


@dataclass
class Vocabulary:
    """Listed tokens by falling frequency (the end first), and the totals of the training tokens."""

    hashes: object  # unsigned 64-bit, in list order
    counts: object
    classes: int
    shape_totals: object  # per shape: counts plus one of its rare words, plus one
    tokens: int
    distinct: int

    def __post_init__(self):
        import numpy as np

        self.places = Places(self.hashes)
        n = len(self.hashes)
        self.width = -(-n // self.classes)
        self.class_of = np.arange(n) // self.width

    def inputs(self, h):
        """List position of each token, or list length + shape."""
        import numpy as np

        at = self.places.find(h)
        rare = np.flatnonzero(at < 0)
        at[rare] = len(self.hashes) + (h[rare] & np.uint64(15)).astype(np.int32)
        return at


class Network:
    """Weights, forward pass and truncated backpropagation; float32."""

    def __init__(self, v: Vocabulary, size: int, seed: int = 1, weights: list | None = None):
        import numpy as np

        self.np, self.v, self.size = np, v, size
        n, c = len(v.hashes), v.classes + SHAPES
        self.start = n + SHAPES
        if weights is None:
            rng = np.random.default_rng(seed)
            by_class = np.concatenate([np.bincount(v.class_of, v.counts + 1.0, v.classes), v.shape_totals])
            inside = np.log((v.counts + 1.0) / by_class[v.class_of])
            weights = [
                rng.normal(0, 0.1, (n + SHAPES + 1, size)), rng.normal(0, 0.2, (size, 3 * size)), rng.normal(0, 0.2, (size, 3 * size)), np.zeros(3 * size),
                np.zeros((size, c)), np.log(by_class / by_class.sum()), np.zeros((n, size)), inside,
            ]
        self.w = [np.ascontiguousarray(x, np.float32) for x in weights]

    def flat(self):
        return self.np.concatenate([x.reshape(-1) for x in self.w])

    def load(self, flat) -> None:
        at = 0
        for i, x in enumerate(self.w):
            self.w[i] = self.np.ascontiguousarray(flat[at : at + x.size].reshape(x.shape), self.np.float32)
            at += x.size

    def gates(self):
        """(3, size, size): what a state adds to the two gates, whose tanh takes half of it, and to the candidate."""
        n = self.size
        out = self.np.ascontiguousarray(self.w[2].reshape(n, 3, n).transpose(1, 0, 2))
        out[:2] *= 0.5
        return out

    def inputs_of(self, ids):
        """(3, len(ids), size): what the tokens ``ids`` (None: one of each) add to gates and candidate."""
        np, n = self.np, self.size
        emb, wx, _, b = self.w[:4]
        out = np.matmul(emb if ids is None else emb[ids], wx.reshape(n, 3, n).transpose(1, 0, 2))
        out += b.reshape(3, 1, n)
        out[:2] *= 0.5
        return out

    def states(self, ids, fresh, h, keep: bool, known=None):
        """States after each step of a window; ids and fresh are [steps, lanes], h is [lanes, size]. ``known``: gates() and inputs_of(None), if at hand."""
        np, n = self.np, self.size
        steps, width = ids.shape
        wh, table = known or (self.gates(), self.inputs_of(None) if ids.size > len(self.w[0]) else None)
        x = np.take(table, ids, axis=1) if table is not None else self.inputs_of(ids.reshape(-1)).reshape(3, steps, width, n)
        out = np.empty((steps, width, n), x.dtype)
        g, begins = np.empty((3, width, n), x.dtype), fresh.any(1).tolist()
        old = np.empty_like(x[0]) if keep else None
        before = h = h.astype(x.dtype, copy=False)
        for t in range(steps):
            if begins[t]:
                h = np.where(fresh[t][:, None], x.dtype.type(0), h)
            np.matmul(h, wh, out=g)
            zr, m = x[:2, t], x[2, t]  # gates and candidate take their inputs' place
            zr += g[:2]
            np.tanh(zr, out=zr)
            zr *= 0.5
            zr += 0.5
            if keep:
                old[t] = g[2]
            g[2] *= zr[1]
            m += g[2]
            np.tanh(m, out=m)
            now = out[t]
            np.subtract(h, m, out=now)
            now *= zr[0]
            now += m
            h = now
        if not keep:
            return out, h, None
        hp = np.concatenate([before[None], out[:-1]])
        hp[fresh] = 0
        return out, h, (hp, *x, old)

    def losses(self, s, target, grads: list | None = None):
        """Natural log-probability of each target's class and, where listed, of the token inside it; fills the gradients."""
        np = self.np
        wc, bc, wo, bo = self.w[4:]
        n = len(self.v.hashes)
        kinds = np.where(target < n, target // self.v.width, self.v.classes + target - n)
        order = np.argsort(kinds.astype(np.int16), kind="stable")  # 16 bits: sorted by digits
        kinds, inside, s = kinds[order], target[order], s[order]
        at = np.arange(len(s))
        # states lie between -1 and 1, so the weights bound the scores: inside the float's range no largest score has to be taken off
        tame = max(np.abs(wc).sum(0).max() + np.abs(bc).max(), np.abs(wo).sum(1).max() + np.abs(bo).max()) < 80

        def part(w, b, x, k, own=None):
            """Log-probability of the choices ``k``, and the gradient of their scores over the choices' weights; one row per choice, so that
            sums run along the tokens. Constants weigh the sums. ``own``: the class of each token, where ``w`` has the tokens of several."""
            y = w @ x.T
            if tame:
                won, weight = y[k, at[: len(k)]] + b[k], np.exp(b)
            else:
                y += b[:, None]
                y -= y.max(0)
                won, weight = y[k, at[: len(k)]], np.ones_like(b)
            np.exp(y, out=y)
            if own is not None:
                y *= at_class[: len(w), None] == own
            total = weight @ y
            if grads is not None:
                y *= 1 / total
                y[k, at[: len(k)]] -= 1 / weight[k]
            return won - np.log(total), y, weight[:, None]

        got, p, weight = part(wc.T, bc, s, kinds)
        if grads is not None:
            ds = p.T @ (weight * wc.T)
            grads[4] += (weight * (p @ s)).T
            grads[5] += weight[:, 0] * p.sum(1)
        cuts = np.searchsorted(kinds, np.arange(self.v.classes + 1)).tolist()
        at_class = np.arange(n) // self.v.width
        c = 0
        while c < self.v.classes:
            d = c + 1  # classes of few tokens are taken together
            while tame and d < self.v.classes and (d + 1 - c) * self.v.width * (cuts[d + 1] - cuts[c]) <= FEW:
                d += 1
            mine, first, c = slice(cuts[c], cuts[d]), c, d
            if mine.start == mine.stop:
                continue
            a, b = first * self.v.width, min(d * self.v.width, n)
            more, p, weight = part(wo[a:b], bo[a:b], s[mine], inside[mine] - a, kinds[mine] - first if d > first + 1 else None)
            got[mine] += more
            if grads is not None:
                ds[mine] += p.T @ (weight * wo[a:b])
                grads[6][a:b] += weight * (p @ s[mine])
                grads[7][a:b] += weight[:, 0] * p.sum(1)
        out = np.empty_like(got)
        out[order] = got
        if grads is None:
            return out, None
        back = np.empty_like(ds)
        back[order] = ds
        return out, back

    def back(self, ids, fresh, tape, ds, grads: list) -> None:
        """Gradients of one window; what reaches its first state is cut off."""
        np, n = self.np, self.size
        emb, wx, wh, _ = self.w[:4]
        hp, z, r, m, old = tape
        by_z, by_r, by_m = 1 - z, 1 - r, m * m
        np.subtract(1, by_m, out=by_m)
        by_m *= by_z
        by_z *= z
        by_z *= hp - m
        by_r *= r
        by_r *= old
        dm, dg = np.empty_like(z), np.empty((3, *z.shape), z.dtype)
        out_of = np.ascontiguousarray(wh.reshape(n, 3, n).transpose(1, 2, 0))
        dh, through, begins = np.zeros(z.shape[1:], z.dtype), np.empty((3, *z.shape[1:]), z.dtype), fresh.any(1).tolist()
        for t in range(len(ids) - 1, -1, -1):
            dh += ds[t]
            np.multiply(dh, by_m[t], out=dm[t])
            np.multiply(dh, by_z[t], out=dg[0, t])
            np.multiply(dm[t], by_r[t], out=dg[1, t])
            np.multiply(dm[t], r[t], out=dg[2, t])
            np.matmul(dg[:, t], out_of, out=through)
            dh *= z[t]
            dh += through[0]
            dh += through[1]
            dh += through[2]
            if begins[t]:
                dh[fresh[t]] = 0
        hp, flat = hp.reshape(-1, n), ids.reshape(-1)
        order = np.argsort(flat.astype(np.uint16 if self.start < 1 << 16 else np.int32), kind="stable")  # 16 bits: sorted by digits
        ranked = flat[order]
        heads = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        tokens = ranked[heads]
        for k, g in enumerate((dg[0], dg[1], dm)):
            some = slice(k * n, (k + 1) * n)
            grads[2][:, some] += hp.T @ dg[k].reshape(-1, n)
            by_token = np.add.reduceat(g.reshape(-1, n)[order], heads)  # a token's inputs are the same at all its places
            grads[3][some] += by_token.sum(0)
            grads[1][:, some] += emb[tokens].T @ by_token
            grads[0][tokens] += by_token @ wx[:, some].T


def lanes(sizes, width: int):
    """Documents dealt to lanes, the longest first to the emptiest lane: (lane, place of its first token) per document, lengths of lanes in falling order."""
    import heapq

    import numpy as np

    width = max(1, min(width, len(sizes)))
    heap = [(0, i) for i in range(width)]
    lane, place = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for d in np.argsort(-np.asarray(sizes), kind="stable"):
        used, i = heap[0]
        lane[d], place[d] = i, used
        heapq.heapreplace(heap, (used + int(sizes[d]), i))
    length = np.empty(width, np.int64)
    for used, i in heap:
        length[i] = used
    order = np.argsort(-length, kind="stable")
    rank = np.empty(width, np.int64)
    rank[order] = np.arange(width)
    return rank[lane], place, length[order]


def windows(tokens: list, net: Network, width: int, steps: int):
    """Windows over lanes: yields (ids, fresh, target, document, live lanes); a lane that has ended drops out at the next window, its rest is masked by document -1."""
    import numpy as np

    sizes = np.array([len(t) for t in tokens])
    lane, place, length = lanes(sizes, width)
    # the lanes one after the other in one row, from which a window is read
    begin = np.cumsum(length) - length
    first = begin[lane] + place
    order = np.argsort(first)
    flat = np.concatenate([tokens[d] for d in order.tolist()], dtype=np.int32)
    owner = np.repeat(order.astype(np.int32), sizes[order])
    head = np.zeros(len(flat), bool)
    head[first] = True
    for at in range(0, int(length[0]), steps):
        live = int((length > at).sum())
        step = np.arange(min(steps, int(length[0]) - at))[:, None]
        over = step >= length[:live] - at
        spot = begin[:live] + at + step
        spot[over] = 0
        ids, fresh, target, doc = flat[spot - 1], head[spot], flat[spot], owner[spot]
        ids[fresh] = net.start
        for m, empty in ((ids, 0), (fresh, False), (target, 0), (doc, -1)):
            m[over] = empty
        yield ids, fresh, target, doc, live


def train(net: Network, tokens: list, rate: float, width: int = 192, steps: int = 24) -> int:
    """One pass of truncated backpropagation (Adam) over documents; the number of tokens."""
    import numpy as np

    w = net.flat()
    g, m, s, step_by = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w), np.empty_like(w)
    cuts = np.cumsum([x.size for x in net.w])[:-1]
    grads = [x.reshape(y.shape) for x, y in zip(np.split(g, cuts), net.w)]
    net.w = [x.reshape(y.shape) for x, y in zip(np.split(w, cuts), net.w)]
    h, seen, step = np.zeros((width, net.size), np.float32), 0, 0
    for ids, fresh, target, doc, live in windows(tokens, net, width, steps):
        step += 1
        states, last, tape = net.states(ids, fresh, h[:live], True)
        real = np.flatnonzero(doc.reshape(-1) >= 0)
        flat = states.reshape(-1, net.size)
        _, ds = net.losses(flat[real], target.reshape(-1)[real], grads)
        full = np.zeros_like(flat)
        full[real] = ds
        net.back(ids, fresh, tape, full.reshape(states.shape), grads)
        h[:live] = last
        seen += len(real)
        for a in range(0, len(w), BLOCK):  # a block at a time stays in the processor's cache
            gb, mb, sb, by = (x[a : a + BLOCK] for x in (g, m, s, step_by))
            gb /= np.float32(max(1, len(real)))
            np.subtract(gb, mb, out=by)
            by *= np.float32(0.1)
            mb += by
            gb *= gb
            gb -= sb
            gb *= np.float32(0.01)
            sb += gb
            np.multiply(sb, np.float32(1 / (1 - 0.99**step)), out=by)
            np.sqrt(by, out=by)
            by += np.float32(1e-5)
            np.divide(mb, by, out=by)
            by *= np.float32(rate / (1 - 0.9**step))
            w[a : a + BLOCK] -= by
            gb.fill(0)
    return seen


def log_likelihoods(net: Network, tokens: list, width: int = 256, steps: int = 32):
    """Natural log-probability of all tokens of each document, up to the shares inside shape classes."""
    import numpy as np

    out = np.zeros(len(tokens))
    h, known = np.zeros((width, net.size), np.float32), (net.gates(), net.inputs_of(None))
    for ids, fresh, target, doc, live in windows(tokens, net, width, steps):
        states, last, _ = net.states(ids, fresh, h[:live], False, known)
        h[:live] = last
        doc = doc.reshape(-1)
        real = np.flatnonzero(doc >= 0)
        got, _ = net.losses(states.reshape(-1, net.size)[real], target.reshape(-1)[real])
        out += np.bincount(doc[real], got.astype(np.float64), len(tokens))
    return out


def _hashed(batches):
    """(ids, hashes, cuts, bytes of text) of about ``PART`` bytes of text at a time."""
    release()  # what earlier stages have freed
    for docs, texts in rows_of(batches, PART):
        yield docs, *shaped_hashes([t.lower() for t in texts]), sum(map(len, texts))


def _tokens(v: Vocabulary, hashes, cuts) -> list:
    """What the network reads of each document: four bytes a token."""
    every, at = v.inputs(hashes), cuts.tolist()
    return [every[a:b] for a, b in zip(at, at[1:])]


PART = 1 << 20  # bytes of text that are hashed at once
GROUP = 16 << 20  # bytes of text whose documents share lanes
COMMON = 1 << 17  # most frequent unlisted words whose counts every task holds (16 bytes each); all others are joined


def counts(docs: DataFrame) -> DataFrame:
    """(h, c): how often each token occurs in ``docs`` (doc_id, text); a written table."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        def told(parts):
            h, c = np.unique(np.concatenate(parts), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "c"])

        parts, held = [], 0
        for _, hashes, _, size in _hashed(batches):
            parts.append(hashes)
            held += size
            if held >= GROUP:
                yield told(parts)
                parts, held = [], 0
        if parts:
            yield told(parts)

    return cut_lineage(docs.mapInArrow(work, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")))


def vocabulary(table: DataFrame, listed: int, classes: int) -> Vocabulary:
    import numpy as np

    tokens, distinct = table.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    top = table.where(F.col("h") != END).orderBy(F.desc("c"), "h").limit(listed - 1).collect()
    ends = table.where(F.col("h") == END).first()
    rows = [(END, ends["c"] if ends else 0), *[(r["h"], r["c"]) for r in top]]
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    c = np.array([r[1] for r in rows], np.float64)
    rare = table.join(F.broadcast(table.sparkSession.createDataFrame([(int(x),) for x in h.view(np.int64)], "h long")), "h", "left_anti")  # ``listed`` rows
    totals = np.ones(SHAPES)
    for r in rare.groupBy(F.col("h").bitwiseAND(15).alias("shape")).agg(F.sum(F.col("c") + 1).alias("t")).collect():
        totals[r["shape"]] += r["t"]
    return Vocabulary(h, c, min(classes, len(rows)), totals, int(tokens), int(distinct))


def frequent(table: DataFrame, limit: int):
    """(h, c) of words that occur more often than all others, at most ``limit``, as pandas: words that tie at the bar stay
    out together. Only they and the distinct counts (at most the root of twice the tokens) come to the driver, whatever the partitions."""
    words = table.where(F.col("h") != END)
    sizes = words.groupBy("c").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("c", ascending=False)
    over = sizes["c"][sizes["n"].cumsum() > limit]
    return words.where(F.col("c") > (int(over.iloc[0]) if len(over) else 0)).select("h", "c").toPandas()


def fit(docs: DataFrame, v: Vocabulary, size: int = 24, rates: tuple[float, ...] = (0.02, 0.012, 0.008, 0.004)) -> list:
    """Weights after one round per learning rate; each document of ``docs`` is trained on once."""
    import numpy as np

    net = Network(v, size)
    for i, rate in enumerate(rates):
        now = net.flat()

        def work(batches, now=now, rate=rate):
            import pyarrow as pa

            total, sums, tokens, held = 0, None, [], 0

            def learn():
                mine = Network(v, size)
                mine.load(now if sums is None else sums / total)
                n = train(mine, tokens, rate)
                part = mine.flat().astype(np.float64) * n
                return total + n, part if sums is None else sums + part

            for _, hashes, cuts, some in _hashed(batches):
                tokens += _tokens(v, hashes, cuts)
                held += some
                if held >= GROUP:
                    total, sums = learn()
                    tokens, held = [], 0
            if tokens:
                total, sums = learn()
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums), pa.array(np.full(len(sums), total))], ["i", "x", "n"])

        share = docs.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(21)), F.lit(len(rates))) == i)
        mean = share.mapInArrow(work, "i long, x double, n long").groupBy("i").agg((F.sum("x") / F.sum("n")).alias("x")).toPandas()  # one row per weight
        if len(mean):
            flat = np.empty(len(now), np.float32)
            flat[mean["i"].to_numpy()] = mean["x"].to_numpy()
            if np.isfinite(flat).all():
                net.load(flat)
    return net.w


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", listed: int = 2048, classes: int = 32, size: int = 24) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per document."""
    import numpy as np

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    learn = docs.where(training_rows())
    table = counts(learn)
    v = vocabulary(table, listed, classes)
    weights = fit(learn, v, size)
    log_totals = np.log10(v.shape_totals)
    log_counts = np.log10(v.counts + 1)
    known_listed = v.counts > 0
    n_listed = len(v.hashes)
    often = frequent(table, COMMON)
    common, common_log = often["h"].to_numpy(np.int64).view(np.uint64), np.log10(often["c"].to_numpy(np.float64) + 1)

    def by_document(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        net, lookup = Network(v, size, weights=weights), Places(common)
        serial = TaskContext.get().partitionId() << 33
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.int32()]

        def rows(n, **known):
            return pa.RecordBatch.from_arrays([pa.array(known[c]).cast(t) if c in known else pa.nulls(n, t) for c, t in zip(NAMES, kinds)], NAMES)

        def documents():
            """Rows of the documents whose ``tokens`` wait, ``waits`` has what is known of them but the network's score."""
            ids, *others = zip(*waits)
            ids, (sizes, known, base, rest) = pa.concat_arrays(ids), map(np.concatenate, others)
            got = log_likelihoods(net, tokens) / math.log(10) - rest
            return rows(len(ids), row=serial - len(ids) + np.arange(len(ids)), doc_id=ids, n_tokens=sizes, n_listed=known, listed_base=base, listed_score=got)

        tokens, waits, held = [], [], 0
        for ids, hashes, cuts, some in _hashed(batches):
            mine, sizes, n = _tokens(v, hashes, cuts), np.diff(cuts), len(ids)
            flat, doc = np.concatenate(mine), np.repeat(np.arange(n), sizes)
            is_listed = flat < n_listed
            lf, ld = flat[is_listed], doc[is_listed]
            base, known = np.bincount(ld, log_counts[lf], n), np.bincount(ld, known_listed[lf], n)
            # words of the part that are not listed: the common ones are looked up, the rare ones sent as (document, hash, times)
            f, h, d = flat[~is_listed], hashes[~is_listed], doc[~is_listed]
            rest = np.bincount(d, log_totals[f - n_listed], n)
            at = lookup.find(h)
            found = at >= 0
            looked_up = np.bincount(d[found], common_log[at[found]], n)
            base += looked_up
            rest -= looked_up  # a word's share of its class, as the join adds it for the rare ones
            known += np.bincount(d[found], minlength=n)
            h, d = h[~found].view(np.int64), d[~found]
            order = np.lexsort((h, d))
            h, d = h[order], d[order]
            head = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])) if len(h) else np.zeros(0, np.int64)
            times = np.diff(np.append(head, len(h)))
            for a in range(0, len(head), 200_000):
                spot = head[a : a + 200_000]
                yield rows(len(spot), row=serial + d[spot], h=h[spot], times=times[a : a + 200_000])
            waits.append((pa.array(ids, pa.int64()), sizes, known.astype(np.int64), base, rest))
            tokens += mine
            serial += n
            held += some
            if held >= GROUP:
                yield documents()
                tokens, waits, held = [], [], 0
        if tokens:
            yield documents()

    both = docs.mapInArrow(by_document, "row long, doc_id long, n_tokens long, n_listed long, listed_base double, listed_score double, h long, times int")
    both = cut_lineage(both)  # documents and their rare words from one pass over the texts
    heads = both.where("h is null").select("row", "doc_id", "n_tokens", "n_listed", "listed_base", "listed_score")
    rare = both.where("h is not null").select("row", "h", "times").join(table, "h", "left")
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1)).alias("rare_log"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    rare_log = F.coalesce("rare_log", F.lit(0.0))
    return heads.join(rare, "row", "left").select(
        "doc_id", (~training_rows()).alias("held_out"), "n_tokens", (F.col("n_listed") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("listed_base") + rare_log - F.col("n_tokens") * math.log10(v.tokens + v.distinct + 1)).alias("base_score"), (F.col("listed_score") + rare_log).alias("score"),
    )


NAMES = ["row", "doc_id", "n_tokens", "n_listed", "listed_base", "listed_score", "h", "times"]
