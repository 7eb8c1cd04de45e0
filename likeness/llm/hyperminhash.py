"""Near-duplicate groups by HyperMinHash sketches, confirmed on full shingle sets.

A document's set holds its distinct runs of five words (A-Z in lower case), as 64-bit hashes. A
register keeps, of the smallest hash in a bucket, the number of leading zeros and ten bits after
the first one: 16 bits instead of 64. Every bucket has its own permutation of all shingles, so
short texts leave none empty. Bands of registers find candidates; the share of equal registers,
corrected for registers that agree by chance, must come near the bar; then the full sets decide.

Equal sets first become one node (known by the first of their rows, so rows that repeat a doc_id
with other texts are nodes of their own), and copies never pair up. A node is first compared with
the most central node of its band buckets, the one that shares buckets with the most others: in a group
of near copies that is the least changed one, to which all link that are near to the group's middle. Later
rounds look only at buckets whose nodes are still in several components. While that joins at least
one in twenty of them, each node outside its buckets' largest components meets two members of those,
others in each round, so a group of near copies costs a few comparisons per member. What then remains is
joined exactly by its rarest shingles: of two sets at the bar, each with its shingles in order of their number
among the open sets, the first quarter of one and of the other have a shingle in common. Sets that share a
template but not enough of it mostly differ in just those. Where they do not, parities of the shingles in 512
classes, which differ at most as often as the sets do, tell such pairs apart before anything of them is sent.

A text with one to four words is one shingle. Null texts, texts without words and rows without a
doc_id are linked with nothing and stay. A component is named after its smallest doc_id, also where
rows of several texts have that id. Two texts at the bar share no band with probability
(1 - 0.75**6)**56 < 2e-5; texts more alike, less.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import _mix, id_and_text, id_text_part, release, rows_of, with_part, word_hashes
from .components import components

WORDS_PER_SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 56, 6
MANTISSA = 10
MASK = (1 << 64) - 1


def _constants(n: int, seed: int):
    """Fixed pseudo-random odd 64-bit numbers (splitmix64 of a counter)."""
    import numpy as np

    out = []
    for i in range(1, n + 1):
        z = (seed + i * 0x9E3779B97F4A7C15) & MASK
        z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ z >> 27) * 0x94D049BB133111EB) & MASK
        out.append((z ^ z >> 31) | 1)
    return np.array(out, np.uint64)


def shingles(h, size: int = WORDS_PER_SHINGLE):
    """Sorted distinct 64-bit hashes of the runs of ``size`` words with the hashes ``h``; of all words where there are fewer."""
    import numpy as np

    if not len(h):
        return np.zeros(0, np.uint64)
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def registers(hashed, multipliers, offsets):
    """Leading zeros and mantissa of the smallest permuted hash per bucket, as unsigned 16-bit."""
    import numpy as np

    low = np.full(len(multipliers), np.uint64(MASK))
    for i in range(0, len(hashed), 512):
        np.minimum(low, (hashed[i : i + 512, None] * multipliers + offsets).min(0), out=low)
    part, exponent = np.frexp(low.astype(np.float64))
    zeros = np.clip(64 - exponent, 0, 63).astype(np.uint16)
    return zeros << np.uint16(MANTISSA) | ((part * 2 - 1) * (1 << MANTISSA)).astype(np.uint16)


def estimate(a, b, n_a: int, n_b: int) -> float:
    """Jaccard similarity from two sketches, less the share of registers that agree by chance."""
    import math

    same = float((a == b).mean())
    chance = (0.5 / math.log(2)) * 2.0**-MANTISSA * n_a * n_b / (n_a + n_b) ** 2
    return (same - chance) / (1 - chance)


def _digest(hashed) -> bytes:
    """What equal sets have in common."""
    import hashlib

    return hashlib.blake2b(hashed.tobytes(), digest_size=16).digest()


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, part, n_shingles, digest of the set (null if empty), sketch: one row per row of (doc_id, text, part)."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        release()
        mult, plus = _constants(BANDS * ROWS, 1), _constants(BANDS * ROWS, 2)
        for docs, texts, parts in rows_of(batches, more=("part",)):
            out = []
            for doc, h, part in zip(docs, word_hashes([t.lower() for t in texts]), parts):
                s = shingles(h)
                if len(s) and doc is not None:
                    out.append((doc, part, len(s), _digest(s), registers(s, mult, plus).astype("<u2").tobytes()))
                else:
                    out.append((doc, part, len(s), None, None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary()))], ["doc_id", "part", "n_shingles", "digest", "sketch"])

    return docs.mapInArrow(work, "doc_id long, part string, n_shingles long, digest binary, sketch binary")


def _bands(nodes: DataFrame) -> DataFrame:
    """(key, node): one row per band."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        mult, salt = _constants(ROWS, 3), _constants(BANDS, 4)
        for batch in batches:
            r = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), "<u2").reshape(-1, BANDS, ROWS).astype(np.uint64)
            keys = _mix((_mix(r + np.uint64(1)) * mult).sum(2) + salt)
            node = np.repeat(batch.column("node").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(node)], ["key", "node"])

    return nodes.select("node", "sketch").mapInArrow(work, "key long, node long")


def _close(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimated similarity is at most five standard errors below the bar."""
    s = nodes.select("node", "n_shingles", "sketch")
    joined = pairs.join(s.toDF("a", "n_a", "sketch_a"), "a").join(s.toDF("b", "n_b", "sketch_b"), "b")

    def work(batches):
        import numpy as np

        bar = PERCENT / 100
        slack = 5 * (bar * (1 - bar) / (BANDS * ROWS)) ** 0.5
        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("sketch_a", "sketch_b", "n_a", "n_b")]
            ok = [estimate(np.frombuffer(x, "<u2"), np.frombuffer(y, "<u2"), m, n) >= bar - slack for x, y, m, n in zip(*cols)]
            yield batch.filter(ok).select(["a", "b"])

    return joined.where(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)").mapInArrow(work, "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes): the full sets of ``nodes`` (node, doc_id of one of its rows, digest), read from the texts again."""

    def work(batches):
        import pyarrow as pa

        release()
        for _, texts in rows_of(batches):
            found = [shingles(h) for h in word_hashes([t.lower() for t in texts])]
            yield pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in found], pa.binary()), pa.array([s.tobytes() for s in found], pa.binary())], ["digest", "hashes"])

    near = docs.select("doc_id", "text").join(nodes.select("doc_id").distinct(), "doc_id", "left_semi").mapInArrow(work, "digest binary, hashes binary")
    # rows that repeat a doc_id may differ: the digest tells the one that is meant
    return near.join(nodes.select("digest", "node"), "digest").groupBy("node").agg(F.first("hashes").alias("hashes"))


def _confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the bar."""
    joined = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")

    def work(batches):
        import numpy as np

        for batch in batches:
            ok = []
            for x, y in zip(batch.column("set_a"), batch.column("set_b")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(p) + len(q) - both))
            yield batch.filter(ok).select(["a", "b"])

    return joined.mapInArrow(work, "a long, b long")


def _two_each(inside: DataFrame, outside: DataFrame, turn: int) -> DataFrame:
    """For every node outside its buckets' largest components two members of those, others in every turn."""
    by = lambda c: F.xxhash64(c, F.lit(turn))
    hubs = inside.groupBy("key").agg(F.min_by("node", by("node")).alias("hub"))
    picked = outside.join(hubs, "key").groupBy("node").agg(F.min_by("hub", by("hub")).alias("x"), F.max_by("hub", by("hub")).alias("y"))
    pairs = picked.select("node", F.explode(F.array("x", "y")).alias("hub"))
    return pairs.select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))


def _with_central(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of every node of ``rows`` (key, node, n nodes of the bucket) and the most central other node of its buckets."""
    weights = rows.groupBy("node").agg(F.sum("n").alias("weight"))
    hubs = rows.join(weights, "node").groupBy("key").agg(F.max(F.struct("weight", (-F.col("node")).alias("back"))).alias("top"))
    best = rows.join(hubs, "key").where(F.col("node") != -F.col("top.back")).groupBy("node").agg(F.max("top").alias("top"))
    hub = -F.col("top.back")
    return best.select(F.least("node", hub).alias("a"), F.greatest("node", hub).alias("b")).distinct()


PARITIES = 8  # longs


def _parities(sets: DataFrame) -> DataFrame:
    """(node, p0, p1, ...): whether the number of a set's shingles in each of 512 classes is odd; two sets differ in at least as many shingles as bits."""
    names = ["node", *[f"p{i}" for i in range(PARITIES)]]

    def work(batches):
        import numpy as np
        import pyarrow as pa

        bits = PARITIES * 64
        for batch in batches:
            odd = np.zeros((batch.num_rows, bits), np.uint8)
            for i, raw in enumerate(batch.column("hashes")):
                odd[i] = np.bincount((np.frombuffer(raw.as_buffer(), np.uint64) % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
            words = np.packbits(odd, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), *[pa.array(words[:, i]) for i in range(PARITIES)]], names)

    return sets.select("node", "hashes").mapInArrow(work, ", ".join(f"{c} long" for c in names))


def _by_rare_shingles(live: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of open nodes in different components that may reach the bar: their sets have a shingle in common among each one's rarest quarter.

    With s shingles in a fixed order, two sets at the bar share one of the first s - ceil(0.75 s) + 1 of either.
    Shingles that one open set has are counted but never sent; sizes and places bound what can still be shared,
    parities in how many shingles the sets differ.
    """
    open_sets = sets.join(live.select("node", "component").distinct(), "node")

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for i, raw in enumerate(batch.column("hashes")):
                h = np.frombuffer(raw.as_buffer(), np.int64)
                same = lambda c, i=i, n=len(h): pa.array(np.full(n, batch.column(c)[i].as_py(), np.int64))  # noqa: B023,E731
                yield pa.RecordBatch.from_arrays([pa.array(h), same("node"), same("component"), pa.array(np.full(len(h), len(h), np.int64))], ["h", "node", "component", "size"])

    tokens = cut_lineage(open_sets.mapInArrow(work, "h long, node long, component long, size long"))
    often = tokens.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = tokens.join(often, "h").groupBy("node", "component", "size").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("t"))
    alone = F.col("size") - F.size("t")
    first = F.col("size") - F.ceil(F.col("size") * PERCENT / 100) + 1  # length of the prefix
    heads = shared.withColumn("alone", alone).select("node", "component", "size", "alone", F.posexplode(F.slice("t", 1, F.greatest(first - alone, F.lit(0)).cast("int"))).alias("i", "x"))
    heads = heads.select(F.col("x.h").alias("h"), "node", "component", "size", (F.col("size") - F.col("alone") - F.col("i")).alias("rest"))
    heads = cut_lineage(heads.join(_parities(open_sets), "node"))
    marks = [f"p{i}" for i in range(PARITIES)]
    a, b = (heads.select("h", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "component", "size", "rest", *marks)]) for x in "ab")
    small, large = F.least("size_a", "size_b"), F.greatest("size_a", "size_b")
    both = a.join(b, "h").where("node_a < node_b and component_a <> component_b").where(100 * small >= PERCENT * large)
    both = both.where((100 + PERCENT) * F.least("rest_a", "rest_b") >= PERCENT * (F.col("size_a") + F.col("size_b")))
    apart = reduce(add, [F.bit_count(F.col(f"{p}_a").bitwiseXOR(F.col(f"{p}_b"))) for p in marks])
    both = both.where((100 + PERCENT) * apart <= (100 - PERCENT) * (F.col("size_a") + F.col("size_b")))
    return both.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest linked doc_id, itself included), kept; one row per document."""
    return _groups(id_and_text(df, id_col, text_col).withColumn("part", F.lit(""))).drop("part")


def _groups(docs: DataFrame) -> DataFrame:
    """As ``groups`` for rows of (doc_id, text, part), with part."""
    every = cut_lineage(sketches(docs).withColumn("row", F.monotonically_increasing_id()))
    reps = cut_lineage(every.where("digest is not null").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id")))
    nodes = cut_lineage(every.select("row", "n_shingles", "sketch").join(reps.select(F.col("node").alias("row")), "row").withColumnRenamed("row", "node"))
    rows = cut_lineage(_bands(nodes))
    crowds = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = cut_lineage(rows.join(crowds, "key"))  # buckets of two and more
    sets = cut_lineage(_sets(docs, reps.join(rows.select("node").distinct(), "node")))
    tested = cut_lineage(_with_central(rows))
    links = cut_lineage(_confirm(_close(tested, nodes), sets))
    labels = cut_lineage(nodes.select("node", F.col("node").alias("component")))
    open_before, turn = None, 0
    while True:
        labels, turn = _merged(labels, links), turn + 1
        live = rows.select("key", "node").join(labels, "node")
        sizes = live.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
        live = cut_lineage(live.join(largest.select("key", "main"), "key"))
        small = live.where("component <> main")
        open_nodes = small.select("node").distinct().count()
        if not open_nodes:
            break
        last = open_before is not None and open_nodes > 0.95 * open_before
        open_before = open_nodes
        fresh = _by_rare_shingles(live, sets) if last else _two_each(live.where("component = main"), small, turn)
        fresh = cut_lineage(fresh.distinct().join(tested, ["a", "b"], "left_anti"))
        links = cut_lineage(_confirm(_close(fresh, nodes), sets))
        if last:  # every pair at the bar has been looked at
            labels = _merged(labels, links)
            break
        tested = tested.unionByName(fresh)
    placed = reps.join(labels, "node")
    least = placed.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    found = placed.join(least, "component").select("digest", "component_id")
    out = every.select("doc_id", "part", "n_shingles", "digest").join(found, "digest", "left")  # a hot digest is split by the adaptive skew join
    out = out.select("doc_id", "part", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels after joining the components that the links connect."""
    here = labels.select(F.col("node").alias("a"), F.col("component").alias("x"))
    there = labels.select(F.col("node").alias("b"), F.col("component").alias("y"))
    edges = cut_lineage(links.join(here, "a").join(there, "b").where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not edges.limit(1).count():
        return labels
    joined = components(edges).select(F.col("node").alias("component"), F.col("component").alias("to"))
    return cut_lineage(labels.join(joined, "component", "left").select("node", F.coalesce("to", "component").alias("component")))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that stay: one document of each group, with all columns; rows that repeat a doc_id are judged by their own texts."""
    marked = with_part(df, id_col, text_col)
    kept = _groups(id_text_part(marked, id_col, text_col)).where("kept and doc_id is not null").select(F.col("doc_id").alias("_kept_id"), F.col("part").alias("_kept_part")).distinct()
    same = (F.col(id_col).cast("long") == F.col("_kept_id")) & (F.col("_part") == F.col("_kept_part"))
    return marked.join(kept, same, "left_semi").unionByName(marked.where(F.col(id_col).isNull())).drop("_part")
