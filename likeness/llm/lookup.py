"""Centroid clustering of integer vectors through scalar lookup tables.

A component x becomes floor(256 * x). A written table holds blocks of vectors as codes: per
dimension the integers that occur in the block, in order, and for every vector the place of its
integer among them. A round tabulates, for each dimension, occurring integer and centroid, the
squared difference; a vector's distances are the rows that its codes gather from these tables,
added up. Sums and counts per centroid leave a task as one row per centroid, and the driver sees
one row per (centroid, dimension), whatever the number of vectors. All arithmetic is exact.

Left out: vectors that are null, of another length, or that hold a null, a value that is not finite
or one beyond 2**18 (whose squared distances a long could not hold). Rows that repeat a vec_id are
vectors of their own; a null vec_id hashes last. Fewer vectors than centroids give as many
centroids as there are vectors; equal distances go to the smaller number. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage

SIZE, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, 2
LARGEST = float(1 << 18)
BLOCK = 4096  # vectors whose codes stand together: bounds the integers per dimension, and so a table


def integer_vectors(df: DataFrame, size: int = SIZE, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v (array of long): the vectors that are kept."""
    x = F.col(vector_col)
    fine = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    rows = df.where(x.isNotNull() & (F.size(x) == size) & fine)
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")).alias("v"))


def first_key(seed: int = SEED) -> Column:
    """What the first centroids are ordered by."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)


@dataclass
class Block:
    """Codes of some vectors: ``values[offsets[d] : offsets[d + 1]]`` are the integers of dimension d, ``codes[d]`` the vectors' places among them."""

    values: object
    offsets: object
    codes: object

    @classmethod
    def of(cls, matrix) -> Block:
        import numpy as np

        values, offsets = [], [0]
        codes = np.empty(matrix.shape[::-1], np.uint16)
        for d in range(matrix.shape[1]):
            found, codes[d] = np.unique(matrix[:, d], return_inverse=True)
            values.append(found)
            offsets.append(offsets[-1] + len(found))
        return cls(np.concatenate(values), np.array(offsets), codes)

    def tables(self, centroids):
        """Squared difference per (occurring integer, centroid), the dimensions one after the other; 32 bits where every sum fits."""
        import numpy as np

        dimension = np.repeat(np.arange(len(self.codes)), np.diff(self.offsets))
        apart = self.values[:, None] - centroids.T[dimension]
        apart *= apart
        most = sum(int(apart[a:b].max()) for a, b in zip(self.offsets, self.offsets[1:]))
        return apart.astype(np.int32) if most < 1 << 31 else apart

    def nearest(self, centroids, at_once: int = 1024):
        """(number of the nearest centroid, squared distance) per vector; ties go to the smaller number."""
        import numpy as np

        table, n = self.tables(centroids), self.codes.shape[1]
        where, far = np.empty(n, np.int64), np.empty(n, np.int64)
        for a in range(0, n, at_once):
            codes = self.codes[:, a : a + at_once]
            total = np.zeros((codes.shape[1], len(centroids)), table.dtype)
            part = np.empty_like(total)
            for d, begin in enumerate(self.offsets[:-1]):
                np.take(table[begin:], codes[d], axis=0, out=part, mode="clip")
                total += part
            best = total.argmin(1)
            where[a : a + at_once], far[a : a + at_once] = best, total[np.arange(len(best)), best]
        return where, far

    def sums(self, where, centroids: int):
        """(count, componentwise sum) of the vectors of each centroid."""
        import numpy as np

        count = np.bincount(where, minlength=centroids)
        total = np.empty((centroids, len(self.codes)), np.int64)
        for d, (a, b) in enumerate(zip(self.offsets, self.offsets[1:])):
            # how often each (centroid, integer) occurs, times the integer
            often = np.bincount(where * (b - a) + self.codes[d], minlength=centroids * (b - a)).reshape(centroids, b - a)
            total[:, d] = often @ self.values[a:b]
        return count, total


def _blocks(batches, size: int, rows: int = BLOCK):
    """Rows of the written table: ids and codes of at most ``rows`` vectors each."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        matrix = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
        for a in range(0, len(matrix), rows):
            b = Block.of(matrix[a : a + rows])
            columns = [batch.column("vec_id").slice(a, rows).to_pylist(), b.values.tolist(), b.offsets.tolist(), b.codes.tobytes()]
            kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], ["ids", "vals", "offsets", "codes"])


def _read(batches):
    """(ids, block) of each row of the written table."""
    import numpy as np

    for batch in batches:
        for i in range(batch.num_rows):
            offsets = batch.column("offsets")[i].values.to_numpy()
            codes = np.frombuffer(batch.column("codes")[i].as_buffer(), np.uint16).reshape(len(offsets) - 1, -1)
            yield batch.column("ids")[i].values, Block(batch.column("vals")[i].values.to_numpy(), offsets, codes)


def _one_round(blocks: DataFrame, centroids):
    """Centroids after one assignment and update."""
    import numpy as np

    def work(batches):
        import pyarrow as pa

        count, total = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for _, block in _read(batches):
            n, s = block.sums(block.nearest(centroids)[0], len(centroids))
            count, total = count + n, total + s
        live = np.flatnonzero(count)
        if len(live):
            columns = [pa.array(live, pa.int32()), pa.array(count[live]), pa.array(list(total[live]), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["c", "n", "s"])

    parts = blocks.mapInArrow(work, "c int, n long, s array<long>")
    sums = parts.select("c", "n", F.posexplode("s").alias("d", "x")).groupBy("c", "d").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = centroids.copy()
    for r in sums.collect():  # one row per centroid and dimension
        out[r["c"], r["d"]] = r["x"] // r["n"]
    return out


def cluster(
    df: DataFrame, size: int = SIZE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid (array of long): one row per kept vector."""
    import numpy as np

    vectors = integer_vectors(df, size, id_col, vector_col)
    blocks = cut_lineage(vectors.mapInArrow(lambda batches: _blocks(batches, size, block), "ids array<long>, vals array<long>, offsets array<long>, codes binary"))
    first = vectors.orderBy(first_key(seed).asc_nulls_last(), "v").limit(centroids).collect()  # ``centroids`` rows
    now = np.array([r["v"] for r in first], np.int64).reshape(-1, size)
    if len(now):
        for _ in range(rounds):
            now = _one_round(blocks, now)

    def assign(batches):
        import pyarrow as pa

        for ids, b in _read(batches):
            where, far = b.nearest(now)
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(where.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    placed = cut_lineage(blocks.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    each = {r["cluster"]: r["d"] for r in placed.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}  # one row per centroid
    facts = [(c, d, hashlib.sha256(",".join(map(str, now[c].tolist())).encode()).hexdigest(), now[c].tolist()) for c, d in sorted(each.items())]
    known = df.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, centroid_sha256 string, centroid array<long>")
    out = placed.join(F.broadcast(known), "cluster")  # at most ``centroids`` rows
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", F.lit(sum(each.values())).cast("long").alias("inertia"), "centroid_sha256", "centroid")


def oracle(size: int = SIZE, centroids: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same rows in DuckDB SQL: all distances of every round by inner products of whole numbers."""
    far = "list_inner_product(v, v) - 2 * list_inner_product(v, u) + list_inner_product(u, u)"
    parts = [
        f"""k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v, row_number() OVER () AS r FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS u FROM (SELECT v, sha256('{seed}:' || vec_id) AS h FROM k) ORDER BY h, v LIMIT {centroids})""",
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': {far}, 'c': c}}) AS b FROM k, c{i} GROUP BY r)")
        if i < rounds:
            parts.append(
                f"""m{i} AS MATERIALIZED (SELECT c, list(x ORDER BY i) AS u FROM (SELECT c, i, floor(sum(x) / count(*)) AS x FROM (SELECT b.c AS c, unnest(v) AS x, unnest(range({size})) AS i FROM a{i}) GROUP BY c, i) GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(m{i}.u, c{i}.u) AS u FROM c{i} LEFT JOIN m{i} ON c{i}.c = m{i}.c)"""
            )
    return f"""WITH {', '.join(parts)}
SELECT vec_id, CAST(b.c AS INT) AS cluster, CAST(b.d AS BIGINT) AS distance, CAST(sum(b.d) OVER (PARTITION BY b.c) AS BIGINT) AS cluster_inertia, CAST(sum(b.d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(list_transform(u, lambda x: CAST(x AS BIGINT)), ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON b.c = c"""
