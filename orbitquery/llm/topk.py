"""Exact top-k by inner product, with multi-resolution segment statistics.

A vector is cut into segments; with m and d a segment's mean and deviation and s
its length, the sum of s * (m*m' + d*d') over segments is never below the inner
product of two vectors (so, with their norms, never above what their distance
allows).  Coarse segments rule out most pairs, finer ones more, and the exact
integer product is computed for what survives.  Queries go round in waves of
bounded size; every candidate partition is scanned where it lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, in_slices

SCALE = 1024.0
#: Bytes of query vectors that are broadcast at once.
WAVE_BYTES = 8 << 20
#: Segment lengths, coarse to fine.
LENGTHS = (16, 4)
#: Share of pairs left at which multiplying whole tiles is cheaper than single pairs.
DENSE = 0.02


def quantised(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) with v the 64-bit integers floor(1024 * x), little-endian; unusable vectors and null ids are left out."""

    def run(batches):
        for batch in batches:
            keys, column = batch.column(0), batch.column(1)
            ids, out = [], []
            for row, x in zip(keys.to_pylist(), column, strict=True):
                if row is None or not x.is_valid or x.values.null_count:
                    continue
                value = x.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if len(value) and np.isfinite(value).all():
                    ids.append(row)
                    out.append(np.floor(SCALE * value).astype("<i8").tobytes())
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.binary())], ["vec_id", "v"])

    chosen = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, "vec_id long, v binary")


def statistics(x: np.ndarray, length: int) -> np.ndarray:
    """Features whose products bound inner products: sqrt(s) times mean and deviation of each segment."""
    parts = np.array_split(x, max(1, x.shape[1] // length), axis=1)
    root = np.sqrt([p.shape[1] for p in parts])
    mean = np.stack([p.mean(axis=1) for p in parts], axis=1)
    deviation = np.stack([p.std(axis=1) for p in parts], axis=1)
    return np.concatenate([mean * root, deviation * root], axis=1)


class Best:
    """The k best so far of each query of one dimension."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.k = ids, k
        self.exact, self.real = vectors, vectors.astype(np.float64)
        self.levels = [statistics(self.real, s) for s in LENGTHS]
        self.largest = np.abs(self.real).max(initial=0.0)
        self.scores = [np.zeros(0, dtype=np.int64)] * len(ids)
        self.found = [np.zeros(0, dtype=np.int64)] * len(ids)
        self.floor = np.full(len(ids), -np.inf)

    def see(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        real = vectors.astype(np.float64)
        levels = [statistics(real, s) for s in LENGTHS]
        bound = max(1.0, self.largest * np.abs(real).max(initial=0.0) * vectors.shape[1])
        slack = 1e-9 * bound + 1e-6
        for at in range(0, len(self.ids), 256):
            rows = np.arange(at, min(at + 256, len(self.ids)))
            columns = np.arange(len(ids))
            alive = None
            for mine, theirs in zip(self.levels, levels, strict=True):
                reach = mine[rows] @ theirs[columns].T >= self.floor[rows][:, None] - slack
                alive = reach if alive is None else alive & reach
                some_rows, some_columns = alive.any(axis=1), alive.any(axis=0)
                rows, columns, alive = rows[some_rows], columns[some_columns], alive[some_rows][:, some_columns]
                if not len(rows):
                    break
            if len(rows):
                self._exact(rows, columns, alive, ids, vectors, real, bound)

    def _exact(self, rows, columns, alive, ids, vectors, real, bound) -> None:
        if bound < 2.0**52 and alive.mean() > DENSE:
            score = (self.real[rows] @ real[columns].T).astype(np.int64)
            for r, line, use in zip(rows.tolist(), score, alive, strict=True):
                use = np.flatnonzero(use & (line >= self.floor[r]))
                self._take(r, line[use], ids[columns[use]])
            return
        for r, use in zip(rows.tolist(), alive, strict=True):
            those = columns[use]
            line = vectors[those] @ self.exact[r]
            good = np.flatnonzero(line >= self.floor[r])
            self._take(r, line[good], ids[those[good]])

    def _take(self, row: int, score: np.ndarray, ids: np.ndarray) -> None:
        other = ids != self.ids[row]
        if not other.any():
            return
        score, ids = np.concatenate([self.scores[row], score[other]]), np.concatenate([self.found[row], ids[other]])
        order = np.lexsort((ids, -score))[: self.k]
        self.scores[row], self.found[row] = score[order], ids[order]
        if len(order) == self.k:
            self.floor[row] = self.scores[row][-1]


def _unpack(raw: list[bytes]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Positions and vectors by dimension."""
    by: dict[int, list[int]] = {}
    for k, v in enumerate(raw):
        by.setdefault(len(v) // 8, []).append(k)
    return {d: (np.array(ks), np.frombuffer(b"".join(raw[k] for k in ks), dtype="<i8").reshape(-1, d)) for d, ks in by.items()}


def exact_top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of each query, ties to the smaller vec_id.

    Both tables are (vec_id, v) of quantised().  A query's own rows (its vec_id) are no
    candidates; a query id that repeats is asked once, candidate rows that repeat all
    count.  Only vectors of the same dimension meet.  Queries go round in waves of
    `wave_bytes`, each one scan of the candidates where they lie.  Empty tables give no rows.
    """
    asked = Table(queries.groupBy("vec_id").agg(F.min("v").alias("v")), "asked").df
    size = asked.agg(F.sum(F.octet_length("v")).alias("n")).first()["n"] or 0
    waves = max(1, -(-size // wave_bytes))
    found = None
    for wave in range(waves):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == wave).collect()
        if not rows and found is not None:
            continue
        shared = vectors.sparkSession.sparkContext.broadcast(([r["vec_id"] for r in rows], [bytes(r["v"]) for r in rows]))
        part = vectors.mapInArrow(_scan(shared, k), "query_id long, vec_id long, score long")
        if waves > 1:  # answered and written before the next one is read: one wave is all that is ever held
            part = Table(part, "wave").df
            shared.destroy()
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _scan(shared, k: int):
    def run(batches):
        names, raw = shared.value
        names = np.array(names, dtype=np.int64)
        best = {d: Best(names[at], v, k) for d, (at, v) in _unpack(raw).items()}
        for batch in batches:
            for few in in_slices(batch, 2048):
                ids = few.column(0).to_numpy()
                for d, (at, v) in _unpack(few.column(1).to_pylist()).items():
                    if d in best:
                        best[d].see(ids[at], v)
        for b in best.values():
            n = [len(x) for x in b.scores]
            if sum(n):
                arrays = [np.repeat(b.ids, n), np.concatenate(b.found), np.concatenate(b.scores)]
                table = pa.table([pa.array(x, pa.int64()) for x in arrays], names=["query_id", "vec_id", "score"])
                yield from table.to_batches(max_chunksize=10_000)

    return run


ORACLE_SQL = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM e AS q JOIN e AS c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
