"""Connected components of a link table, without ever gathering links on one machine."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, lean


#: Rows of contracted links that one task may join up: some tens of MB.
ALONE = 500_000


class Forest:
    """Union-find over whatever integers it meets; the smaller root stays."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up, top = self.up, x
        while (y := up.get(top, top)) != top:
            top = y
        while x != top:
            up[x], x = top, up.get(x, x)
        return top

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(left: np.ndarray, right: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Positions of links that connect all that the given links connect: lightest first, one less than nodes at most."""
    if not len(left):
        return np.zeros(0, dtype=np.int64)
    order = np.lexsort((right, left, weight if weight is not None else np.zeros(len(left))))
    forest = Forest()
    join = forest.join
    return np.array([k for k, a, b in zip(order.tolist(), left[order].tolist(), right[order].tolist(), strict=True) if join(a, b)], dtype=np.int64)


def _contract(batches):
    """Links of a partition as stars around its local roots: fewer rows, the same connections."""
    forest, seen = Forest(), 0
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
        if len(forest.up) > 1_000_000:
            yield from _stars(forest)
            forest = Forest()
    yield from _stars(forest)


def _stars(forest: Forest):
    nodes = [x for x in forest.up if forest.up[x] != x]
    if nodes:
        table = pa.table({"node": pa.array(nodes, pa.int64()), "root": pa.array([forest.find(x) for x in nodes], pa.int64())})
        yield from table.to_batches(max_chunksize=10_000)


def _mark(df: DataFrame) -> tuple:
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(links: DataFrame, alone: int = ALONE) -> DataFrame:
    """(node, root) for every node with a link, root the smallest node of its component; roots themselves are left out.

    links: two bigint columns.  Partitions are contracted first.  Up to `alone` rows that
    are left, which fit a task whatever the input, are joined up by one more such step.
    More of them alternate large-star and small-star steps; each takes a minimum per node
    (combined before the shuffle) and joins it back from a written table, so that adaptive
    execution can split a node with very many links.  Rounds grow with the logarithm of
    the longest chain.
    """
    a, b = links.columns
    # Written before they are contracted: two Python steps in one stage would hold two workers for each task.
    given = Table(links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("node"), F.least(a, b).alias("root")), "given")
    now = Table(given.df.mapInArrow(lean(_contract), "node long, root long"), "links")
    given.drop()
    mark = _mark(now.df)
    if mark[0] <= alone:
        done = Table(now.df.coalesce(1).mapInArrow(lean(_contract), "node long, root long"), "roots")
        now.drop()
        return done.df
    while True:
        after = _small_star(_large_star(now))
        new = _mark(after.df)
        now.drop()
        now = after
        if new == mark:
            return now.df
        mark = new


def _large_star(now: Table) -> Table:
    both = now.df.unionByName(now.df.select(F.col("root").alias("node"), F.col("node").alias("root")))
    least = Table(both.groupBy("node").agg(F.min("root").alias("m")).select("node", F.least("node", "m").alias("m")), "stars")
    larger = both.where("root > node").select("node", F.col("root").alias("far"))
    out = Table(larger.join(least.df, "node").select(F.col("far").alias("node"), F.col("m").alias("root")).distinct(), "links")
    least.drop()
    return out


def _small_star(now: Table) -> Table:
    least = Table(now.df.groupBy("node").agg(F.min("root").alias("m")), "stars")
    moved = now.df.join(least.df, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
    out = Table(moved.unionByName(least.df.select("node", F.col("m").alias("root"))).distinct(), "links")
    least.drop()
    now.drop()
    return out
