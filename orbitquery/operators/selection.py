"""Choosing among scored candidates, and resuming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import quad
from ..tables import Table

EARLY_STOP, ANGLE = 0.99, 45.0


def gated(attempts: DataFrame, score: str = "score", angle: str = "ang", least: float = quad.ACCEPTED, most: float = ANGLE) -> DataFrame:
    """Attempts that pass the rectangularity and the angle gate."""
    return attempts.where((F.col(score) > least) & (F.abs(F.col(angle)) <= most))


def first_success(attempts: DataFrame, query: str, order: Sequence[str]) -> DataFrame:
    """The first passing attempt of each query."""
    return attempts.withColumn("__n", F.row_number().over(Window.partitionBy(query).orderBy(*order))).where("__n = 1").drop("__n")


def best_candidate(ranked: DataFrame, query: str, score: str, order: Sequence[str]) -> DataFrame:
    """The highest score of each query, the first in order of equal ones."""
    by = Window.partitionBy(query).orderBy(F.desc(score), *order)
    return ranked.withColumn("__n", F.row_number().over(by)).where("__n = 1").drop("__n")


def best_until_stop(ranked: DataFrame, query: str, score: str, order: Sequence[str], stop: float = EARLY_STOP) -> DataFrame:
    """The best of each query among its rows up to and with the first above `stop`."""
    before = Window.partitionBy(query).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    open_ = ranked.withColumn("__m", F.max(score).over(before)).where(F.col("__m").isNull() | (F.col("__m") <= stop)).drop("__m")
    return best_candidate(open_, query, score, order)


def pending(work: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    return work.join(done.select(*keys).distinct(), list(keys), "left_anti")


def with_default(chips: DataFrame, sidecars: DataFrame, keys: Sequence[str], width: str, height: str) -> DataFrame:
    """Chips with their corner box; those without one get their whole extent."""
    out = chips.join(sidecars, list(keys), "left")
    for name, other in (("cx0", F.lit(0)), ("cy0", F.lit(0)), ("cx1", F.col(width)), ("cy1", F.col(height))):
        out = out.withColumn(name, F.coalesce(F.col(name), other))
    return out


def match_in_batches(ranked: DataFrame, verify: Callable[[DataFrame], DataFrame], query: str = "query_id", rank: str = "rank", size: int = 16,
                     save: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Early exit for set processing: verify ranks in batches, and go on only with queries not yet solved.

    verify gives the accepted rows of a batch; a candidate's outcome may not depend on others.
    save materialises a batch's accepted rows; by default they are written to the shared folder (an error
    on a cluster without one), so that a later batch does not run the earlier ones again.
    The result is each query's first success by rank, as if candidates were tried one by one.
    """
    last = ranked.agg(F.max(rank).alias("n")).first()["n"] or 0
    solved = None
    for k, low in enumerate(range(0, last, size)):
        batch = ranked.where((F.col(rank) > low) & (F.col(rank) <= low + size))
        if solved is not None:
            batch = pending(batch, solved, [query])
        accepted = first_success(verify(batch), query, [rank])
        accepted = save(accepted, k) if save else Table(accepted, "solved").df
        solved = accepted if solved is None else solved.unionByName(accepted)
    return solved if solved is not None else first_success(verify(ranked), query, [rank])


def match_as_needed(ranks: Callable[[DataFrame, int | None], DataFrame], queries: DataFrame, verify: Callable[[DataFrame], DataFrame], key: str = "vec_id", query: str = "query_id", rank: str = "rank",
                    size: int = 128, save: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """The result of match_in_batches over complete rankings, of which only those are made that are needed.

    ranks(queries, k) gives the k best candidates of each query, without k all of them.  Queries
    with no success among the first `size` get their complete ranking, the others do not.
    verify and save are those of match_in_batches.
    """
    save = save or (lambda rows, k: Table(rows, "solved").df)
    solved = save(first_success(verify(ranks(queries, size)), query, [rank]), 0)
    open_ = pending(queries, solved.select(F.col(query).alias(key)), [key])
    rest = verify(ranks(open_, None).where(F.col(rank) > size))
    return solved.unionByName(save(first_success(rest, query, [rank]), 1))
