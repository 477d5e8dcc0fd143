"""Groups of near-duplicate texts: SimHash proposals first, then all pairs that the prefix rule leaves.

Two texts are linked if their sets of SHINGLE-word runs have a Jaccard similarity of at
least `similarity`; a group is what links connect.  Nodes are texts by their words, so
exact copies are one node from the start.

1. Fingerprints within `distance` bits (multi-index hashing, two 32-bit tables whose
   cells shrink as fingerprints are spread over 2^32 values) propose links.
2. Two similar sets share one of the first (1 - similarity) of their runs, in any order
   that is the same for all texts; uncommon runs come first.  Runs are sent in packed
   blocks, and only runs that several texts have become cells.
3. What the proposals connect is taken as one for the moment.  Cells then give pairs of
   texts that are still apart: all of a small cell, and of a large one the nearest partner
   of each text.  Sizes and odd sketches (parities of hashed runs, whose differences
   never exceed the sets' differences) rule out pairs that cannot be similar.
4. All pairs are verified on the complete sets.  Where a proposal failed, and in large
   cells, all pairs that are still apart by verified links are then verified as well.

So the result is exact, whatever the distance; the steps before the last one only keep
the number of pairs near the number of texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, by_bytes, doc_text, free_name, lean, map_rows, scratch, small_batches
from .components import connected_components
from .simhash import CELL, PAIRS, SEED, fingerprint, near_links, shingle_hashes, words

SHINGLE, SIMILAR = 5, 0.8
#: Texts of the sample that tells which runs are common, and how many of these are kept.
SAMPLE, COMMON = 20_000, 100_000
#: Rows of a cell that give all their pairs at once; bytes of text in a block; most bits of a sketch.
SMALL, BLOCK, SKETCH = 32, 8 << 20, 1 << 16
#: Cells of a node, the first in order, that travel with it to tell where else a pair meets.
HEADS = 4
_ENTRY = np.dtype([("run", "<u4"), ("node", "<i8")])
_COMMON = np.dtype([("run", "<i8"), ("node", "<i8")])


def runs_of(text: str | None, shingle: int) -> np.ndarray:
    return np.unique(shingle_hashes(text, shingle))


def node_of(text: str | None) -> int:
    """Digest of the words in their order: texts that only differ in white space or the case of A-Z are one node."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(b" ".join(words(text)), SEED)).astype(np.int64))


def odd_sketch(runs: np.ndarray) -> bytes:
    """Parities of the runs in each of 2^k buckets, one or two for each run."""
    bits = min(SKETCH, 1 << max(6, (len(runs) - 1).bit_length()))
    return np.packbits(np.bincount((runs & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1, bitorder="little").tobytes()


def apart(left: list[bytes], right: list[bytes]) -> np.ndarray:
    """Buckets whose parities differ, of each pair of sketches: never more than the runs that only one of them has."""
    out = np.zeros(len(left), dtype=np.int64)
    sizes = np.array([(len(x), len(y)) for x, y in zip(left, right, strict=True)], dtype=np.int64).reshape(-1, 2)
    for a, b in np.unique(sizes, axis=0).tolist():
        those = np.flatnonzero((sizes == (a, b)).all(axis=1))
        x, y = (np.frombuffer(b"".join([side[k] for k in those.tolist()]), dtype=np.uint64).reshape(len(those), -1) for side in (left, right))
        least = min(a, b) // 8
        # A longer sketch is folded: its buckets are those of the shorter one, told apart by more bits.
        x, y = (np.bitwise_xor.reduce(v.reshape(len(those), -1, least), axis=1) for v in (x, y))
        out[those] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


def possible(n: np.ndarray, m: np.ndarray, least: float) -> np.ndarray:
    """Runs that two similar sets of these sizes may have apart at most; negative if the sizes rule it out."""
    fits = np.minimum(n, m) >= least * np.maximum(n, m) - 1e-9
    return np.where(fits, (1 - least) / (1 + least) * (n + m) + 1e-6, -1.0)


def common_runs(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word runs that several sampled texts have, in order, and their counts.

    Only the order in which runs are looked up comes from them, so that cells of common
    runs stay empty; what is found does not depend on the sample.
    """
    share = min(1.0, SAMPLE / max(1, texts.count()))
    some = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < share * (1 << 20))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            each = [runs_of(t, shingle) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(each).view(np.int64))], ["run"])

        return step

    counts = map_rows(some, make, "run long").groupBy("run").count().where("count > 1").orderBy(F.desc("count"), "run").limit(COMMON).toPandas()
    runs = counts["run"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(runs)
    return runs[order], counts["count"].to_numpy(np.int64)[order]


def prefix(runs: np.ndarray, known: np.ndarray, counts: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted distinct runs those that come first, uncommon ones before common ones; and which are common.

    Two sets with a Jaccard similarity of `least` or more share one of these, since each
    leaves out fewer than it must share.
    """
    n = len(runs)
    times = np.zeros(n, dtype=np.int64)
    if n and len(known):
        at = np.minimum(np.searchsorted(known, runs), len(known) - 1)
        times = np.where(known[at] == runs, counts[at], 0)
        order = np.argsort(times, kind="stable")
        runs, times = runs[order], times[order]
    first = max(0, n - int(np.ceil(least * n - 1e-9)) + 1) if n else 0
    return runs[:first], times[:first] > 0


_SENT = "bucket int, kind byte, doc_id long, fp long, node long, n int, data binary"
_NAMES = ["bucket", "kind", "doc_id", "fp", "node", "n", "data"]
#: Kinds of rows: a document's print, a block of runs that may be rare, a block of runs known to be common.
PRINT, RARE, KNOWN = 0, 1, 2


def _send(shared, buckets: int, width: int, shingle: int, least: float):
    def rows(kind: int, bucket: np.ndarray, data: list[bytes], doc_id=None, fp=None, node=None, n=None) -> pa.RecordBatch:
        none = [None] * len(data)
        return pa.RecordBatch.from_arrays(
            [pa.array(bucket, pa.int32()), pa.array([kind] * len(data), pa.int8()), doc_id if doc_id is not None else pa.array(none, pa.int64()), pa.array(fp or none, pa.int64()),
             pa.array(node or none, pa.int64()), pa.array(n or none, pa.int32()), pa.array(data, pa.binary())], _NAMES)

    def blocks(kind: int, bucket: np.ndarray, entries: np.ndarray):
        order = np.argsort(bucket, kind="stable")
        bucket, entries = bucket[order], entries[order]
        cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1)) if len(bucket) else np.zeros(1, dtype=np.int64)
        return rows(kind, bucket[cuts[:-1]], [entries[a:b].tobytes() for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)])

    def run(batches):
        known = shared.value
        for batch in batches:
            for few in by_bytes(batch, 1, BLOCK):
                fps, nodes, sizes, sketches, firsts = [], [], [], [], {}
                for text in few.column(1).to_pylist():
                    node, runs = node_of(text), runs_of(text, shingle)
                    fps.append(fingerprint(shingle_hashes(text, width)))
                    nodes.append(node)
                    sizes.append(len(runs))
                    sketches.append(odd_sketch(runs))
                    if node not in firsts:
                        firsts[node] = prefix(runs, *known, least)
                where = few.column(0).to_numpy().view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)
                yield rows(PRINT, (where % np.uint64(buckets)).astype(np.int32), sketches, few.column(0), fps, nodes, sizes)
                runs = np.concatenate([x for x, _ in firsts.values()])
                common = np.concatenate([x for _, x in firsts.values()])
                owner = np.repeat(np.fromiter(firsts, dtype=np.int64, count=len(firsts)), [len(x) for x, _ in firsts.values()])
                rare = np.zeros(int((~common).sum()), dtype=_ENTRY)
                rare["run"], rare["node"] = runs[~common] & np.uint64(0xFFFFFFFF), owner[~common]
                yield blocks(RARE, ((runs[~common] >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32), rare)
                often = np.zeros(int(common.sum()), dtype=_COMMON)
                # Less one bit, so that cells below zero are blocks only.
                often["run"], often["node"] = (runs[common] >> np.uint64(1)).astype(np.int64), owner[common]
                # Common runs need no counting, so they may go anywhere.
                yield blocks(KNOWN, (owner[common].view(np.uint64) % np.uint64(buckets)).astype(np.int32), often)

    return run


_KEPT = "kind byte, doc_id long, fp long, node long, n int, data binary, cell long"
_KEPT_NAMES = ["kind", "doc_id", "fp", "node", "n", "data", "cell"]


def _cells(cell: np.ndarray, node: np.ndarray):
    for at in range(0, len(cell), 50_000):
        m = len(cell[at:at + 50_000])
        none = [pa.nulls(m, t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.binary())]
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), none[0], none[1], pa.array(node[at:at + 50_000]), none[2], none[3], pa.array(cell[at:at + 50_000])], _KEPT_NAMES)


def _shared(bucket: int, held: list[bytes]):
    """Cells of the runs that several nodes of a bucket have."""
    entries = np.frombuffer(b"".join(held), dtype=_ENTRY)
    run, node = entries["run"], entries["node"]
    order = np.argsort(run, kind="stable")
    new = np.diff(run[order], prepend=run[order[:1]] - np.uint32(1)) != 0
    several = np.repeat(np.diff(np.append(np.flatnonzero(new), len(run))) > 1, np.diff(np.append(np.flatnonzero(new), len(run))))
    run, node = run[order][several].astype(np.int64), node[order][several]
    order = np.lexsort((node, run))
    run, node = run[order], node[order]
    own = np.concatenate([[True], (run[1:] != run[:-1]) | (node[1:] != node[:-1])]) if len(run) else np.zeros(0, dtype=bool)
    run, node = run[own], node[own]
    times = np.bincount(np.cumsum(np.diff(run, prepend=-1) != 0) - 1) if len(run) else np.zeros(0, dtype=np.int64)
    several = np.repeat(times > 1, times)
    yield from _cells((bucket << 32) + run[several], node[several])


def _recur(batches):
    """Prints as they are, and cells; rows come sorted by bucket, and one bucket is held."""
    bucket, held = None, []
    for batch in batches:
        kind = batch.column(1).to_numpy()
        prints = batch.filter(pa.array(kind == PRINT))
        if prints.num_rows:
            yield pa.RecordBatch.from_arrays([*prints.columns[1:], pa.nulls(prints.num_rows, pa.int64())], _KEPT_NAMES)
        for data in batch.filter(pa.array(kind == KNOWN)).column(6).to_pylist():
            entries = np.frombuffer(data, dtype=_COMMON)
            yield from _cells(entries["run"], entries["node"])
        rare = batch.filter(pa.array(kind == RARE))
        for b, data in zip(rare.column(0).to_pylist(), rare.column(6).to_pylist(), strict=True):
            if b != bucket and held:
                yield from _shared(bucket, held)
                held = []
            bucket = b
            held.append(data)
    if held:
        yield from _shared(bucket, held)


def met_before(cell: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """True for pairs that share an earlier cell too, by the first cells of both (rows of HEADS numbers): there they are looked at."""
    same = left[:, :, None] == right[:, None, :]
    return (same & (left < cell[:, None])[:, :, None]).any(axis=(1, 2))


def _pairs(cell, role, root, node, n, crowd, origin, sketch: list[bytes], heads: np.ndarray, least: float, every: bool, small: int):
    """Pairs (a, b) of nodes with different roots that may be similar; rows come sorted by cell, table rows first.

    Cells below zero are blocks of a hot cell (origin): there only lookups (role 1) ask, and
    of two nodes with different roots one does.  A pair that
    shares many cells is given by the first of them, as far as `heads` tell, not by all.
    """
    new = np.concatenate([[True], cell[1:] != cell[:-1]])
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    in_table = np.add.reduceat((role == 0).astype(np.int64), start)
    asked = np.where((cell < 0) & (role == 0), 0, np.minimum(np.arange(len(cell)) - start[which], in_table[which]))
    busy = np.flatnonzero(asked)
    done = np.cumsum(asked[busy])
    lo = 0
    while lo < len(busy):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
        rows, times = busy[lo:hi], asked[busy[lo:hi]]
        left = np.repeat(rows, times)
        right = start[which[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        limit = possible(n[left], n[right], least)
        keep = (root[left] != root[right]) & (limit >= 0)
        left, right, limit = left[keep], right[keep], limit[keep]
        for at in range(0, len(left), 100_000):
            x, y, most = left[at:at + 100_000], right[at:at + 100_000], limit[at:at + 100_000]
            here = ~met_before(origin[x], heads[x], heads[y])
            x, y, most = x[here], y[here], most[here]
            far = apart([sketch[k] for k in x.tolist()], [sketch[k] for k in y.tolist()])
            keep = far <= most
            x, y, far = x[keep], y[keep], far[keep] / most[keep]
            if not every:  # in a large cell, the nearest partner of each side will do for now
                large = crowd[x] > small
                order = np.argsort(far, kind="stable")
                nearest = np.zeros(len(x), dtype=bool)
                for side in (x, y):
                    nearest[order[np.unique(side[order], return_index=True)[1]]] = True
                x, y = x[~large | nearest], y[~large | nearest]
            if len(x):
                found = np.unique(np.stack([np.minimum(node[x], node[y]), np.maximum(node[x], node[y])]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], ["a", "b"])
        lo = hi


def _scan(least: float, every: bool, small: int):
    """Streams a partition sorted by cell; holds one cell's table rows and one batch at most."""

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            now = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            cell = now.column("cell").to_numpy()
            cut = int(np.searchsorted(cell, cell[-1], side="left"))
            if cut:
                yield from answered(now.slice(0, cut))
                held = now.slice(cut)
            elif cell[-1] < 0 and now.num_rows > 4 * CELL:  # a block with many lookups: they are answered now, its table stays
                yield from answered(now)
                held = now.filter(pc.equal(now.column("role"), 0))
            else:
                held = now
            held = held.combine_chunks()
        if held is not None and held.num_rows:
            yield from answered(held)

    def answered(rows: pa.Table):
        numbers = [rows.column(k).to_numpy() for k in ("cell", "role", "root", "node", "n", "crowd", "origin")]
        heads = rows.column("heads").combine_chunks().flatten().to_numpy().reshape(-1, HEADS)
        yield from _pairs(*numbers, rows.column("sketch").to_pylist(), heads, least, every, small)

    return run


def _meet(cells: DataFrame, roots: DataFrame, nodes: DataFrame, least: float, every: bool, most: int, small: int) -> DataFrame:
    """Pairs of nodes that share a cell, have different roots and may be similar.

    roots: node, root, split; nodes that it lacks are their own.  With `every`, all such pairs
    of large cells and of cells with a split node; else all pairs of small cells only, and of
    large ones the nearest.
    """
    rows = Table(cells.join(roots.hint("merge"), "node", "left").select("cell", "node", F.coalesce("root", "node").alias("root"), F.coalesce("split", F.lit(False)).alias("split")), "rows").df
    stats = rows.groupBy("cell").agg(F.count("*").alias("crowd"), F.min("root").alias("low"), F.max("root").alias("high"), F.max("split").alias("split")).where("low <> high")
    if every:
        stats = stats.where(F.col("split") | (F.col("crowd") > small))
    stats = Table(stats.select("cell", "crowd"), "crowds").df
    several = rows.join(stats.hint("merge"), "cell").select("cell", "node", "root", "crowd", F.lit(0).cast("byte").alias("role"), F.col("cell").alias("origin"))
    # A node's cells are runs of one text, so a list of them is bounded by that.
    padded = F.concat(F.array_sort(F.collect_set("cell")), F.array_repeat(F.lit((1 << 63) - 1), HEADS))
    heads = several.groupBy("node").agg(F.slice(padded, 1, HEADS).alias("heads"))
    hot = Table(stats.where(F.col("crowd") > most), "hot").df
    if not hot.isEmpty():
        several = _deal(several, hot, most)
    ready = several.join(heads.hint("merge"), "node").join(nodes.select("node", "n", "sketch").hint("merge"), "node")
    ready = ready.select("cell", "role", "root", "node", "n", "sketch", "crowd", "heads", "origin").repartition("cell").sortWithinPartitions("cell", "role")
    return Table(ready.mapInArrow(lean(_scan(least, every, small)), "a long, b long").distinct(), "meet").df


def _deal(rows: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """Rows of crowded cells, dealt to blocks: each stands in one, and those outside the cell's largest component look up all."""
    calm = rows.where(F.col("crowd") <= most)
    crowded = rows.where(F.col("crowd") > most)
    largest = crowded.groupBy("cell", "root").count().groupBy("cell").agg(F.max_by("root", F.struct("count", "root")).alias("major"))
    largest = Table(hot.join(largest, "cell").select("cell", "major", F.ceil(F.col("crowd") / F.lit(most)).cast("int").alias("blocks")), "largest").df
    dealt = crowded.join(largest, "cell")
    own = dealt.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    asks = dealt.where("root <> major").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("role", F.lit(1).cast("byte"))
    # Cells of blocks are negative and named anew.
    name = -(F.pmod(F.xxhash64("cell", "block"), F.lit(1 << 62)) + 1)
    columns = ["node", "root", "crowd", "role", "origin"]
    return calm.select("cell", *columns).unionByName(own.unionByName(asks).select(name.alias("cell"), *columns))


def _thinned(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs that sizes and sketches do not rule out."""
    small = nodes.select("node", "n", "sketch").hint("merge")
    left = pairs.join(small.withColumnsRenamed({"node": "a", "n": "n1", "sketch": "s1"}).hint("merge"), "a")
    both = left.join(small.withColumnsRenamed({"node": "b", "n": "n2", "sketch": "s2"}).hint("merge"), "b").select("a", "b", "n1", "n2", "s1", "s2")

    def run(batches):
        for batch in batches:
            limit = possible(batch.column(2).to_numpy(), batch.column(3).to_numpy(), least)
            yield batch.select(["a", "b"]).filter(pa.array(apart(batch.column(4).to_pylist(), batch.column(5).to_pylist()) <= limit))

    return both.mapInArrow(lean(run), "a long, b long")


def _sets(members: DataFrame, nodes: DataFrame, texts: DataFrame, shingle: int) -> Table:
    """(node, runs) of the given nodes, from one text each."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            listed = batch.column(1).to_pylist()
            return pa.RecordBatch.from_arrays([pa.array([node_of(t) for t in listed], pa.int64()), pa.array([runs_of(t, shingle).tobytes() for t in listed], pa.binary())], ["node", "runs"])

        return step

    chosen = nodes.join(members.hint("merge"), "node", "left_semi").select(F.col("rep").alias("doc_id")).distinct()
    # Merge joins at every size: ids grow with the corpus, so a broadcast that fits today would not tomorrow.
    return Table(map_rows(texts.join(chosen.hint("merge"), "doc_id", "left_semi"), make, "node long, runs binary"), "sets")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The (a, b) pairs whose sets of runs have a Jaccard similarity of at least `least`."""
    left = sets.select(F.col("node").alias("a"), F.col("runs").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("runs").alias("right"))
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "left", "right")

    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= least * (len(x) + len(y) - shared) - 1e-9:
                    keep.append(k)
            if keep:
                yield batch.select(["a", "b"]).take(pa.array(keep))

    return both.mapInArrow(lean(run), "a long, b long")


def duplicate_groups(docs: DataFrame, width: int = 3, distance: int = 3, segments: int = 2, shingle: int = SHINGLE, similarity: float = SIMILAR, most: int = CELL, small: int = SMALL) -> DataFrame:
    """(doc_id, group_id) of documents in groups of near-duplicates, group_id being the group's smallest doc_id.

    Exact: groups are what pairs with a Jaccard similarity of at least `similarity` over
    `shingle`-word runs connect.  A text of fewer words is one run; wordless and null texts
    are one group.  Rows with a null doc_id are in no group; rows that share a doc_id are
    one document, in one group.  Texts whose 64-bit digests collide (none is to be expected
    below some billion texts) stay apart.  An empty table gives no groups.
    """
    spark = docs.sparkSession
    small_batches(spark)
    texts = doc_text(docs).where("doc_id is not null")
    shared = spark.sparkContext.broadcast(common_runs(texts, shingle))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = texts.mapInArrow(lean(_send(shared, buckets, width, shingle, similarity)), _SENT).repartition("bucket").sortWithinPartitions("bucket")
    kept = Table(sent.mapInArrow(lean(_recur), _KEPT), "kept")
    prints = kept.df.where(F.col("kind") == PRINT).select("doc_id", "fp", "node", "n", F.col("data").alias("sketch"))
    cells = kept.df.where(F.col("kind") != PRINT).select("cell", "node")

    by_node = prints.groupBy("node").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp"), F.max("fp").alias("other"), F.min("n").alias("n"), F.min("sketch").alias("sketch"))
    every = Table(by_node, "nodes").df
    nodes = every.where("fp = other")

    near = Table(near_links(nodes.select("fp", F.col("node").alias("rep")), distance, segments, most).select("a", "b").distinct(), "near").df
    near = Table(_thinned(near, nodes, similarity), "near").df
    proposed = connected_components(near).withColumn("split", F.lit(False))
    pairs = Table(near.union(_meet(cells, proposed, nodes, similarity, False, most, small)).distinct(), "pairs").df
    members = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    sets = _sets(members, nodes, texts, shingle)
    sure = Table(_similar(pairs, sets.df, similarity), "similar").df

    # Components of proposals that verified links do not hold together are split: their cells are looked at again.
    verified = connected_components(sure)
    linked = proposed.select("node", F.col("root").alias("old")).unionByName(proposed.select(F.col("root").alias("node"), F.col("root").alias("old")).distinct())
    now = linked.join(verified.hint("merge"), "node", "full_outer").select("node", "old", F.coalesce("root", "node").alias("root"))
    now = Table(now, "verified").df
    broken = now.where("old is not null").groupBy("old").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    now = now.join(broken.hint("merge"), "old", "left").select("node", "root", F.col("low").isNotNull().alias("split"))
    late = _meet(cells, now, nodes, similarity, True, most, small).join(pairs.hint("merge"), ["a", "b"], "left_anti")
    sure = sure.union(Table(_similar(late, sets.df, similarity), "late").df)

    # Rows of one document belong together.
    first = prints.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    same = prints.select("doc_id", "node").join(first.hint("merge"), "doc_id").where("node <> a").select("a", F.col("node").alias("b"))
    roots = connected_components(sure.union(same))
    named = every.join(roots.hint("merge"), "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    named = Table(named, "named").df
    least = named.groupBy("root").agg(F.min("rep").alias("group_id"))
    grouped = Table(named.join(least.hint("merge"), "root").select("node", "group_id"), "grouped").df
    lone = every.where("fp <> other").select("node", F.lit(True).alias("alone"))
    out = prints.select("doc_id", "node").join(grouped, "node").join(lone.hint("merge"), "node", "left")
    return out.select("doc_id", F.when(F.col("alone"), F.col("doc_id")).otherwise(F.col("group_id")).alias("group_id"))


def keep_first(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without near-duplicates: of each group the row with the smallest doc_id stays.

    Rows that repeat a doc_id are one document: the first of them (by text) stays.  Rows
    with a null doc_id all stay; an empty table stays empty; other columns come through.
    """
    with scratch():
        groups = Table(duplicate_groups(docs, **options), "groups", keep=True).df
    gone, twice, at = (free_name(docs, n) for n in ("gone", "twice", "at"))
    dropped = Table(groups.where("doc_id <> group_id").select(F.col("doc_id").alias(gone)).distinct(), "dropped").df
    kept = docs.join(dropped.hint("merge"), F.col("doc_id").cast("long") == F.col(gone), "left_anti")
    repeated = Table(groups.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(twice)), "twice").df
    if repeated.isEmpty():
        return kept
    same = F.col("doc_id").cast("long") == F.col(twice)
    rest = kept.join(repeated, same, "left_semi")
    every = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    order = Window.partitionBy(F.col("doc_id").cast("long")).orderBy("text", *[F.to_json(F.struct(c)) for c in every])
    return kept.join(repeated, same, "left_anti").unionByName(rest.withColumn(at, F.row_number().over(order)).where(F.col(at) == 1).drop(at))
