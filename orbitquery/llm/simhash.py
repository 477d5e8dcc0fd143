"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments.  Two fingerprints within `distance` bits
differ by at most distance // segments bits in one segment at least, so small
Hamming balls around each segment value, looked up in that segment's table, meet
every such pair; complete distances are then verified.  Balls are split between
the two sides: for one differing bit, only the side that has the bit set clears
it; for two, each side flips one.

Only connections matter, so a table cell gives a spanning forest of its links,
never all pairs of a group of copies.  Cells beyond CELL table rows are dealt to
blocks that each see every row once.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, doc_text, hex64, lean, map_rows, scratch
from .components import connected_components, spanning

#: Table rows of a cell that one block holds, and pairs compared at once.
CELL, PAIRS = 4096, 2_000_000
SEED = 42
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text: str | None) -> list[bytes]:
    """Words of a text with A-Z in lower case, as UTF-8."""
    return _WORD.findall(text.encode("utf-8", "surrogatepass").translate(_LOWER)) if text else []


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of `width` words, repeats included; a shorter text is one run, an empty one none."""
    import xxhash

    digest, parts = xxhash.xxh64_intdigest, words(text)
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= width:
        return np.array([digest(joined, SEED)], dtype=np.uint64)
    starts = np.cumsum([0] + [len(w) + 1 for w in parts])
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:-width].tolist(), (starts[width:] - 1).tolist(), strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half the hashes; 0 for none."""
    if not len(hashes):
        return 0
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        some = hashes[at:at + 65_536]
        total += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp) with fp the 64 bits as a signed long; a null or wordless text has 0."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            fps = [fingerprint(shingle_hashes(t, width)) for t in batch.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

        return step

    return map_rows(doc_text(docs), make, "doc_id long, fp long")


def _segments(count: int) -> list[tuple[int, int]]:
    """(shift, bits) of each segment of 64 bits."""
    cuts = [round(64 * k / count) for k in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def cells(fps: np.ndarray, reps: np.ndarray, segments: int, radius: int) -> pa.RecordBatch:
    """Rows (cell, role, fp, rep): role 0 stands in the table, 1 looks it up."""
    cell, role, who = [], [], []
    row = np.arange(len(fps))
    values = fps.view(np.uint64)
    for k, (shift, bits) in enumerate(_segments(segments)):
        part = (values >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        # The segment's number goes above its widest value.
        named = lambda v, k=k: v.astype(np.int64) * segments + k
        cell.append(named(part))
        role.append(np.zeros(len(row), np.int8))
        who.append(row)
        for i in range(bits if radius else 0):
            bit = np.uint64(1 << i)
            if radius == 1:
                has = np.flatnonzero(part & bit)
                cell.append(named(part[has] ^ bit))
                role.append(np.ones(len(has), np.int8))
                who.append(has)
            else:
                cell.append(named(part ^ bit))
                role.append(np.zeros(len(row), np.int8))
                who.append(row)
    who = np.concatenate(who) if who else row
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(cell)), pa.array(np.concatenate(role)), pa.array(fps[who]), pa.array(reps[who])], ["cell", "role", "fp", "rep"]
    )


def _links_of(cell: np.ndarray, role: np.ndarray, fp: np.ndarray, rep: np.ndarray, distance: int):
    """Spanning links inside each cell; rows come sorted by cell, table rows first."""
    new = np.concatenate([[True], cell[1:] != cell[:-1]])
    start = np.flatnonzero(new)
    which = np.cumsum(new) - 1
    in_table = np.add.reduceat((role == 0).astype(np.int64), start)
    at = np.arange(len(cell)) - start[which]
    against = np.minimum(at, in_table[which])  # table rows before it, all of them for a lookup
    busy = np.flatnonzero(against)
    bits = fp.view(np.uint64)
    done = np.cumsum(against[busy])
    lo = 0
    while lo < len(busy):
        hi = max(lo + 1, int(np.searchsorted(done, (done[lo - 1] if lo else 0) + PAIRS, side="right")))
        rows, times = busy[lo:hi], against[busy[lo:hi]]
        left = np.repeat(rows, times)
        right = start[which[left]] + np.arange(len(left)) - np.repeat(np.cumsum(times) - times, times)
        far = np.bitwise_count(bits[left] ^ bits[right])
        near = np.flatnonzero((far <= distance) & (rep[left] != rep[right]))
        if len(near):
            a, b = rep[left[near]], rep[right[near]]
            keep = spanning(np.minimum(a, b), np.maximum(a, b), far[near])
            yield a[keep], b[keep], far[near][keep].astype(np.int32)
        lo = hi


def _scan(distance: int):
    """Streams a sorted partition; holds one cell's table rows and one batch at most."""

    def run(batches):
        held = None
        for batch in batches:
            now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)]
            if not len(now[0]):
                continue
            rows = now if held is None else [np.concatenate(x) for x in zip(held, now, strict=True)]
            cut = int(np.searchsorted(rows[0], rows[0][-1], side="left"))
            if cut == 0 and (rows[1] == 1).sum() > 100_000:  # one large cell: its lookups are answered now, its table stays
                yield from _as_batches(_links_of(*rows, distance))
                stays = rows[1] == 0
                held = [x[stays] for x in rows]
                continue
            if cut:
                yield from _as_batches(_links_of(*[x[:cut] for x in rows], distance))
            held = [x[cut:] for x in rows]
        if held is not None and len(held[0]):
            yield from _as_batches(_links_of(*held, distance))

    return run


def _as_batches(found):
    for a, b, far in found:
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(far)], ["a", "b", "bits"])


def near_links(nodes: DataFrame, distance: int = 3, segments: int = 2, most: int = CELL) -> DataFrame:
    """Links (a, b, bits) between rep numbers of (fp, rep) rows with distinct rep.

    They connect exactly the fingerprints that chains of at most `distance` bits connect.
    """
    radius = distance // segments
    if radius > 2:
        raise ValueError("distance // segments is 2 at most: use more segments")

    def spread(batches):
        for batch in batches:
            fps, reps = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
            for at in range(0, len(fps), 4096):
                yield cells(fps[at:at + 4096], reps[at:at + 4096], segments, radius)

    rows = nodes.select("fp", "rep").mapInArrow(lean(spread), "cell long, role byte, fp long, rep long")
    hot = Table(rows.where("role = 0").groupBy("cell").count().where(F.col("count") > most), "hot")
    if not hot.df.isEmpty():
        rows = _deal(rows, hot.df, most)
    ready = rows.repartition("cell").sortWithinPartitions("cell", "role", "fp")
    return ready.mapInArrow(lean(_scan(distance)), "a long, b long, bits int")


def _deal(rows: DataFrame, hot: DataFrame, most: int) -> DataFrame:
    """Rows of crowded cells, dealt to blocks: a table row stands in one and looks up the later ones, a lookup goes to all."""
    calm = rows.join(hot, "cell", "left_anti")
    blocks = rows.join(hot, "cell").withColumn("n", F.ceil(F.col("count") / F.lit(most)).cast("int"))
    own = F.pmod(F.xxhash64("fp", "rep"), F.col("n")).cast("int")
    first = F.when(F.col("role") == 0, own).otherwise(F.lit(0))
    dealt = blocks.withColumn("own", first).withColumn("block", F.explode(F.sequence("own", F.col("n") - 1)))
    dealt = dealt.withColumn("role", F.when((F.col("role") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1).cast("byte"))
    # Cells of blocks are negative, so they meet no other.
    name = -(F.pmod(F.xxhash64("cell", "block"), F.lit(1 << 62)) + 1)
    return calm.unionByName(dealt.select(name.alias("cell"), "role", "fp", "rep"))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 3, segments: int = 2, most: int = CELL) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Wordless and null texts have fingerprint zero and link like any other.  Repeated rows
    keep a row each.  A null doc_id gets its component's id and never names one (null if
    it has no numbered partner).  An empty table gives an empty result.
    """
    prints = Table(fingerprints(docs, width), "prints", keep=True).df
    with scratch():
        nodes = Table(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes").df
        links = near_links(nodes.where("rep is not null"), distance, segments, most)
        roots = connected_components(links.select("a", "b"))
        named = nodes.join(roots, nodes.rep == roots.node, "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
        named = Table(named, "named", keep=True).df
    return prints.join(named, "fp").select("doc_id", hex64(F.col("fp")).alias("fingerprint"), "component_id")
