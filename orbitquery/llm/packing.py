"""Vector best-fit packing of documents into sequences.

Every piece asks for three things: tokens, one document slot and attention cost
(its length squared).  In order of falling length, a piece goes to the open
sequence that can hold it in every respect and scores best: the smallest norm of
what would be left ("norm"), or the largest weighted dot product of demand and
residual ("dot").
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, by_bytes, doc_text, lean, small_batches
from .subwords import encoder

#: Pieces that one task packs, and the share of a capacity below which a sequence counts as open.
PIECES_PER_TASK, OPEN = 20_000, 0.98
#: Entries of a generation of the encoder's cache, and bytes of text that are encoded at once: a worker's memory is a multiple of both.
STRETCHES, SLICE = 200_000, 1 << 20


def pack_vectors(lengths: np.ndarray, capacity: int, max_docs: int | None = None, max_cost: int | None = None,
                 rule: str = "norm", weights: tuple[float, float, float] = (1.0, 0.01, 0.01)) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece; capacities left out never bind."""
    if rule not in ("norm", "dot"):
        raise ValueError("rule is norm or dot")
    caps = np.array([capacity, max_docs or capacity + 1, max_cost or capacity * capacity], dtype=np.float64)
    n = len(lengths)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.lexsort((np.arange(n), -lengths))
    if n and (lengths[order[0]] > caps[0] or float(lengths[order[0]]) ** 2 > caps[2]):
        raise ValueError("a piece alone exceeds a capacity")
    least = float(lengths.min()) if n else 0.0
    w = np.asarray(weights, dtype=np.float64) / caps**2
    left = np.empty((3, 1024))
    names = np.empty(1024, dtype=np.int64)
    used, opened = 0, 0
    for at, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
        need = (float(size), 1.0, float(size) * size)
        r = left[:, :used]
        fits = np.flatnonzero((r[0] >= need[0]) & (r[1] >= 1.0) & (r[2] >= need[2]))
        if len(fits):
            f = r[:, fits]
            if rule == "norm":
                score = w[0] * (f[0] - need[0]) ** 2 + w[1] * (f[1] - 1.0) ** 2 + w[2] * (f[2] - need[2]) ** 2
                slot = int(fits[np.argmin(score)])
            else:
                score = w[0] * f[0] * need[0] + w[1] * f[1] + w[2] * f[2] * need[2]
                slot = int(fits[np.argmax(score)])
        else:
            if used == left.shape[1]:
                left, names = np.concatenate([left, np.empty_like(left)], axis=1), np.concatenate([names, np.empty_like(names)])
            slot, used = used, used + 1
            left[:, slot], names[slot] = caps, opened
            opened += 1
        bins[at], offsets[at] = names[slot], int(capacity - left[0, slot])
        left[:, slot] -= need
        if left[0, slot] < least or left[1, slot] < 1.0 or left[2, slot] < least * least:  # nothing more can go in
            used -= 1
            left[:, slot], names[slot] = left[:, used], names[used]
    return bins, offsets


def cut_pieces(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids as little-endian 32-bit bytes, if kept)."""
    def run(batches):
        tokens = encoder(vocabulary, STRETCHES)
        for batch in batches:
            for few in by_bytes(batch, 1, SLICE):
                ids, ends = tokens.encode_column(few.column(1), end_id)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                sizes = np.diff(ends, prepend=0)
                pieces = -(-sizes // capacity)
                who = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(who)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[who] - start)
                begin = 4 * ((ends - sizes)[who] + start)
                spans = list(zip(begin.tolist(), (begin + 4 * length).tolist(), strict=True))
                arrays = [few.column(0).take(pa.array(who)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array([zlib.crc32(raw[a:b]) for a, b in spans], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays, names = [*arrays, pa.array([bytes(raw[a:b]) for a, b in spans], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(arrays, names)
                pa.default_memory_pool().release_unused()

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    small_batches(docs.sparkSession)
    return doc_text(docs).mapInArrow(lean(run, keeps=True), schema)


def best_fit_pack(pieces: DataFrame, capacity: int = 4096, max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", per_task: int = PIECES_PER_TASK) -> DataFrame:
    """Add sequence_id and offset to a table with `length`.

    Pieces are dealt evenly, whatever their keys, in groups of about `per_task`, and each
    group is packed by itself.  Sequences that a group leaves open (full in no respect) are
    taken apart, and their pieces, now of all groups, are packed again in groups of that size,
    as long as that leaves fewer open ones.  A null length is an error; an empty table gives none.
    """
    held = Table(pieces, "pieces").df
    done, turn, before = None, 0, None
    while True:
        n = max(1, -(-held.count() // per_task))
        packed = Table(_packed(held, n, turn, capacity, max_docs, max_cost, rule), "packed").df
        if n == 1 or turn == 3:
            break
        size = F.col("length").cast("double")
        full = (F.sum(size) >= OPEN * capacity) | (F.count("*") >= (max_docs or capacity + 1)) | (F.sum(size * size) >= OPEN * (max_cost or capacity * capacity))
        left = Table(packed.groupBy("sequence_id").agg(full.alias("full")).where("not full").select("sequence_id"), "open").df
        some = left.count()
        if not some or before is not None and some >= before:
            break
        closed = packed.join(left, "sequence_id", "left_anti").select(packed.columns)
        done = closed if done is None else done.unionByName(closed)
        held, before, turn = Table(packed.join(left, "sequence_id", "left_semi").select(held.columns), "rest").df, some, turn + 1
    return packed if done is None else done.unionByName(packed)


def _packed(held: DataFrame, n: int, turn: int, capacity: int, max_docs: int | None, max_cost: int | None, rule: str) -> DataFrame:
    """One dealing into n groups; sequence ids name the turn, the group and the sequence."""
    columns = held.columns

    def run(batches):
        part = TaskContext.get().partitionId()
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).sort_by([(c, "ascending") for c in ("doc_id", "start", "length", "ids_crc32") if c in columns])
        bins, offsets = pack_vectors(table.column("length").to_numpy(), capacity, max_docs, max_cost, rule)
        table = table.append_column("sequence_id", pa.array((turn << 60) + (part << 36) + bins)).append_column("offset", pa.array(offsets))
        yield from table.combine_chunks().to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.schema.fields)
    return held.repartition(n).mapInArrow(lean(run), schema + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096,
                   max_docs: int | None = None, max_cost: int | None = None, rule: str = "norm", keep_ids: bool = False) -> DataFrame:
    """One row for each piece of every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty (its end id alone); a document longer than `capacity` is cut into
    full pieces and a rest.  Null doc_ids and repeated rows are packed like any other row.
    """
    packed = best_fit_pack(cut_pieces(docs, vocabulary, end_id, capacity, keep_ids), capacity, max_docs, max_cost, rule)
    return packed.withColumn("piece", F.col("piece").cast("int"))
