"""Token files as wavelet matrices.

A shard holds the ids of a contiguous range of documents as bit planes, most
significant first, each stably partitioned by the plane before it, with rank
counts every 512 bits.  One file answers access, count (rank) and occurrence
lookup (select) without being expanded; reading it whole undoes the partitions
from the last plane to the first.

File: a fixed header, the document table, then for each plane its number of
zeros, its rank counts and its bits; a CRC32 of all that ends it.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, by_bytes, doc_text, fresh_path, read_bytes, small_batches, write_bytes
from .subwords import encoder

MAGIC = b"OQWM0001"
BLOCK = 512
#: Ids handled at once while a plane is made or undone; a multiple of BLOCK.
STEP = 1 << 17
#: Ids after which a shard is closed (at the end of a document).
SHARD_IDS = 4_000_000


class WaveletMatrix:
    """n ids of `bits` bits each."""

    def __init__(self, n: int, bits: int, zeros: list[int], ranks: list[np.ndarray], planes: list[np.ndarray]):
        self.n, self.bits, self.zeros, self.ranks, self.planes = n, bits, zeros, ranks, planes

    @classmethod
    def build(cls, ids: np.ndarray) -> "WaveletMatrix":
        n = len(ids)
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        now = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, ranks, planes = [], [], []
        for level in reversed(range(bits)):
            bit, lows, highs, bools = now.dtype.type(1 << level), [], [], []
            for at in range(0, n, STEP):  # in steps that stay in the cache
                some = now[at:at + STEP]
                ones = (some & bit) != 0
                bools.append(np.packbits(ones, bitorder="little"))
                # Index lists beat masks here: random bits would make each masked copy mispredict.
                lows.append(some.take(np.flatnonzero(~ones)))
                highs.append(some.take(np.flatnonzero(ones)))
            plane = np.concatenate([*bools, np.zeros(-(-(-n // 8)) % (BLOCK // 8), np.uint8)])
            per_block = np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint64)
            ranks.append(np.concatenate([[0], np.cumsum(per_block)]).astype("<u4"))
            planes.append(plane)
            zeros.append(sum(map(len, lows)))
            now = np.concatenate([*lows, *highs]) if n else now
        return cls(n, bits, zeros, ranks, planes)

    def _rank1(self, plane: int, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        block = at // BLOCK
        words = self.planes[plane].view(np.uint64)
        got = self.ranks[plane][block].astype(np.int64)
        for k in range(BLOCK // 64):
            start = block * BLOCK + 64 * k
            inside = np.clip(at - start, 0, 64)
            use = inside > 0
            if use.any():
                word = words[block[use] * (BLOCK // 64) + k]
                drop = (64 - inside[use]).astype(np.uint64)
                got[use] += np.bitwise_count(word << drop).astype(np.int64)
        return got

    def _bit(self, plane: int, at: np.ndarray) -> np.ndarray:
        return (self.planes[plane][at >> 3] >> (at & 7).astype(np.uint8)) & 1

    def access(self, at) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64).copy()
        if ((at < 0) | (at >= self.n)).any():
            raise IndexError("position outside the shard")
        value = np.zeros(len(at), dtype=np.int64)
        for plane in range(self.bits):
            bit = self._bit(plane, at).astype(bool)
            ones = self._rank1(plane, at)
            value = (value << 1) | bit
            at = np.where(bit, self.zeros[plane] + ones, at - ones)
        return value

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        span = np.array([start, end], dtype=np.int64)
        for plane in range(self.bits):
            ones = self._rank1(plane, span)
            span = self.zeros[plane] + ones if token >> (self.bits - 1 - plane) & 1 else span - ones
        return int(span[0]), int(span[1])

    def rank(self, token: int, end: int | None = None, start: int = 0) -> int:
        """Occurrences of a token in [start, end)."""
        if token < 0 or token >> self.bits:
            return 0
        low, high = self._range(token, start, self.n if end is None else end)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Position of the k-th occurrence (from 0)."""
        if token < 0 or token >> self.bits or not 0 <= k < self.rank(token):
            raise IndexError("no such occurrence")
        at = self._range(token, 0, self.n)[0] + k
        for plane in reversed(range(self.bits)):
            one = token >> (self.bits - 1 - plane) & 1
            at = self._select_bit(plane, one, at - self.zeros[plane] if one else at)
        return at

    def _select_bit(self, plane: int, bit: int, k: int) -> int:
        ones = self.ranks[plane].astype(np.int64)
        before = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(before, k, side="right")) - 1
        cells = np.unpackbits(self.planes[plane][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(cells == bit)[k - before[block]])

    def decode(self) -> np.ndarray:
        """All ids in order."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        now = np.zeros(self.n, dtype=kind)
        for level, plane in enumerate(reversed(range(self.bits))):
            bits = self.planes[plane]
            up = np.empty(self.n, dtype=kind)
            low, high, bit = 0, self.zeros[plane], kind(1 << level)
            for at in range(0, self.n, STEP):
                some = up[at:at + STEP]
                ones = np.unpackbits(bits[at // 8:(at + STEP) // 8], count=len(some), bitorder="little").view(bool)
                where0, where1 = np.flatnonzero(~ones), np.flatnonzero(ones)
                some[where0] = now[low:low + len(where0)]
                some[where1] = now[high:high + len(where1)] | bit
                low, high = low + len(where0), high + len(where1)
            now = up
        return now


def pack_shard(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    matrix = WaveletMatrix.build(ids)
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    parts = [
        MAGIC, struct.pack("<QQI", len(doc_ids), matrix.n, matrix.bits),
        np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(), np.asarray(lengths, dtype="<u8").tobytes(),
    ]
    for zeros, ranks, plane in zip(matrix.zeros, matrix.ranks, matrix.planes, strict=True):
        parts += [struct.pack("<Q", zeros), ranks.tobytes(), plane.tobytes()]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_shard(raw: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """doc_ids, their lengths and the matrix of a shard file."""
    if raw[: len(MAGIC)] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a whole token shard")
    docs, n, bits = struct.unpack_from("<QQI", raw, len(MAGIC))
    at = len(MAGIC) + 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, dtype=kind, count=count, offset=at)
        at += out.nbytes
        return out

    doc_ids, known, lengths = take("<i8", docs).tolist(), take("u1", docs).tolist(), take("<u8", docs)
    blocks = -(-(-(-n // 8)) // (BLOCK // 8))
    zeros, ranks, planes = [], [], []
    for _ in range(bits):
        zeros.append(int(take("<u8", 1)[0]))
        ranks.append(take("<u4", blocks + 1))
        planes.append(np.frombuffer(raw, np.uint8, blocks * BLOCK // 8, at).copy())
        at += blocks * BLOCK // 8
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], lengths, WaveletMatrix(n, bits, zeros, ranks, planes)


def write_token_shards(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, folder: str | None = None) -> DataFrame:
    """Encode every whole text, append end_id, and write shard files in ascending doc_id order (nulls first).

    Returns the manifest (part, seq, path, n_docs, n_tokens); shards ordered by (part, seq)
    hold ascending doc_ids.  A null text is empty; repeated rows are written each time; other
    columns are ignored, and an empty table gives an empty manifest.
    """
    spark = docs.sparkSession
    small_batches(spark)
    folder = folder or fresh_path(spark, "tokens")

    def run(batches):
        task = TaskContext.get()
        tokens, part, seq = encoder(vocabulary), task.partitionId(), 0
        doc_ids, lengths, pieces, held = [], [], [], 0

        def close():
            nonlocal doc_ids, lengths, pieces, held, seq
            # The attempt is in the name: a task run twice never writes over what the manifest may name.
            path = f"{folder}/part-{part:06d}-{seq:06d}-{task.taskAttemptId()}.oqwm"
            write_bytes(path, pack_shard(doc_ids, np.concatenate(lengths), np.concatenate(pieces)))
            row = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "n_docs": [len(doc_ids)], "n_tokens": [held]})
            doc_ids, lengths, pieces, held, seq = [], [], [], 0, seq + 1
            return row

        for batch in batches:
            for few in by_bytes(batch, 1):
                ids, ends = tokens.encode_column(few.column(1), end_id)
                names, at, done = few.column(0).to_pylist(), 0, 0
                while at < len(names):  # up to the document that fills the shard
                    stop = min(len(names), int(np.searchsorted(ends, done + SHARD_IDS - held, side="left")) + 1)
                    doc_ids += names[at:stop]
                    lengths.append(np.diff(ends[at:stop], prepend=done))
                    pieces.append(ids[done:ends[stop - 1]].astype(np.uint32))
                    held += int(ends[stop - 1]) - done
                    at, done = stop, int(ends[stop - 1])
                    if held >= SHARD_IDS:
                        yield close()
        if doc_ids:
            yield close()
        pa.default_memory_pool().release_unused()

    # By the text's hash as well, so that a doc_id (or null) of many rows is not one task; texts themselves would be sampled to the driver.
    rows = doc_text(docs).withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return Table(ordered.mapInArrow(run, "part long, seq long, path string, n_docs long, n_tokens long"), "manifest").df


def read_token_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, read from the files alone.

    A null doc_id comes back as null, an empty manifest gives no rows; a damaged or missing
    file is an error, and only the manifest's part, seq, path and n_tokens are read.
    """
    spark = manifest.sparkSession
    in_part = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each part: as many as write tasks, never as many as documents.
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_tokens").over(before), F.lit(0)).alias("part_start"))
    placed = manifest.withColumn("shard_start", F.coalesce(F.sum("n_tokens").over(in_part), F.lit(0))).join(parts, "part")
    shards = placed.select("path", (F.col("part_start") + F.col("shard_start")).alias("start"))
    n = max(1, min(manifest.count(), 4 * spark.sparkContext.defaultParallelism))

    def run(batches):
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                doc_ids, lengths, matrix = read_shard(read_bytes(path))
                raw = matrix.decode().astype("<u4")
                ends = np.cumsum(lengths.astype(np.int64))
                begins = ends - lengths.astype(np.int64)
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(start + begins), pa.array(lengths.astype(np.int64)), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return shards.repartition(n).mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
