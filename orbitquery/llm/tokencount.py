"""Token counts from distinct pre-tokens.

A sentencepiece BPE whose pieces hold the blank mark only in front cannot merge
across the start of a run of blanks, so a text's count is the sum over its
pre-tokens (a run of blanks and the stretch behind it).

Documents are read in windows.  A window sends each bucket of pre-tokens one packed
row: its distinct pre-tokens there, and which documents hold them how often.  All
occurrences of a pre-token meet in one bucket, where it is counted once and joined to
those frequencies; the documents' partial sums go back to their window and are added
up.  Pre-tokens that many documents of a window hold are spread over SALTS buckets.
No ids of a document are ever built.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import by_bytes, doc_text, resident, small_batches
from .subwords import Memo, encoder, vocabulary_path

#: Bytes of text in a window, and pre-tokens that a worker remembers in each of two generations.
WINDOW, KNOWN = 8 << 20, 500_000
#: A pre-token is spread over SALTS buckets if more than this share of a window's documents hold it.
FREQUENT, SALTS = 0.125, 16
BLANK_MARK = "▁"
_UNITS = re.compile(r" *[^ ]+| +\Z")


class PieceCounter:
    def __init__(self, vocabulary: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(vocabulary))
        pieces = map(self.library.id_to_piece, range(self.library.get_piece_size()))
        #: Pre-tokens are independent only if no piece has the mark behind another character.
        self.separable = not any(BLANK_MARK in p.lstrip(BLANK_MARK) for p in pieces)
        # A unit is written without its first blank; an empty one is a blank that ends the text.
        self.known = Memo(lambda units: [n if u else 1 for u, n in zip(units, map(len, self.library.encode(units, num_threads=1)), strict=True)], KNOWN)

    def whole(self, text: str) -> bool:
        """True if the text has no independent pre-tokens: it is one pre-token."""
        return not self.separable or BLANK_MARK in text

    @staticmethod
    def units(text: str) -> list[str]:
        if "  " in text or text[0] == " " or text[-1] == " ":
            return [u[1:] for u in _UNITS.findall(" " + text)]
        return text.split(" ")

    def count(self, text: str) -> int:
        """The count of one text."""
        if not text:
            return 0
        return len(self.library.encode(text)) if self.whole(text) else sum(map(self.known, self.units(text)))


def counter(vocabulary: str) -> PieceCounter:
    return resident(("sentencepiece", vocabulary), lambda: PieceCounter(vocabulary))


def frequencies(texts: pa.Array, whole: list[int], alone: list[int]) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pre-tokens; then by pre-token: which one, in which text, how often.

    whole: texts without pre-tokens; alone: texts with odd blanks, which are cut one by one.
    """
    cut = pc.split_pattern(texts, " ")
    sizes = np.diff(cut.offsets.to_numpy())
    keep = pc.not_equal(texts, "").to_numpy(zero_copy_only=False)
    keep[whole + alone] = False
    flat = cut.flatten().filter(pa.array(np.repeat(keep, sizes)))
    where = np.repeat(np.flatnonzero(keep), sizes[keep])
    if alone:
        more = [PieceCounter.units(texts[k].as_py()) for k in alone]
        flat = pa.concat_arrays([flat, pa.array([u for some in more for u in some], pa.string())])
        where = np.concatenate([where, np.repeat(alone, [len(x) for x in more])])
    coded = flat.dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    pairs, often = np.unique(code * len(texts) + where, return_counts=True)
    return coded.dictionary, pairs // max(1, len(texts)), pairs % max(1, len(texts)), often


def _buffers(strings: pa.Array) -> tuple[bytes, np.ndarray]:
    """UTF-8 of all strings of an array that is no slice, and where each begins and ends."""
    _, offsets, data = strings.buffers()
    return data.to_pybytes() if data else b"", np.frombuffer(offsets, dtype=np.int32, count=len(strings) + 1)


def _strings(strings: pa.Array) -> list[bytes]:
    letters, offsets = _buffers(strings)
    cuts = offsets.tolist()
    return [letters[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]


def _packed(values: np.ndarray) -> bytes:
    """Non-negative integers in the fewest bytes; the reader knows how many there are."""
    top = int(values.max(initial=0))
    return values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4").tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, dtype=f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, dtype=np.int64)


_PARTS = pa.schema([("bucket", pa.int32()), ("window", pa.int64()), ("seq", pa.int32()), ("n", pa.int32()), ("doc_id", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())),
                    ("counts", pa.list_(pa.int64())), ("words", pa.binary()), ("lengths", pa.binary()), ("held", pa.binary()), ("docs", pa.binary()), ("often", pa.binary())])
_SUMS = pa.schema([*[_PARTS.field(k) for k in ("window", "seq", "n", "doc_id", "n_bytes", "counts", "docs")], ("parts", pa.int32())])
_KINDS = {pa.int32(): "int", pa.int64(): "long", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}


def _ddl(schema: pa.Schema) -> str:
    return ", ".join(f"{f.name} {_KINDS[f.type]}" for f in schema)


def _rows(schema: pa.Schema, rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _send(vocabulary: str, buckets: int):
    """Windows of (doc_id, text) as a head row with the documents, and one row for each bucket of pre-tokens."""

    def run(batches):
        pieces, part, seq = counter(vocabulary), TaskContext.get().partitionId(), 0
        for batch in batches:
            for few in by_bytes(batch, 1, WINDOW):
                texts = few.column(1).fill_null("")
                listed = texts.to_pylist()
                whole = [k for k, t in enumerate(listed) if pieces.whole(t)]
                skip = set(whole)
                alone = [k for k, t in enumerate(listed) if k not in skip and t and ("  " in t or t[0] == " " or t[-1] == " ")]
                words, code, doc, often = frequencies(texts, whole, alone)
                base = np.zeros(len(listed), dtype=np.int64)
                for k in whole:
                    base[k] = pieces.count(listed[k])
                held = np.bincount(code, minlength=len(words))
                hashed = np.fromiter(map(zlib.crc32, _strings(words)), dtype=np.int64, count=len(words))
                window = (part << 32) + seq
                salt = zlib.crc32(window.to_bytes(8, "little")) % SALTS
                frequent = held > max(64, FREQUENT * len(listed))
                bucket = (hashed + np.where(frequent, salt * 0x9E3779B1, 0)) % buckets
                order = np.lexsort((doc, code, bucket[code]))
                doc, often = doc[order], often[order]
                by_bucket = np.argsort(bucket, kind="stable")
                ends = np.append(np.flatnonzero(np.diff(bucket[by_bucket])) + 1, len(by_bucket)).tolist() if len(words) else []
                letters, offsets = _buffers(words.take(pa.array(by_bucket)))
                head = {"bucket": window % buckets, "window": window, "seq": -1, "n": len(listed), "doc_id": few.column(0).to_pylist(), "n_bytes": pc.binary_length(texts).cast(pa.int64()).to_pylist(), "counts": base.tolist()}
                out, at, row = [head], 0, 0
                for end in ends:
                    mine = by_bucket[at:end]
                    rows = int(held[mine].sum())
                    out.append({
                        "bucket": int(bucket[mine[0]]), "window": window, "seq": end - at, "n": len(listed), "words": letters[offsets[at]:offsets[end]], "lengths": _packed(np.diff(offsets[at:end + 1])),
                        "held": _packed(held[mine]), "docs": _packed(doc[row:row + rows]), "often": _packed(often[row:row + rows]),
                    })
                    at, row = end, row + rows
                seq += 1
                yield _rows(_PARTS, out)
        pa.default_memory_pool().release_unused()

    return run


def _count(vocabulary: str):
    """Each pre-token's count joined to its frequencies: partial sums of the documents of a window."""

    def run(batches):
        pieces = counter(vocabulary)
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["seq"] < 0:
                    out.append({k: r.get(k) for k in _SUMS.names} | {"parts": 0})
                    continue
                ends = np.cumsum(_unpacked(r["lengths"], r["seq"])).tolist()
                words = [r["words"][a:b].decode() for a, b in zip([0, *ends], ends, strict=False)]
                held = _unpacked(r["held"], len(words))
                each = np.repeat(np.array(pieces.known.many(words), dtype=np.int64), held)
                docs = _unpacked(r["docs"], len(each))
                sums = np.bincount(docs, each * _unpacked(r["often"], len(each)), minlength=r["n"]).astype(np.int64)
                has = np.flatnonzero(sums)
                out.append({"window": r["window"], "seq": len(has), "n": r["n"], "counts": sums[has].tolist(), "docs": _packed(has), "parts": 1})
            if out:
                yield _rows(_SUMS, out)

    return run


def _gather(limit: int):
    """The documents of each window with their sums; rows come sorted by window, its head first."""

    def close(head: dict, sums: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(head["doc_id"], pa.int64()), pa.array(head["n_bytes"], pa.int64()), pa.array(sums), pa.array(sums > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        )

    def run(batches):
        head = sums = None
        for batch in batches:
            for r in batch.to_pylist():
                if r["parts"] == 0:
                    if head is not None:
                        yield close(head, sums)
                    head, sums = r, np.array(r["counts"], dtype=np.int64)
                else:
                    if head is None or head["window"] != r["window"]:
                        raise ValueError("sums without their window: documents must come in the same order whenever they are read")
                    sums[_unpacked(r["docs"], r["seq"])] += np.array(r["counts"], dtype=np.int64)
        if head is not None:
            yield close(head, sums)

    return run


def token_counts(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of every document.

    Nulls: a null text counts as empty (0 bytes, 0 tokens); a null doc_id stays null.
    Empty tables give empty results, repeated rows a row each; other columns are ignored.
    A text that holds the blank mark itself is one pre-token.  docs is a scan or a written
    table, whose rows come in the same order when a lost task is run again.  For
    vocabularies of the tokenizers library the ids of a batch are counted.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = doc_text(docs)
    if not vocabulary.endswith(".model"):
        return rows.mapInArrow(_sizes(vocabulary, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = rows.mapInArrow(_send(vocabulary, buckets), _ddl(_PARTS)).repartition(buckets, "bucket")
    sums = sent.mapInArrow(_count(vocabulary), _ddl(_SUMS)).repartition("window").sortWithinPartitions("window", "parts")
    return sums.mapInArrow(_gather(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def _sizes(vocabulary: str, limit: int):
    def run(batches):
        tokens = encoder(vocabulary)
        for batch in batches:
            for few in by_bytes(batch, 1):
                n = np.diff(tokens.encode_column(few.column(1), 0)[1], prepend=0) - 1
                size = pc.binary_length(few.column(1).fill_null("")).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([few.column(0), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run
