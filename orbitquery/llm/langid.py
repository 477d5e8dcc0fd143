"""Language identification by prediction by partial matching.

For each language a tree of byte contexts up to ORDER long is counted once over a
labelled sample and then frozen.  A byte costs -log2 of its share in the longest
context that was ever seen; a byte new to a context pays that context's escape
probability (distinct successors over all, method C) and is coded one byte
shorter, down to a uniform code over 256 bytes.  A text's code length under each
language is the exact sum over all its bytes, and the shortest wins.

All 256 byte values keep their own branches.  Trees are stored by their nodes: for a
block of languages, the runs that any of them has seen with a row of bits, and the
contexts with a row of escape bits.  A run that none has seen costs its context's
escape and is looked up one byte shorter.  Scoring is a vectorised hash lookup per byte
and block; a block's memory is bounded by its languages, and more languages make more
blocks.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, lean, map_rows, resident

ORDER = 3
#: Expected sample rows of a language: the bound on what is learned from.
ROWS_PER_LANGUAGE = 400
#: Languages of a block, and bytes that are scored at once.
BLOCK, CHUNK = 16, 1 << 19
UNDECIDED = "und"
#: A score tells how sure the choice is on the evidence of this many bytes at most.
EVIDENCE = 64
_LETTER = re.compile(r"[^\W\d_]")
_PAD = b" " * ORDER


def grams(raw: bytes, before: bytes = _PAD) -> np.ndarray:
    """Every byte with the ORDER bytes before it, as one number."""
    data = np.frombuffer(before + raw, dtype=np.uint8)
    out = np.zeros(len(raw), dtype=np.uint32)
    for k in range(ORDER + 1):
        out = out << np.uint32(8) | data[k:k + len(raw)]
    return out


class Keys:
    """Distinct numbers in an open-addressed table: find() gives their places, -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(4, int(4 * max(1, len(keys)) - 1).bit_length())
        self.table = np.full(1 << self.bits, -1, dtype=np.int32)
        pending, slot = np.arange(len(keys)), self._slot(keys)
        while len(pending):
            free = np.flatnonzero(self.table[slot] < 0)
            slots, first = np.unique(slot[free], return_index=True)
            self.table[slots] = pending[free[first]]
            left = np.ones(len(pending), dtype=bool)
            left[free[first]] = False
            pending, slot = pending[left], slot[left] + 1 & len(self.table) - 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint32) * np.uint32(0x9E3779B1) >> np.uint32(32 - self.bits)).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(wanted), -1, dtype=np.int32)
        slot = self._slot(wanted)
        found = self.table.take(slot)
        open_ = np.flatnonzero((found >= 0) & (self.keys.take(found) != wanted))
        slot = slot[open_]
        while len(open_):
            slot = slot + 1 & len(self.table) - 1
            found[open_] = self.table.take(slot)
            wrong = (found[open_] >= 0) & (self.keys.take(found[open_]) != wanted[open_])
            open_, slot = open_[wrong], slot[wrong]
        return found


class Trees:
    """The context trees of some languages, each given by its runs of ORDER + 1 bytes and their counts."""

    def __init__(self, samples: list[tuple[np.ndarray, np.ndarray]]):
        width = len(samples)
        self.runs: list[Keys] = []
        self.bits: list[np.ndarray] = []
        self.contexts: list[Keys] = []
        self.escapes: list[np.ndarray] = []
        shorter, short = np.full((1, width), 8.0), None  # a byte that no context knows
        for length in range(1, ORDER + 2):
            own = []
            for keys, count in samples:
                mask = np.uint32((1 << 8 * length) - 1)
                runs, at = np.unique(keys & mask, return_inverse=True)
                own.append((runs, np.bincount(at, count, minlength=len(runs))))
            every = np.unique(np.concatenate([r for r, _ in own])) if own else np.zeros(0, dtype=np.uint32)
            contexts = np.unique(every >> np.uint32(8))
            escape = np.zeros((len(contexts), width))
            bits = np.full((len(every), width), -1.0)
            for k, (runs, count) in enumerate(own):
                at = np.searchsorted(contexts, runs >> np.uint32(8))
                n, kinds = np.bincount(at, count, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
                seen = np.flatnonzero(kinds)
                escape[seen, k] = np.log2((n[seen] + kinds[seen]) / kinds[seen])
                bits[np.searchsorted(every, runs), k] = np.log2((n + kinds)[at] / count)
            # What a language has not seen: its context's escape, and the run without its oldest byte.
            down = shorter[np.searchsorted(short, every & np.uint32((1 << 8 * (length - 1)) - 1))] if length > 1 else np.repeat(shorter, len(every), axis=0)
            below = escape[np.searchsorted(contexts, every >> np.uint32(8))] + down
            shorter, short = np.where(bits < 0, below, bits), every
            self.runs.append(Keys(every))
            self.bits.append(shorter.astype(np.float32))
            self.contexts.append(Keys(contexts))
            self.escapes.append(escape.astype(np.float32))

    def score(self, wanted: np.ndarray) -> np.ndarray:
        """Bits of the last byte of each run, by language."""
        at = self.runs[ORDER].find(wanted)
        out = self.bits[ORDER].take(np.maximum(at, 0), axis=0) if len(self.bits[ORDER]) else np.zeros((len(wanted), self.bits[0].shape[1]), dtype=np.float32)
        rest = np.flatnonzero(at < 0)
        out[rest] = 0
        for length in range(ORDER, -1, -1):
            if not len(rest):
                break
            longer = wanted[rest] & np.uint32((1 << 8 * (length + 1)) - 1)
            context = self.contexts[length].find(longer >> np.uint32(8))
            known = context >= 0
            out[rest[known]] += self.escapes[length][context[known]]
            if not length:
                out[rest] += 8.0
                break
            at = self.runs[length - 1].find(longer & np.uint32((1 << 8 * length) - 1))
            known = at >= 0
            out[rest[known]] += self.bits[length - 1][at[known]]
            rest = rest[~known]
        return out


@dataclass(frozen=True)
class Model:
    languages: list[str]
    samples: list[tuple[np.ndarray, np.ndarray]]  # per language: runs of ORDER + 1 bytes and their counts
    stamp: str

    def trees(self) -> list[Trees]:
        """One for each block of languages, kept by the worker."""
        return resident(("contexts", self.stamp), lambda: [Trees(self.samples[k:k + BLOCK]) for k in range(0, len(self.samples), BLOCK)])

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Bits of each text under each language (texts by languages)."""
        total = np.zeros((len(texts), len(self.languages)))
        parts, owner, held = [], [], 0
        for k, text in enumerate(texts):
            raw = text.encode("utf-8", "surrogatepass")
            for at in range(0, len(raw), CHUNK):
                parts.append(grams(raw[at:at + CHUNK], raw[at - ORDER:at] if at else _PAD))
                owner.append(k)
                held += len(parts[-1])
                if held >= CHUNK:
                    self._add(parts, owner, total)
                    parts, owner, held = [], [], 0
        self._add(parts, owner, total)
        return total

    def _add(self, parts: list[np.ndarray], owner: list[int], total: np.ndarray) -> None:
        if not parts:
            return
        wanted = np.concatenate(parts)
        starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
        for k, trees in enumerate(self.trees()):
            sums = np.add.reduceat(trees.score(wanted), starts, axis=0, dtype=np.float64)
            np.add.at(total[:, k * BLOCK:k * BLOCK + sums.shape[1]], owner, sums)


def held_out(doc_id: str = "doc_id") -> Column:
    """Documents that nothing is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> DataFrame:
    """(lang, text) of about `rows` labelled, not held-out documents of each language, chosen by a hash of doc_id and text."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    ready = ready.where(F.col("lang").isNotNull() & ~held_out())
    # One row for each language, as many as the model itself has.
    sizes = ready.groupBy("lang").count().collect()
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, rows / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id", "text", F.lit(7)), F.lit(1 << 20)) / float(1 << 20)
    return ready.join(F.broadcast(shares), "lang").where((draw < F.col("share")) & F.col("text").isNotNull()).select("lang", "text")


def train(docs: DataFrame, rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Count the sample where it lies; only counts of byte runs reach the driver, and `rows` bounds what they are from."""

    def count(batches):
        total: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.setdefault(lang, []).append(grams(text.encode("utf-8", "surrogatepass")))
        for lang, parts in total.items():
            runs, n = np.unique(np.concatenate(parts), return_counts=True)
            table = pa.table({"lang": pa.array([lang] * len(runs)), "run": pa.array(runs.astype(np.int64)), "n": pa.array(n.astype(np.int64))})
            yield from table.to_batches(max_chunksize=10_000)

    sample = Table(labelled_sample(docs, rows), "langsample")
    counted = sample.df.mapInArrow(lean(count), "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")).toPandas()
    sample.drop()
    languages, samples = [], []
    for lang, mine in counted.groupby("lang", sort=True):
        mine = mine.sort_values("run")
        languages.append(lang)
        samples.append((mine["run"].to_numpy(np.uint32), mine["n"].to_numpy(np.float64)))
    return Model(languages, samples, uuid.uuid4().hex)


def choose(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Best language and score of each text; und and 0.0 for null, letterless texts or a model without languages."""
    named, scores = [UNDECIDED] * len(texts), [0.0] * len(texts)
    rows = [k for k, t in enumerate(texts) if t and _LETTER.search(t)]
    if not rows or not model.languages:
        return named, scores
    bits = model.code_lengths([texts[k] for k in rows])
    size = np.array([max(1, len(texts[k].encode("utf-8", "surrogatepass"))) for k in rows], dtype=np.float64)
    used = (bits - bits.min(axis=1, keepdims=True)) * np.minimum(1.0, EVIDENCE / size)[:, None]
    weight = np.exp2(-used)
    sure = weight.max(axis=1) / weight.sum(axis=1)
    for k, best, s in zip(rows, bits.argmin(axis=1).tolist(), sure.tolist(), strict=True):
        named[k], scores[k] = model.languages[best], s
    return named, scores


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All rows and columns of docs with the language and its score (0 to 1) added under `names`.

    und with score 0 where the text is null or has no letter.  Equal code lengths go to
    the first language by name.  Only `text` decides; older columns of these names are replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    kept = docs.drop(*names)
    at = kept.columns.index("text")

    def make():
        frozen = shared.value

        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            named, scores = choose(frozen, batch.column(at).to_pylist())
            return pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(named, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, *names]
            )

        return step

    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return map_rows(kept, make, f"{schema}, `{names[0]}` string, `{names[1]}` double", keeps=True)


def language_of(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document, learned from those not held out."""
    model = train(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return identify(texts, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
