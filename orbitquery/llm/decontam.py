"""Benchmark decontamination: BM25 retrieval with block-max WAND, then overlap.

Test items are cut into segments and indexed once.  Every passage of every
document (windows of PASSAGE words, half overlapping) is a query; a segment's
score is its BM25 score over the score it gives itself, and all segments at or
above the threshold are retrieved.  Passages whose terms cannot reach it even
with every list's maximum are skipped (the WAND bound); for the others, blocks
of segments whose summed block maxima stay below it are never opened.  Items
retrieved for a document are verified by five-word shingles of the whole text
and by the words of their question and answer parts.

The index is broadcast in shards of bounded size, as Arrow columns.  A larger benchmark
takes more shards: each is searched by all documents, and its result written, before the
next one is read.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, lean, map_rows, resident

SHINGLE, CONTAINED = 5, 0.8
#: Words of a passage and of an index segment; a passage moves on by half, so each segment fits in one whole.
PASSAGE, SEGMENT = 128, 64
#: Share of its own score at which a segment is retrieved, and of a part's words at which the part overlaps.
RETRIEVED, PART = 0.5, 0.5
K1, B = 1.2, 0.75
#: Segments of a block, and bytes of item text in one broadcast shard; its index is some five times as large.
BLOCK, SHARD_BYTES = 16, 4 << 20
_WORDS = bytes(c if c >= 128 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    """ASCII letters in lower case; ASCII characters other than letters and digits separate words."""
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split() if text else []


def shingles(parts: list[bytes]) -> list[bytes]:
    """Five-word runs; a shorter text is one run, an empty one none."""
    if not parts:
        return []
    return [b" ".join(parts[k:k + SHINGLE]) for k in range(max(1, len(parts) - SHINGLE + 1))]


def question_answer(text: str | None) -> tuple[str, str]:
    """The last sentence is the answer, what stands before it the question; a single sentence is both."""
    text = (text or "").strip()
    cut = max((m.end() for m in re.finditer(r"[.?!:](?=\s)|\n", text)), default=0)
    return (text[:cut], text[cut:]) if cut else (text, text)


def segments(parts: list[bytes]) -> list[list[bytes]]:
    n = max(1, -(-len(parts) // SEGMENT))
    cuts = [round(len(parts) * k / n) for k in range(n + 1)]
    return [parts[a:b] for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


@dataclass
class Item:
    item_id: int
    shingles: set[bytes]
    question: set[bytes]
    answer: set[bytes]


class Items(dict):
    """The runs and words of items by their place, each made when it is first asked for."""

    def __init__(self, items: pa.Table):
        super().__init__()
        self.ids, self.texts = items.column("item_id").to_numpy(), items.column("text").combine_chunks()

    def __missing__(self, k: int) -> Item:
        text = self.texts[k].as_py()
        question, answer = question_answer(text)
        self[k] = Item(int(self.ids[k]), set(shingles(words(text))), set(words(question)), set(words(answer)))
        return self[k]


_TEXTS = pa.schema([("item_id", pa.int64()), ("text", pa.string())])
_POSTINGS = pa.schema([("item_id", pa.int64()), ("seg", pa.int32()), ("term", pa.binary()), ("impact", pa.float64())])


def _as_table(rows: pa.Table | list[tuple], schema: pa.Schema) -> pa.Table:
    if isinstance(rows, pa.Table):
        return rows
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


class Index:
    """Postings by term, in blocks of segments, each with its largest impact."""

    def __init__(self, items: pa.Table | list[tuple], postings: pa.Table | list[tuple]):
        """items: item_id, text; postings: item_id, seg, term, impact; tables or lists of rows."""
        self.items = Items(_as_table(items, _TEXTS).sort_by("item_id"))
        postings = _as_table(postings, _POSTINGS)
        place = np.searchsorted(self.items.ids, postings.column("item_id").to_numpy())
        part = postings.column("seg").to_numpy().astype(np.int64)
        width = int(part.max(initial=0)) + 1
        names, seg = np.unique(place * width + part, return_inverse=True)
        self.item_of = names // width
        coded = postings.column("term").combine_chunks().dictionary_encode()
        terms = coded.dictionary.to_pylist()
        self.term = {t: k for k, t in enumerate(terms)}
        t = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        impact = postings.column("impact").to_numpy()
        order = np.lexsort((seg, t))
        t, self.seg, self.impact = t[order], seg[order], impact[order]
        if not len(t):
            self.best = np.zeros(1)
            return
        key = t * (len(names) // BLOCK + 1) + self.seg // BLOCK
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        self.block, self.block_at = self.seg[new] // BLOCK, np.append(new, len(t))
        self.block_best = np.maximum.reduceat(self.impact, new)
        self.term_at = np.searchsorted(t[new], np.arange(len(terms) + 1))
        self.best = np.append(np.maximum.reduceat(self.block_best, self.term_at[:-1]), 0.0)  # the last is for unknown words

    def retrieve(self, ids: np.ndarray, threshold: float) -> dict[int, float]:
        """Best score of each item that some passage of the document retrieves. ids: term of each word, -1 if unknown."""
        found: dict[int, float] = {}
        bound = np.concatenate([[0.0], np.cumsum(self.best[ids])])
        starts = np.arange(0, max(1, len(ids) - PASSAGE // 2), PASSAGE // 2)
        ends = np.minimum(starts + PASSAGE, len(ids))
        alive = np.flatnonzero(bound[ends] - bound[starts] >= threshold - 1e-9)
        for at in range(0, len(alive), 256):
            self._score(ids, starts[alive[at:at + 256]], ends[alive[at:at + 256]], threshold, found)
        return found

    def _score(self, ids, starts, ends, threshold, found) -> None:
        n = ends - starts
        window = np.repeat(np.arange(len(starts)), n)
        terms = ids[np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        known = terms >= 0
        pairs = np.unique(window[known] * len(self.best) + terms[known])  # a query holds each term once
        window, terms = pairs // len(self.best), pairs % len(self.best)
        bound = np.bincount(window, self.best[terms], minlength=len(starts))
        keep = bound[window] >= threshold - 1e-9
        window, terms = window[keep], terms[keep]
        rows, entry = _ranges(self.term_at[terms], self.term_at[terms + 1])
        if not len(entry):
            return
        cell = window[rows] * (int(self.block.max()) + 1) + self.block[entry]
        cells, at = np.unique(cell, return_inverse=True)
        open_ = (np.bincount(at, self.block_best[entry]) >= threshold - 1e-9)[at]
        rows2, posting = _ranges(self.block_at[entry[open_]], self.block_at[entry[open_] + 1])
        if not len(posting):
            return
        hit = window[rows][open_][rows2] * len(self.item_of) + self.seg[posting]
        hits, at = np.unique(hit, return_inverse=True)
        score = np.bincount(at, self.impact[posting])
        for k in np.flatnonzero(score >= threshold - 1e-9).tolist():
            item = int(self.item_of[hits[k] % len(self.item_of)])
            found[item] = max(found.get(item, 0.0), float(score[k]))


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of each range, and which range they are from."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


def index_table(items: DataFrame) -> DataFrame:
    """(item_id, seg, term, impact): BM25 impacts over the segment's own score, with counts over all items."""

    def cut(batches):
        for batch in batches:
            out = {"item_id": [], "seg": [], "size": [], "term": [], "tf": []}
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for seg, parts in enumerate(segments(words(text))):
                    for term in sorted(set(parts)):
                        for name, value in zip(out, (item_id, seg, len(parts), term, parts.count(term)), strict=True):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, pa.schema([("item_id", pa.int64()), ("seg", pa.int32()), ("size", pa.int32()), ("term", pa.binary()), ("tf", pa.int32())]))

    raw = Table(items.mapInArrow(lean(cut), "item_id long, seg int, size int, term binary, tf int"), "terms").df
    whole = raw.select("item_id", "seg", "size").distinct().agg(F.count("*").alias("n"), F.avg("size").alias("mean"))
    stats = whole.first()
    if not stats["n"]:
        return raw.select("item_id", "seg", "term", F.lit(0.0).alias("impact"))
    df = raw.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    long = F.lit(1 - B) + F.lit(B) * F.col("size") / F.lit(stats["mean"])
    bm25 = raw.join(df, "term").select("item_id", "seg", "term", (idf * F.col("tf") * (K1 + 1) / (F.col("tf") + F.lit(K1) * long)).alias("bm25"))
    own = bm25.groupBy("item_id", "seg").agg(F.sum("bm25").alias("own"))
    return Table(bm25.join(own, ["item_id", "seg"]).select("item_id", "seg", "term", (F.col("bm25") / F.col("own")).alias("impact")), "impacts").df


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = RETRIEVED, contained: float = CONTAINED, part: float = PART) -> DataFrame:
    """(doc_id, item_id, score, n_shingles, n_found, question_overlap, answer_overlap) of each document that holds a test item.

    An item counts if `contained` of its five-word shingles and `part` of the words of its
    question and of its answer are in the document.  Null or wordless texts, items without
    words and items with null ids match nothing; of items that share an id one text is used
    (the smallest).  Repeated documents give their rows again, other columns are ignored,
    and an empty table on either side gives no rows.
    """
    items = items.where("item_id is not null").groupBy(F.col("item_id").cast("long").alias("item_id")).agg(F.min(F.col("text").cast("string")).alias("text"))
    items = Table(items.where("text is not null"), "items").df
    impacts = index_table(items)
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    shards = max(1, -(-size // SHARD_BYTES))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for k in range(shards):
        shared = _shard(items, impacts, k, shards)
        part_ = _search(texts, shared, threshold, contained, part)
        if shards > 1:  # one shard is all that is ever held
            part_ = Table(part_, "leaks").df
            shared.destroy()
        out = part_ if out is None else out.unionByName(part_)
    return out


def _shard(items: DataFrame, impacts: DataFrame, k: int, shards: int):
    mine = F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k
    texts = items.where(mine).orderBy("item_id").select("item_id", "text").toArrow()
    return items.sparkSession.sparkContext.broadcast((texts, impacts.where(mine).select("item_id", "seg", "term", "impact").toArrow()))


def _search(texts: DataFrame, shared, threshold: float, contained: float, part: float) -> DataFrame:
    names = [("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("n_shingles", pa.int64()), ("n_found", pa.int64()),
             ("question_overlap", pa.float64()), ("answer_overlap", pa.float64())]

    stamp = uuid.uuid4().hex

    def make():
        index = resident(("bm25", stamp), lambda: Index(*shared.value))
        number = index.term.get

        def step(batch: pa.RecordBatch):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                parts = words(text)
                ids = np.array([number(w, -1) for w in parts], dtype=np.int64)
                hits = index.retrieve(ids, threshold) if index.term and parts else {}
                if hits:
                    have, runs = set(parts), set(shingles(parts))
                    for k, score in sorted(hits.items()):
                        item = index.items[k]
                        n = len(item.shingles & runs)
                        q, a = (len(x & have) / len(x) if x else 1.0 for x in (item.question, item.answer))
                        if n >= contained * len(item.shingles) and q >= part and a >= part:
                            out.append((doc_id, item.item_id, round(score, 6), len(item.shingles), n, q, a))
            if not out:
                return None
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), names, strict=True)], [n for n, _ in names])

        return step

    return map_rows(texts, make, "doc_id long, item_id long, score double, n_shingles long, n_found long, question_overlap double, answer_overlap double", keeps=True)


#: What the retrieval may not lose: containment over whole texts, by brute force.
ORACLE_SQL = f"""
WITH w AS (
  SELECT 'd' AS side, doc_id AS id, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM documents
  UNION ALL
  SELECT 'i', item_id, list_filter(string_split_regex(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f]+', ' ', 'g'), ' '), lambda x: x <> '') FROM benchmark),
s AS (
  SELECT DISTINCT side, id, unnest(list_transform(range(1, greatest(len(words) - {SHINGLE - 1}, 1) + 1), lambda k: array_to_string(words[k:k + {SHINGLE - 1}], ' '))) AS run FROM w WHERE len(words) > 0),
n AS (SELECT id, count(*) AS n_shingles FROM s WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, n.n_shingles, count(*) AS n_found
FROM s AS d JOIN s AS i ON d.side = 'd' AND i.side = 'i' AND d.run = i.run JOIN n ON n.id = i.id
GROUP BY d.id, i.id, n.n_shingles HAVING count(*) >= {CONTAINED} * n.n_shingles
"""
