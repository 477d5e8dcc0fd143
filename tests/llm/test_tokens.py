import random
import zlib

import numpy as np
import public_tokenizers as tokenizers_of
import pyarrow as pa
import pytest
import sentencepiece
from tokenizers import Tokenizer

from orbitquery.llm import packing, tokencount, wavelet
from orbitquery.llm.subwords import Memo, encoder

PARTS = ["a", "B", " ", "  ", "\n", "\t", "'s", "'S", "1", "é", "é", "\xa0", "\x85", "\x1c", "İ", "ß", "Σς", "<|endoftext|>", "<|startoftext|>", "!", "🙂", "　", "漢", "ﬁ", "\r\n", "٣", "_", "​", "▁", "<s>"]


def odd_texts(n=1500):
    rng = random.Random(1)
    return ["", " ", "\n"] + ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_ids_are_the_librarys(name):
    library = Tokenizer.from_file(tokenizers_of.path(name))
    for text in odd_texts():
        want = np.array(library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        assert encoder(name).encode(text) == want, repr(text)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_a_column_are_the_librarys(name):
    library = Tokenizer.from_file(tokenizers_of.path(name))
    texts = [*odd_texts(400), None, "x" * 70_000, "Word, word. Über-Ärger' l'été WORD,"]
    for some in (texts, [""], [None, "a"], []):
        ids, ends = encoder(name).encode_column(pa.array(some, pa.string()), 7)
        want = [library.encode(t or "", add_special_tokens=False).ids + [7] for t in some]
        assert ids.tolist() == [x for line in want for x in line]
        assert np.diff(ends, prepend=0).tolist() == [len(line) for line in want]


def test_memo_keeps_what_is_used_again():
    made = []
    memo = Memo(lambda keys: [made.append(k) or k * 2 for k in keys], 3)
    assert memo.many([1, 2, 3]) == [2, 4, 6] and memo(4) == 8 and memo(1) == 2
    assert made == [1, 2, 3, 4] and memo.many([1, 4, 5, 6, 7]) == [2, 8, 10, 12, 14]


def test_piece_counts_are_the_librarys():
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers_of.path("piece_bpe_32k.model"))
    count = tokencount.counter("piece_bpe_32k.model").count
    for text in odd_texts():
        assert count(text) == len(library.encode(text)), repr(text)


def test_counts_of_the_small_table_and_awkward_rows(spark, sf_dir, awkward, nothing):
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers_of.path("piece_bpe_32k.model"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, awkward):
        texts = sorted((str(r["doc_id"]), len((r["text"] or "").encode()), len(library.encode(r["text"] or ""))) for r in df.collect())
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in tokencount.token_counts(df).collect()) == texts
    assert tokencount.token_counts(nothing).count() == 0


def test_wavelet_matrix_answers_as_the_array():
    rng = np.random.default_rng(0)
    for n, top in ((0, 1), (1, 1), (511, 3), (70_000, 50_257), (200_000, 9)):
        a = rng.integers(0, top, n).astype(np.uint32)
        raw = wavelet.pack_shard([1, None], [n, 0], a)
        ids, lengths, m = wavelet.read_shard(raw)
        assert ids == [1, None] and lengths.tolist() == [n, 0] and (m.decode() == a).all()
        if not n:
            continue
        at = rng.integers(0, n, 50)
        assert (m.access(at) == a[at]).all()
        for token in {int(x) for x in a[:5]} | {top + 3}:
            where = np.flatnonzero(a == token)
            assert m.rank(token) == len(where) and m.rank(token, n // 2) == (where < n // 2).sum()
            for k in {0, len(where) // 2, len(where) - 1} if len(where) else set():
                assert m.select(token, k) == where[k]
        with pytest.raises(IndexError):
            m.access([n])
        with pytest.raises(ValueError):
            wavelet.read_shard(raw[:-9] + b"\x01" + raw[-8:] if raw[-9:-8] != b"\x01" else raw[:-9] + b"\x02" + raw[-8:])


def test_token_files_round_trip(spark, sf_dir, awkward, nothing, monkeypatch):
    library = Tokenizer.from_file(tokenizers_of.path("byte_bpe_50k.json"))
    monkeypatch.setattr(wavelet, "SHARD_IDS", 5000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, awkward):
        rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or ""), r["doc_id"]) for r in df.collect())
        want, start = [], 0
        for (_, _, text), doc_id in rows:
            ids = library.encode(text, add_special_tokens=False).ids + [0]
            want.append((str(doc_id), start, len(ids), crc(ids)))
            start += len(ids)
        got = wavelet.read_token_shards(wavelet.write_token_shards(df)).collect()
        assert sorted((str(r["doc_id"]), r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(want)
    assert wavelet.read_token_shards(wavelet.write_token_shards(nothing)).count() == 0


def test_packing_places_every_piece(spark, sf_dir, awkward, nothing):
    library = Tokenizer.from_file(tokenizers_of.path("word_bpe_49k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, awkward):
        want = []
        for r in df.collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
            want += [(str(r["doc_id"]), at // 4096, at, len(ids[at:at + 4096]), crc(ids[at:at + 4096])) for at in range(0, len(ids), 4096)]
        got = packing.pack_documents(df).collect()
        assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(want)
        check_sequences(got, 4096)
    rows = sum(r["length"] for r in got)
    assert len({r["sequence_id"] for r in got}) <= -(-rows // 4096) + 1
    assert packing.pack_documents(nothing).count() == 0


def check_sequences(rows, capacity):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_every_capacity_holds(rule):
    rng = np.random.default_rng(7)
    lengths = rng.integers(1, 200, 600)
    bins, offsets = packing.pack_vectors(lengths, 256, max_docs=5, max_cost=30_000 + 200 * 200, rule=rule)
    for b in np.unique(bins):
        mine = lengths[bins == b]
        assert mine.sum() <= 256 and len(mine) <= 5 and (mine.astype(float) ** 2).sum() <= 70_000
    loose = len(np.unique(packing.pack_vectors(lengths, 256, rule=rule)[0]))
    assert loose <= 1.03 * lengths.sum() / 256 + 1
    with pytest.raises(ValueError):
        packing.pack_vectors(np.array([300]), 256)
    assert (offsets >= 0).all()


def sequences_of(rows):
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append(r["length"])
    return bins


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_three_capacities_bind_together(spark, sf_dir, rule):
    """Tokens, documents and attention cost each end some sequences; their number stays near the best that all three allow."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    most, cost = 5, 5_000_000
    got = packing.pack_documents(docs, max_docs=most, max_cost=4096 * 4096, rule=rule).collect()
    check_sequences(got, 4096)
    bins = sequences_of(got)
    assert all(len(b) <= most and sum(x * x for x in b) <= 4096 * 4096 for b in bins.values())
    short = [r["length"] for r in got if r["length"] <= 2000]
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(short)], "doc_id long, length long")
    tight = sequences_of(packing.best_fit_pack(pieces, 4096, most, cost, rule).collect())
    assert all(len(b) <= most and sum(b) <= 4096 and sum(x * x for x in b) <= cost for b in tight.values())
    least = max(-(-sum(short) // 4096), -(-len(short) // most), -(-sum(x * x for x in short) // cost))
    assert len(tight) <= 1.35 * least + 2
    assert any(len(b) == most for b in tight.values()) and any(sum(x * x for x in b) > 0.85 * cost for b in tight.values())


def test_open_sequences_of_all_groups_are_packed_again(spark):
    rng = np.random.default_rng(5)
    lengths = np.concatenate([rng.integers(1, 4097, 1500), rng.integers(1, 300, 1500)]).tolist()
    pieces = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long")
    few = packing.best_fit_pack(pieces, per_task=100).collect()
    assert sorted(r["doc_id"] for r in few) == list(range(len(lengths)))
    check_sequences(few, 4096)
    one = len(sequences_of(packing.best_fit_pack(pieces).collect()))
    assert len(sequences_of(few)) <= 1.02 * one + 2


def test_counts_do_not_depend_on_windows_and_buckets(spark, sf_dir, monkeypatch):
    """Small windows, words that most documents hold, odd blanks and texts that are counted whole."""
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers_of.path("piece_bpe_32k.model"))
    texts = [" ".join(["the", "of", f"word{k % 7}", f"x{k}"] * (k % 5)) + " " * (k % 3) for k in range(300)] + odd_texts(200) + [None, "▁", "the"]
    docs = spark.createDataFrame([(None if k == 5 else k % 290, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in tokencount.token_counts(docs, limit=12).collect())
    want = [(None if k == 5 else k % 290, len((t or "").encode()), len(library.encode(t or ""))) for k, t in enumerate(texts)]
    assert got == sorted((str(d), b, n, n > 12) for d, b, n in want)
    ids = Tokenizer.from_file(tokenizers_of.path("byte_bpe_50k.json"))
    other = sorted((str(r["doc_id"]), r["n_tokens"]) for r in tokencount.token_counts(docs, "byte_bpe_50k.json").collect())
    assert other == sorted((str(d), len(ids.encode(t or "", add_special_tokens=False).ids)) for (d, _, _), t in zip(want, texts, strict=True))
