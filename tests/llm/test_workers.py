import zlib
from types import SimpleNamespace

import pyarrow as pa
import pyarrow.compute as pc
import pytest

from orbitquery.llm import common, packing
from orbitquery.llm.subwords import CachedEncoder


@pytest.fixture
def taken(spark, monkeypatch):
    """Functions that went to mapInArrow, to be run here."""
    found, frame = [], type(spark.range(1))
    real = frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, run, *a, **b: found.append(run) or real(self, run, *a, **b))
    monkeypatch.setattr(common, "_RESIDENT", {})
    return found


def test_packing_worker_stays_small(spark, taken, monkeypatch):
    """A worker encodes a megabyte at once whatever a batch holds, and packs without the encoder."""
    seen, real = [], CachedEncoder.encode_column
    monkeypatch.setattr(CachedEncoder, "encode_column", lambda self, texts, end: seen.append(sum(len(t or "") for t in texts.to_pylist())) or real(self, texts, end))
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    pieces = packing.cut_pieces(docs)
    texts = [" ".join(f"word{k % 53} and{d}" for k in range(2000)) for d in range(400)]
    batch = pa.record_batch({"doc_id": list(range(402)), "text": [*texts, None, ""]})
    made = pa.Table.from_batches(taken[0](iter([batch])))
    assert sum(seen) == sum(map(len, texts)) and max(seen) <= 1 << 20
    ids, ends = CachedEncoder("word_bpe_49k.json").encode_column(batch.column(1), 1)
    first = made.filter(pc.equal(made.column("piece"), 0)).to_pylist()
    assert [r["doc_id"] for r in first] == list(range(402)) and sum(made.column("length").to_pylist()) == ends[-1] == len(ids)
    begins = [0, *ends[:-1].tolist()]
    assert [r["ids_crc32"] for r in first] == [zlib.crc32(ids[a:a + r["length"]].astype("<u4").tobytes()) for a, r in zip(begins, first, strict=True)]
    assert common._RESIDENT
    packing.best_fit_pack(pieces)
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    list(taken[-1](iter(made.select(["doc_id", "piece", "start", "length", "ids_crc32"]).to_batches()[:0])))
    assert not common._RESIDENT
