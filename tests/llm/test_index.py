import numpy as np
import pyarrow as pa

from orbitquery.llm import decontam


def test_index_of_rows_in_any_order():
    """Lists of rows give the index that tables give, in whatever order they come."""
    texts = [(7, "seven one two three"), (2, "two four five six"), (5, "five nine ten")]
    postings = [(i, 0, w.encode(), 0.25) for i, t in texts for w in t.split()]
    tables = [pa.table({n: list(c) for n, c in zip(names, zip(*rows, strict=True), strict=True)}) for names, rows in ((("item_id", "text"), sorted(texts)), (("item_id", "seg", "term", "impact"), postings))]
    for index in (decontam.Index(texts, postings), decontam.Index(*tables)):
        ids = np.array([index.term[w] for w in (b"five", b"nine", b"ten")], dtype=np.int64)
        assert {index.items[k].item_id: round(s, 6) for k, s in index.retrieve(ids, 0.5).items()} == {5: 0.75}
    assert not decontam.Index([], []).term
