import random

import numpy as np
import pytest

from orbitquery.llm import neardup
from test_simhash import components, plain_fingerprint


def jaccard(a, b):
    a, b = (set(neardup.shingle_hashes(t, 5).tolist()) for t in (a, b))
    return len(a & b) >= 0.8 * len(a | b)


def test_verified_groups(spark, awkward, nothing):
    rng = random.Random(9)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 400)) for _ in range(120)) for _ in range(8)]
    texts = []
    for t in base:
        for edits in (0, 0, 1, 2, 9):
            parts = t.split()
            for _ in range(edits):
                parts[rng.randrange(len(parts))] = f"new{rng.randint(0, 99)}"
            texts.append(" ".join(parts))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = range(len(texts))
    want = components([(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b])], ids)
    assert {r["doc_id"]: r["group_id"] for r in neardup.duplicate_groups(docs).collect()} == want
    kept = neardup.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want.values()))
    left = neardup.keep_first(awkward)
    assert left.columns == awkward.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(["1", "2", "5", "6", "8", "9", "10", "None"])
    assert neardup.keep_first(nothing).count() == 0
    twice = spark.createDataFrame([(3, "alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta epsilon zeta"), (4, "other words that stand here alone")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in neardup.keep_first(twice).collect()) == [3, 4]


def groups_of(spark, texts, **options):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ids = range(len(texts))
    pairs = [(a, b) for a in ids for b in ids if a < b and jaccard(texts[a], texts[b])]
    return {r["doc_id"]: r["group_id"] for r in neardup.duplicate_groups(docs, **options).collect()}, components(pairs, ids)


def test_a_lighter_proposal_displaces_no_similar_pair(spark):
    """Revisions of one text that differ among themselves; the original is the last document."""
    rng = random.Random(5)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
        for _ in range(6):
            parts = list(base)
            for at in rng.sample(range(0, 200, 6), 4):
                parts[at] = f"new{rng.randint(0, 9999)}"
            texts.append(" ".join(parts))
        texts.append(" ".join(base))
    got, want = groups_of(spark, texts)
    assert len(set(want.values())) == 12 and got == want


def test_similar_pairs_beyond_the_distance(spark):
    """Copies shortened to a similarity of 0.8 to 0.85, as far apart as their fingerprints may be."""
    rng = random.Random(6)
    texts, far = [], 0
    for _ in range(60):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(200)]
        a, b = " ".join(base), " ".join(base[: rng.randint(161, 170)])
        texts += [a, b]
        far += (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() > 11
    got, want = groups_of(spark, texts)
    assert far >= 3 and len(set(want.values())) == 60 and got == want


@pytest.mark.parametrize("most", [4096, 8])
def test_large_cells_lose_no_link(spark, most):
    """A crowd of revisions that share most runs, many pairs of them below the similarity, in cells taken as large and as hot."""
    rng = random.Random(7)
    texts = []
    for size in (60, 25, 3):
        base = [f"w{rng.randint(0, 3000)}" for _ in range(100)]
        for k in range(size):
            parts = list(base)
            for at in rng.sample(range(100), rng.choice([1, 2, 2, 3, 3])):
                parts[at] = f"new{rng.randint(0, 99999)}"
            texts.append(" ".join(parts))
    passage = [f"p{k}" for k in range(12)]  # shared by texts that are not similar
    texts += [" ".join([f"q{rng.randint(0, 9999)}" for _ in range(30)] + passage) for _ in range(20)]
    rng.shuffle(texts)
    got, want = groups_of(spark, texts, most=most, small=3)
    assert got == want and len(set(want.values())) < 100


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2**63, 3000).astype(np.uint64)
    sets = [np.unique(rng.choice(pool, n)) for n in (0, 1, 2, 3, 60, 64, 65, 500, 900, 2500) for _ in range(3)]
    sketches = [neardup.odd_sketch(s) for s in sets]
    pairs = [(a, b) for a in range(len(sets)) for b in range(len(sets))]
    far = neardup.apart([sketches[a] for a, _ in pairs], [sketches[b] for _, b in pairs])
    for (a, b), d in zip(pairs, far.tolist(), strict=True):
        assert d <= len(np.setxor1d(sets[a], sets[b])) and (a != b or d == 0)


def test_documents_with_several_texts_are_one(spark):
    rows = [(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve"), (2, "one two three four five six"), (3, "seven eight nine ten eleven twelve"), (None, "one two three four five six")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["doc_id"], r["group_id"]) for r in neardup.duplicate_groups(docs).collect()} == {(1, 1), (2, 1), (3, 1)}
    assert sorted(str(r["doc_id"]) for r in neardup.keep_first(docs).collect()) == ["1", "None"]


def test_pairs_are_given_once_by_their_first_cell():
    cell = np.array([5, 5, 5, -3])
    top = np.iinfo(np.int64).max
    left = np.array([[1, 5, top, top], [5, top, top, top], [2, 5, top, top], [-3, 4, top, top]])
    right = np.array([[1, 2, 5, top], [4, 5, top, top], [3, 5, top, top], [-3, 4, top, top]])
    assert neardup.met_before(cell, left, right).tolist() == [True, False, False, False]
