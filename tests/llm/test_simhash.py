import random
import re

import numpy as np
import xxhash

from orbitquery.llm import simhash
from orbitquery.llm.components import connected_components


def plain_fingerprint(text):
    parts = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not parts:
        return 0
    runs = [" ".join(parts[k:k + 3]) for k in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def brute(prints, distance):
    ids = sorted(prints)
    return components([(a, b) for k, a in enumerate(ids) for b in ids[k + 1:] if (prints[a] ^ prints[b]).bit_count() <= distance], ids)


def test_operator_on_the_small_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    prints = {d: plain_fingerprint(t) for d, t in texts.items()}
    want = brute(prints, 3)
    got = simhash.near_duplicates(docs).collect()
    assert {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in got} == {d: (prints[d], want[d]) for d in texts}


def test_crowded_cells_are_dealt_exactly(spark):
    rng = random.Random(4)
    rows = {}
    for k in range(300):
        fp = 0x0123456789ABCDEF if k < 200 else rng.getrandbits(64)
        for _ in range(rng.randint(0, 7)):
            fp ^= 1 << rng.randint(0, 63)
        rows.setdefault(fp, k)
    prints = {k: fp for fp, k in rows.items()}
    nodes = spark.createDataFrame([(int(np.uint64(fp).astype(np.int64)), k) for k, fp in prints.items()], "fp long, rep long")
    for distance, segments, most in ((3, 2, 4096), (3, 2, 5), (5, 2, 7), (8, 3, 10), (11, 4, 20)):
        links = simhash.near_links(nodes, distance, segments, most).collect()
        assert components([(r["a"], r["b"]) for r in links], sorted(prints)) == brute(prints, distance)
        assert all((prints[r["a"]] ^ prints[r["b"]]).bit_count() == r["bits"] <= distance for r in links)


def test_components_of_chains_and_stars(spark):
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 160)] + [(200, 201), (201, 200), (7, 7)]
    want = components(pairs, {x for p in pairs for x in p})
    for alone in (500_000, 0):  # in one task, and by star steps
        links = spark.createDataFrame(pairs, "a long, b long").repartition(5)
        got = {r["node"]: r["root"] for r in connected_components(links, alone).collect()}
        assert got == {n: r for n, r in want.items() if n != r}
    assert connected_components(spark.createDataFrame([], "a long, b long"), 0).count() == 0


def test_awkward_documents(awkward, nothing):
    got = simhash.near_duplicates(awkward).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert len(got) == 13 and by[2] == by[3] == by[4] == {("0" * 16, 2)}
    assert {c for _, c in by[7] | by[11] | by[1]} == {1} and by[None].pop()[1] is None
    assert simhash.near_duplicates(nothing).count() == 0
