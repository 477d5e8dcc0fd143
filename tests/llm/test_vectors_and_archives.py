import gzip
import hashlib
import time

import duckdb
import numpy as np
from pyspark.sql import functions as F

from orbitquery.llm import queries, topk, warc


def brute_top(vectors, k, chosen):
    out = []
    for q, x in vectors:
        if chosen(q):
            scores = sorted((-int(np.dot(x, y)), i) for i, y in vectors if i != q and len(x) == len(y))
            out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k_with_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(8)
    rows = [(i, np.round(rng.normal(size=48) * 2).tolist()) for i in range(700)]
    rows += [(700 + i, rows[3][1]) for i in range(30)] + [(900, None), (901, [1.0, None] + [0.0] * 46), (902, [float("nan")] * 48), (903, [float("inf")] * 48), (None, [1.0] * 48), (904, []), (1000, [1.0, 2.0]), (1001, [3.0, 4.0])]
    vectors = topk.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)))
    good = [(i, np.floor(1024 * np.array(v)).astype(np.int64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = brute_top(good, 10, lambda q: q % 100 == 0)
    for wave in (8 << 20, 2000):
        got = topk.exact_top_k(vectors, vectors.where("vec_id % 100 = 0"), wave_bytes=wave)
        assert sorted(map(tuple, got.collect())) == want
    assert topk.exact_top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_bounds_are_never_below_the_product():
    rng = np.random.default_rng(0)
    for d in (1, 5, 33, 64):
        x, y = rng.normal(size=(40, d)) * 3, rng.normal(size=(50, d))
        exact, last = x @ y.T, None
        for length in topk.LENGTHS:
            bound = topk.statistics(x, length) @ topk.statistics(y, length).T
            assert (bound >= exact - 1e-9).all()
            last = bound if last is None else last
        assert last is not None


def record(k, body):
    return warc.make_record(k, f"http://x.example/{k} a\r\nb", body, hashlib.sha256(body).hexdigest(), None, False)


def read(raw):
    found = list(warc.salvage(raw))
    return [x for x in found if isinstance(x, warc.Record)], [x for x in found if isinstance(x, warc.Gap)]


def pages_of(records):
    return [int(r.headers["x-page-id"]) for r in records]


def test_salvage_inside_members():
    raws = [record(k, bytes([65 + k]) * 3000) for k in range(5)]
    hurt = [raws[0], raws[1], raws[2][:-900] + b"x" + raws[2][-899:], raws[3], raws[4]]
    for pack in (gzip.compress, bytes):
        got, gaps = read(pack(b"".join(hurt)))
        assert pages_of(got) == [0, 1, 3, 4] and [r.inner is None for r in got] == [pack is bytes] * 4
        start = len(raws[0]) + len(raws[1])
        assert [(g.start, g.end, g.reason) for g in gaps] == [(start, start + len(raws[2]), "block digest")]
    whole = gzip.compress(b"".join(raws))
    for cut in (whole[:-5], whole[:-8] + b"12345678", whole[:-3] + b"abc"):  # a damaged trailer costs no record
        got, gaps = read(cut)
        assert pages_of(got) == [0, 1, 2, 3, 4] and [g.reason for g in gaps] == ["member check"]
    first = gzip.compress(b"rubbish" + raws[0][9:] + raws[1])  # the first record is no record
    got, gaps = read(first + gzip.compress(raws[2]))
    assert pages_of(got) == [1, 2] and gaps[0].member == 0 and gaps[0].start == 0


def test_salvage_keeps_what_came_before_damage():
    rng = np.random.default_rng(2)
    bodies = [rng.integers(0, 256, 40_000).astype(np.uint8).tobytes() for _ in range(6)]
    member = bytearray(gzip.compress(b"".join(record(k, b) for k, b in enumerate(bodies[:4]))))
    member[len(member) * 5 // 8] ^= 0xFF
    tail = gzip.compress(record(4, bodies[4])) + record(5, bodies[5])
    for raw in (bytes(member) + tail, bytes(member[:100_000]) + tail):  # damaged, and cut off
        got, gaps = read(raw)
        assert pages_of(got)[:2] == [0, 1] and pages_of(got)[-2:] == [4, 5] and gaps
        assert got[0].payload == bodies[0] and got[-1].payload == bodies[5]


def test_false_signatures_cost_linear_time():
    rng = np.random.default_rng(3)
    noise = rng.integers(0, 256, 4 << 20).astype(np.uint8)
    for sign in (b"WARC/1.0\r\n", b"WARC/1.", warc.MEMBER + b"\x08\0", warc.MEMBER):
        raw = noise.copy()
        for at in range(0, len(raw) - 64, 61):
            raw[at:at + len(sign)] = np.frombuffer(sign, np.uint8)
        good = record(1, b"fine" * 100)
        began = time.perf_counter()
        got, gaps = read(raw.tobytes() + good + gzip.compress(good))
        assert pages_of(got)[-2:] == [1, 1] and gaps[0].start == 0 and time.perf_counter() - began < 20


def test_a_long_address_is_read_back():
    raw = warc.make_record(3, "http://x/" + "a" * (2 << 20), b"body", hashlib.sha256(b"body").hexdigest(), None, False)
    assert pages_of(read(gzip.compress(raw))[0]) == [3]


def test_query_with_equal_payloads_against_sql(spark, tmp_path, oracle, same):
    bodies = ["<p>" + c * 120 for c in "abc"] + ["short", "", None, "é" * 49, "é" * 50]
    rows = [(7 * k % 101, f"http://h/{k}", bodies[k % len(bodies)]) for k in range(101)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = queries.op7_warc(spark, str(tmp_path))
    assert got.where("record_type = 'revisit'").count() > 40
    same(got, con.sql(queries.WARC_SQL))


def test_salvage_recovers_what_is_whole():
    raws = [record(k, bytes([65 + k]) * 300) for k in range(6)]
    for pack, sign in ((gzip.compress, warc.MEMBER), (lambda r: r, warc.VERSION)):
        parts = [pack(r) for r in raws]
        whole = b"".join(parts)
        got, gaps = read(whole)
        assert [r.headers["x-page-id"] for r in got] == list("012345") and not gaps and [r.payload for r in got] == [bytes([65 + k]) * 300 for k in range(6)]
        hurt = bytearray(whole)
        at = len(parts[0]) + len(parts[1]) // 2
        for k in range(at, at + 20):
            hurt[k] ^= 0x5A
        broken = b"junk" + bytes(hurt[:-40])
        got, gaps = read(broken)
        assert {r.headers["x-page-id"] for r in got} >= set("0234") and "5" not in {r.headers["x-page-id"] for r in got}
        assert gaps[0].start == 0 and gaps[0].end == 4 and gaps[-1].end == len(broken)
        spans = sorted([(r.start, r.end) for r in got] + [(g.start, g.end) for g in gaps])
        assert spans[0][0] == 0 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
        assert sign
    assert read(b"") == ([], [])


def test_archives_round_trip_with_awkward_pages(spark, monkeypatch):
    big = "<p>" + "y" * 200 + "</p>"
    rows = [(5, "u", big), (2, None, big), (9, "http://z/\n", big), (1, "v", "short"), (3, "v", "short"), (4, None, None), (6, "w", ""), (None, "n", big), (7, "é", "é" * 60), (8, "é", "é" * 60), (2, None, big)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload_digest", F.lit("clash"))
    for compress in (True, False):
        got = warc.read_archives(warc.write_archives(pages, compress=compress), keep_payload=True).collect()
        assert all(r["gap"] is None for r in got)
        kinds = sorted((str(r["page_id"]), r["record_type"], str(r["refers_to"]), r["payload_bytes"]) for r in got)
        n = len(big)
        assert kinds == sorted([("5", "revisit", "2", n), ("2", "response", "None", n), ("2", "response", "None", n), ("9", "revisit", "2", n), ("None", "revisit", "2", n), ("1", "response", "None", 5), ("3", "response", "None", 5),
                                ("4", "response", "None", 0), ("6", "response", "None", 0), ("7", "response", "None", 120), ("8", "revisit", "7", 120)])
        assert {r["payload_digest"] for r in got if r["page_id"] == 7} == {hashlib.sha256(("é" * 60).encode()).hexdigest()}
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_gaps_are_logged_by_the_reader(spark, tmp_path):
    raw = b"".join(gzip.compress(record(k, b"z" * 200)) for k in range(3))
    (tmp_path / "a.warc.gz").write_bytes(raw[:-5])
    manifest = spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz", 3, 0)], "path string, n_records long, n_bytes long")
    got = warc.read_archives(manifest).collect()
    assert sum(r["gap"] is None for r in got) == 3 and [r["gap"] for r in got if r["gap"]] == ["member check"]
