import hashlib
import random
import re
from pathlib import Path

import duckdb
import numpy as np
from pyspark.sql import functions as F

from orbitquery.llm import decontam, langid, licenses, pii, queries

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = int(c) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def passes(kind, hit):
    digits = re.sub("[^0-9]", "", hit)
    if kind == "ip":
        return all(int(x) <= 255 for x in hit.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    return {k: [f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if passes(k, m.group())] for k, p in BASE.items()}


def odd_texts():
    rng = random.Random(3)
    parts = ["a", "b.", "@", "é", "🙂", "1", "23", "4111 1111 1111 1111", "192.168.0.1", "+1 (234) 567-8901", " ", "-", ".", "_", "\n", "x@y.co", "0", "999", ":", "+", "DE89 3704 0044 0532 0130 00", "iban "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(800)]


def test_pii_equals_the_plain_rules(spark, sf_dir, awkward, nothing):
    odd = spark.createDataFrame(list(enumerate(odd_texts(), 10**6)) + [(1, "1 " * 20_000), (2, "a@b" + ".c" * 20_000), (3, "+1" + " 2" * 20_000), (4, "1.2.3.4 " * 300)], "doc_id long, text string")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    for df in (docs, odd, awkward.where("doc_id <> 6").select("doc_id", "text")):
        texts = {r["doc_id"]: r["text"] for r in df.collect()}
        for r in pii.personal_digest(df).collect():
            want = base_spans(texts[r["doc_id"]])
            joined = ",".join(s for k in BASE for s in want[k])
            assert [r[f"n_{k}"] for k in BASE] == [len(want[k]) for k in BASE], texts[r["doc_id"]]
            assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
            assert r["spans"].startswith(joined)
    assert pii.personal_digest(nothing).count() == 0


def test_checksums_and_context_decide_added_kinds(spark):
    rows = [(1, "my iban DE89 3704 0044 0532 0130 00 ok"), (2, "iban DE88 3704 0044 0532 0130 00"), (3, "GB82WEST12345698765432"), (4, "ssn 123-45-6789"), (5, "item 123-45-6789"), (6, "ssn 000-45-6789"), (7, "example sample: GB82WEST12345698765432")]
    got = {r["doc_id"]: (r["n_iban"], r["n_ssn"]) for r in pii.personal_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (1, 0), 2: (0, 0), 3: (1, 0), 4: (0, 1), 5: (0, 0), 6: (0, 0), 7: (0, 0)}


def test_masking_replaces_the_union_of_spans(spark, awkward, nothing):
    docs = spark.createDataFrame([*enumerate(odd_texts()), (10**6, None), (10**6 + 1, "call +1 23.4.5.6 7890 now")], "doc_id long, text string").withColumn("spans", F.lit("kept"))
    found = {r["doc_id"]: r["spans"] for r in pii.personal_digest(docs).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.mask_personal(docs).collect():
        text, merged = texts[r["doc_id"]], []
        for a, b, k in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in found[r["doc_id"]].split(",") if s)):
            if merged and a < merged[-1][1]:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b, k])
        want, at = "", 0
        for a, b, k in merged:
            want, at = want + text[at:a] + f"[{k.upper()}]", b
        assert r["text"] == (None if text is None else want + text[at:]) and r["spans"] == "kept"
    assert pii.mask_personal(awkward).columns == awkward.columns and pii.mask_personal(awkward).count() == 13
    assert pii.mask_personal(nothing).count() == 0


def test_licenses_by_digest(spark, awkward, nothing):
    mit = licenses.KNOWN[0][1]
    rows = [(1, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace("SUBLICENSE", "SUB-LICENCE")), (2, mit + " more"), (3, "Text.\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0"), (4, None), (5, "")]
    got = {r["doc_id"]: (r["license_id"], r["notices"]) for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", ""), 2: (None, ""), 3: (None, "CC-BY-NC-4.0,MIT"), 4: (None, ""), 5: (None, "")}
    assert licenses.scan_licenses(awkward).count() == 13 and licenses.scan_licenses(nothing).count() == 0
    more = spark.createDataFrame([("house", "house RULES, be kind"), ("none", ""), ("mine", mit), ("null", None)], "license_id string, text string")
    docs = spark.createDataFrame([(1, "House rules: be kind."), (2, mit), (3, ""), (4, "House rules")], "doc_id long, text string")
    assert {r["doc_id"]: r["license_id"] for r in licenses.scan_licenses(docs, more).collect()} == {1: "house", 2: "MIT", 3: None, 4: None}


def altered(text, rng):
    """Another holder, case, punctuation, line breaks and spelling."""
    parts = text.replace(" license", " licence").replace("Copyright holder", "Copyright owner").split()
    joined = "".join(w + rng.choice([" ", "\n", "  ", " - "]) for w in parts)
    return f"Copyright (c) {rng.randint(1990, 2024)} Some One\n\n" + rng.choice([str.upper, str.lower, str])(joined)


def test_whole_licences_against_sql(spark, tmp_path, same):
    """Texts that are a licence, altered as the canonical form allows or beyond it, through the query and its SQL."""
    rng = random.Random(8)
    files = {"Apache-2.0": "Apache-2.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    found = [(name, text) for name, text in licenses.KNOWN] + [(n, Path(f"/usr/share/common-licenses/{f}").read_text()) for f, n in files.items() if Path(f"/usr/share/common-licenses/{f}").exists()]
    texts = [text if k % 3 == 0 or not text[:1].isupper() else altered(text, rng) if len(text) < 5000 else text.replace("License", "Licence").upper() for k, (_, text) in enumerate(found)]
    texts += [t + " and more" for t in texts[:3]] + ["counterlicence", "The policencer's licence.", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = queries.op10_licenses(spark, str(tmp_path))
    named = {r["doc_id"]: r["license_id"] for r in got.collect()}
    assert sum(named[k] == name for k, (name, _) in enumerate(found)) == len(found) and all(named[k] is None for k in range(len(found), len(texts)))
    same(got, con.sql(licenses.oracle_sql()))
    assert "counterlicence" == licenses.canonical_text("Counterlicence") and licenses.canonical_text("licence licence") == "license license"


def test_masking_minds_no_names(spark):
    docs = spark.createDataFrame([(1, "mail a@b.co", "x", "y", 3)], "doc_id long, text string, _pii_text string, __pii_spans string, _pii_at_email int")
    assert [tuple(r) for r in pii.mask_personal(docs).collect()] == [(1, "mail [EMAIL]", "x", "y", 3)]


def test_shards_find_what_one_index_finds(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("documents", "benchmark"))
    whole = sorted((r["doc_id"], r["item_id"], r["n_found"]) for r in decontam.contaminated(docs, items).collect())
    monkeypatch.setattr(decontam, "SHARD_BYTES", 4000)
    assert whole == sorted((r["doc_id"], r["item_id"], r["n_found"]) for r in decontam.contaminated(docs, items).collect()) and whole


def plain_bits(runs, size, symbols):
    """Prediction by partial matching, one symbol at a time."""
    counts = [{} for _ in range(langid.ORDER + 1)]
    for run in runs:
        for k in range(langid.ORDER, len(run)):
            for n in range(langid.ORDER + 1):
                counts[n].setdefault(tuple(run[k - n:k]), {}).setdefault(run[k], 0)
                counts[n][tuple(run[k - n:k])][run[k]] += 1
    bits = 0.0
    for k in range(langid.ORDER, len(symbols)):
        p = 1.0
        for n in range(langid.ORDER, -1, -1):
            seen = counts[n].get(tuple(symbols[k - n:k]))
            if not seen:
                continue
            total = sum(seen.values()) + len(seen)
            if symbols[k] in seen:
                p *= seen[symbols[k]] / total
                break
            p *= len(seen) / total
        else:
            p /= size
        bits -= np.log2(p)
    return bits


def test_code_lengths_are_exact(spark):
    """Against a plain model over all 256 bytes, with scripts of several bytes a letter."""
    lines = [("the cat sat on the mat", "en"), ("der Hund und die Katze", "de"), ("The dog and the hat", "en"), ("Das ist ein Häuschen", "de"), ("собака и кошка в доме", "ru"), ("ο σκύλος και η γάτα", "el"), ("猫坐在垫子上", "zh"), ("кошка на окне", "ru")]
    docs = spark.createDataFrame([(k, t, lang) for k, (t, lang) in enumerate(lines * 3)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    sample = [r for r in docs.where(~langid.held_out()).collect()]
    texts = ["the hound sat", "eine Katze!", "zzz", "the cat " * 9, "кошка и собака", "η γάτα", "垫子 and 猫", "\x00\x7f"]
    got = model.code_lengths(texts)
    assert model.languages == ["de", "el", "en", "ru", "zh"]
    for k, lang in enumerate(model.languages):
        runs = [list(b"   " + r["text"].encode()) for r in sample if r["lang"] == lang]
        for t, row in zip(texts, got, strict=True):
            assert np.isclose(row[k], plain_bits(runs, 256, list(b"   " + t.encode())), rtol=1e-4)


def test_three_hundred_languages(spark):
    """More languages make more blocks, none is left out and none becomes coarser."""
    rng = random.Random(12)
    words = [["".join(chr(rng.randint(0x400, 0x45F) if k % 2 else rng.randint(97, 122)) for _ in range(5)) for _ in range(12)] for k in range(300)]
    rows = [(1000 * k + j, " ".join(rng.choice(words[k]) for _ in range(30)), f"l{k:03d}") for k in range(300) for j in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert len(model.languages) == 300
    named, _ = langid.choose(model, [" ".join(rng.choice(words[k]) for _ in range(30)) for k in range(300)])
    assert named == [f"l{k:03d}" for k in range(300)]
    runs = [list(b"   " + r["text"].encode()) for r in docs.where(~langid.held_out()).where("lang = 'l201'").collect()]
    text = " ".join(words[201][:3] + words[7][:2])
    assert np.isclose(model.code_lengths([text])[0][201], plain_bits(runs, 256, list(b"   " + text.encode())), rtol=1e-4)


def test_keys_are_found():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 2**32, 5000).astype(np.uint32))
    table = langid.Keys(keys[::2])
    assert (table.find(keys[::2]) == np.arange(len(keys[::2]))).all() and (table.find(keys[1::2]) == -1).all()
    assert (langid.Keys(keys[:0]).find(keys[:3]) == -1).all()


def test_long_texts_are_scored_whole(spark, sf_dir):
    model = langid.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    a, b = "the and with " * 60_000, "pour les que " * 60_000
    whole = model.code_lengths([a + b])[0]
    assert np.allclose(whole, model.code_lengths([a])[0] + model.code_lengths([b])[0], rtol=1e-4)


def test_language_of_held_out_documents(spark, sf_dir, awkward, nothing):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = langid.language_of(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 20 and sum(r["lang_pred"] == r["lang"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    odd = {r["doc_id"]: r["lang_pred"] for r in langid.language_of(awkward).collect()}
    assert odd[2] == odd[3] == odd[4] == odd[8] == "und" and odd[5] in {"en", "de", "fr"}
    assert langid.language_of(nothing).count() == 0
    kept = langid.identify(awkward, langid.train(docs), names=("l", "p"))
    assert kept.columns == [*awkward.columns, "l", "p"] and kept.count() == 13


def test_decontamination_edges(spark, awkward, nothing):
    item = " ".join(f"term{k}" for k in range(150)) + ". The answer is forty two then."
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, "tiny one"), (5, "Hello there, mail me at bob@example.com or +1 (234) 567-8901.")], "item_id long, text string")
    filler = " ".join(f"noise{k}" for k in range(900))
    words = item.split()
    docs = spark.createDataFrame([(1, filler + " " + item + " " + filler), (2, filler), (3, " ".join(words[:75])), (4, "Tiny, ONE!"), (5, None), (6, ""), (None, item)], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in decontam.contaminated(docs, items).collect())
    assert got == [("1", 1), ("4", 4), ("None", 1)]
    assert sorted(r["doc_id"] for r in decontam.contaminated(awkward, items).collect()) == [1, 7, 11, 11]
    assert decontam.contaminated(nothing, items).count() == 0 and decontam.contaminated(docs, items.limit(0)).count() == 0


def test_decontamination_in_shards(spark, sf_dir, monkeypatch):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam, "SHARD_BYTES", 3000)
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == one


def test_block_max_retrieval_is_exhaustive(spark, sf_dir):
    """Whatever the bounds skip, every segment at or above the threshold is found."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    impacts = decontam.index_table(items)
    rows = [(r["item_id"], r["seg"], bytes(r["term"]), r["impact"]) for r in impacts.collect()]
    index = decontam.Index([(r["item_id"], r["text"]) for r in items.collect()], rows)
    weight = {}
    for i, s, t, w in rows:
        weight.setdefault((i, s), {})[t] = w
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60").collect():
        parts = decontam.words(r["text"])
        ids = np.array([index.term.get(w, -1) for w in parts], dtype=np.int64)
        for threshold in (0.15, 0.5):
            want = {}
            for at in range(0, max(1, len(parts) - decontam.PASSAGE // 2), decontam.PASSAGE // 2):
                window = set(parts[at:at + decontam.PASSAGE])
                for (i, _), terms in weight.items():
                    score = sum(w for t, w in terms.items() if t in window)
                    if score >= threshold:
                        want[i] = max(want.get(i, 0), score)
            got = {index.items[k].item_id: s for k, s in index.retrieve(ids, threshold).items()}
            assert got.keys() == want.keys() and all(np.isclose(got[k], want[k]) for k in want)
