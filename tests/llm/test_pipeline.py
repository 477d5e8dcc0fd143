import re

import corpus_pipeline
from orbitquery.llm import decontam, simhash


def test_stages_in_order(spark, sf_dir):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "pii", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, texts, kept = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.Table(stage(spark, docs, sf_dir), name).df
        assert docs.columns == columns
        kept.append({r["doc_id"]: r for r in docs.collect()})
    recognised, single, clean, masked = kept
    assert len(recognised) >= 0.98 * len(texts)
    # No pair left is similar, and whatever went has a similar document that stayed or went before it.
    sets = {d: set(simhash.shingle_hashes(texts[d], 5).tolist()) for d in recognised}
    near = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert not any(a in single and b in single for a, b in near)
    assert all(any(d in p for p in near) for d in set(recognised) - set(single))
    items = [set(decontam.shingles(decontam.words(r["text"]))) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    runs = {d: set(decontam.shingles(decontam.words(texts[d]))) for d in single}
    assert set(clean) == {d for d in single if not any(len(i & runs[d]) >= 0.8 * len(i) for i in items)}
    assert set(masked) == set(clean) and all(len(r["text"]) == r["n_chars"] for r in masked.values())
    assert not any(re.search(r"[\w.]+@[\w-]+\.[a-z]+", r["text"]) for r in masked.values())
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r["doc_id"] for r in last} == set(masked)


def test_run_and_edges(spark, sf_dir, awkward, nothing):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    for docs in (awkward, nothing):
        for _, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.Table(stage(spark, docs, sf_dir), "t").df


def test_contaminated_rows_without_an_id_go(spark, sf_dir, tmp_path):
    item = " ".join(f"term{k}" for k in range(60)) + ". The answer is forty two then."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(None, "Before it " + item + " and after.", 1), (None, "Clean words here.", 2), (7, item, 3), (7, "Clean too.", 4), (8, "Also clean.", 5), (8, None, 6), (None, None, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _leaked int")
    left = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r["_leaked"] for r in left.collect()) == [2, 5, 6, 7]
