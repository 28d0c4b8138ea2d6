"""The pipeline over a small table, stage by stage against plain code."""

import re

import corpus_pipeline as P


def shingled(t):
    w = t.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def test_stages(spark, tmp_path):
    sf_dir = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    items = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        before, after = {r.doc_id: r for r in docs.collect()}, {r.doc_id: r for r in out.collect()}
        if k < 4:
            assert out.columns == docs.columns
        if name == "toxicity":
            gone = set(before) - set(after)
            toxic = {i for i in before if labels.get(i) == 1}
            assert len(toxic & gone) >= 0.6 * len(toxic) and len([i for i in gone if labels.get(i) == 0]) <= 2  # few labels here; test_toxicity has more
        elif name == "simhash_near_dedup":
            sets = {i: shingled(r.text) for i, r in before.items()}
            near = lambda a, b: len(sets[a] & sets[b]) >= 0.75 * len(sets[a] | sets[b])
            assert all(any(b < i and near(i, b) for b in before) for i in set(before) - set(after))
            texts = [r.text for r in after.values()]
            assert len(texts) == len(set(texts))
        elif name == "substring_dedup":
            assert before.keys() == after.keys() and all(r.n_chars == len(r.text) for r in after.values())
        elif name == "benchmark_decontamination":
            norm = {i: " ".join(re.findall(r"[^\W_]+", r.text.lower())) for i, r in before.items()}
            assert set(before) - set(after) == {i for i, t in norm.items() if any(f" {x} " in f" {t} " for x in items)}
        else:
            assert before.keys() == after.keys() and all(r.round_trip and len(r.ids) == r.n_tokens for r in after.values())
        docs = out
    assert sorted(r.doc_id for r in P.run(spark, sf_dir).select("doc_id").collect()) == sorted(after)
