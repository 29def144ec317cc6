"""The pipeline's stages over the smallest tables against brute force."""

import re

import pytest

pytest.importorskip("wavequill.llm")
pytest.importorskip("corpus_pipeline")


def test_stages(spark, small, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    kept = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < 4:
            assert docs.columns == columns
        kept[name] = docs
    before, after = ({r["doc_id"]: r["text"] for r in kept[n].collect()} for n in ("quality", "near_duplicates"))
    assert set(after) <= set(before)
    sets = {}
    for i, t in before.items():
        w = re.findall(r"\w+", t.lower())
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set()
    similar = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])
    for i in set(before) - set(after):
        assert any(similar(i, j) for j in before if j != i)
    left = sorted(after)
    assert not any(similar(a, b) for n, a in enumerate(left) for b in left[n + 1 :])
    mixed = {}
    for r in kept["mixing"].collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + 1
    assert set(mixed) <= set(after) and max(mixed.values()) <= 3
    packed = kept["packing"].collect()
    assert {r["doc_id"] for r in packed} == set(mixed)
    assert all(r["offset"] + r["length"] <= 1024 for r in packed)


def test_run_is_the_stages_in_order(spark, small):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "mixing", "packing"]
    out = corpus_pipeline.run(spark, small)
    assert out.count() > 0 and "sequence_id" in out.columns
