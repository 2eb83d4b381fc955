"""The pipeline's stages one by one against plain computations, and its end."""

import re

import corpus_pipeline
from tests.llm.test_operators import brute_components, check_packing


def test_stages(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(10**9, "123 ... 456", None, None, None), (10**9 + 1, None, "en", None, 0)], "doc_id long, text string, lang string, source string, n_chars long"))
    columns, before, seen = docs.columns, {r.doc_id: r.text or "" for r in docs.collect()}, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    assert seen["language"] == {i: t for i, t in before.items() if re.search(r"[^\W\d_]", t)}
    least = {}
    for i, t in sorted(seen["language"].items()):
        least.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    assert set(seen["exact_dedup"]) == set(least.values())
    groups = brute_components(seen["exact_dedup"], 5, 80)
    assert set(seen["near_dedup"]) == {i for i, (_, c) in groups.items() if i == c}
    assert set(seen["personal_data"]) == set(seen["near_dedup"])
    assert any("[EMAIL]" in t for t in seen["personal_data"].values()) and not any(re.search(r"@mail\d\.example\.com", t) for t in seen["personal_data"].values())
    check_packing(docs.collect(), seen["personal_data"].items(), 2048)
