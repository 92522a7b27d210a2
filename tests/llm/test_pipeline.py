"""The pipeline on a small corpus: each stage against brute force."""

import corpus_pipeline as pipeline
from test_operators import _base, _components, _fingerprint


def test_stages(spark, tmp_path):
    texts = ["A clear text about the river and the town.", "A clear text about the river and the town.", "123 456", None, "mail me at joe@example.org please", "other words entirely, said the fox"]
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = rows, {}
    for name, stage in pipeline.STAGES:
        docs = pipeline.table(stage(spark, docs, str(tmp_path)), f"test-{name}")
        seen[name] = docs.toPandas()
        if name != "packing":
            assert docs.columns == rows.columns
    assert sorted(seen["language_id"]["doc_id"]) == [0, 1, 4, 5]
    assert sorted(seen["exact_dedup"]["doc_id"]) == [1, 4, 5]
    kept = seen["exact_dedup"].sort_values("doc_id")
    low = _components([_fingerprint(t) for t in kept["text"]], list(kept["doc_id"]))
    assert sorted(seen["near_dedup"]["doc_id"]) == sorted(set(low))
    assert not any(_base(t) for t in seen["pii"]["text"]) and "mail me at [EMAIL] please" in set(seen["pii"]["text"])
    assert set(seen["packing"]["doc_id"]) == set(seen["pii"]["doc_id"])
    assert pipeline.run(spark, str(tmp_path)).count() == len(seen["packing"])
