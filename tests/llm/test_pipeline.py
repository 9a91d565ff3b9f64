"""The pipeline's stages on the smallest tables, each judged on its own input."""

from pathlib import Path

import pytest

import corpus_pipeline
from adweave.llm import language_id, registry, secrets
from adweave.llm.common import materialise, table
from tests.llm.test_operators import join_brute

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).is_dir(), reason="the given tables aren't here")


def test_stages(spark):
    docs = table(spark, DATA, "documents")
    columns, names = docs.columns, [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "secrets", "mixing", "packing"]
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    scanner = secrets.compile_rules()
    for name, stage in corpus_pipeline.STAGES:
        out = materialise(stage(spark, docs, DATA), f"test-{name}")
        rows = out.collect()
        if name != "packing":
            assert out.columns == columns and rows
        if name == "language":
            model = language_id.fit_language_model(table(spark, DATA, "documents").where(~language_id.held_out(language_id.F.col("doc_id"))))
            encoder = language_id.Encoder(model)
            want = {k for k, t in before.items() for lang, score, margin in [encoder.classify(t)] if lang != "und" and margin > 0 and score >= 0.004}
            assert {r["doc_id"] for r in rows} == want and len(want) > 0.9 * len(before)
        if name == "near_duplicates":
            least = {c for _, _, c in join_brute(sorted((k, t) for k, t in before.items()))}
            assert {str(r["doc_id"]) for r in rows} == least and len(rows) == len(least)
        if name == "secrets":
            assert {r["doc_id"] for r in rows} == set(before)
            assert all(r["text"] == secrets._redacted(before[r["doc_id"]], secrets.scan(before[r["doc_id"]], scanner)) and r["n_chars"] == len(r["text"]) for r in rows)
        if name == "mixing":
            assert {r["doc_id"] for r in rows} <= set(before) and all(before[r["doc_id"]] == r["text"] for r in rows)
        if name == "packing":
            assert {r["doc_id"] for r in rows} == set(before)
        docs, before = out, {r["doc_id"]: r["text"] for r in rows} if name != "packing" else before


def test_every_query_is_registered():
    assert [n.split("_")[0] for n in registry.queries()] == [*(f"op{i}" for i in range(1, 11)), "pipeline"]
