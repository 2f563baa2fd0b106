"""The pipeline's stages, one after the other, against what each must do; and the registered queries."""

from __future__ import annotations

import os
import sys
from collections import Counter

import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import corpus_pipeline  # noqa: E402
from corpora import EDGE_TEXTS, SF, edge_docs  # noqa: E402
from talktrace.llm import pii, simhash  # noqa: E402
from talktrace.llm.common import BATCH_ROWS, BATCH_SETTING, short_batches, stored, stored_at  # noqa: E402
from test_operators import brute_components, brute_fingerprint, brute_spans, check_packing  # noqa: E402

DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize("edge", [False, True])
def test_stages(spark, edge):
    docs = edge_docs(spark, [r for r in EDGE_TEXTS if r[0] != 9]) if edge else spark.read.parquet(f"{SF}/documents.parquet")
    rows = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs.collect(), stored(stage(spark, docs, SF))
        rows[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == DOCUMENTS
    before, after = rows["language"]
    lettered = Counter(r for r in before if any(map(str.isalpha, r.text or "")))
    assert not Counter(after) - lettered
    if not edge:  # the few documents of the other table teach no more than a few n-grams
        assert sum((lettered - Counter(after)).values()) <= 0.01 * len(before)
    before, after = rows["near_copies"]
    components = brute_components([(r.doc_id, brute_fingerprint(r.text)) for r in before])
    assert sorted(map(repr, (r.doc_id for r in after))) == sorted(map(repr, {c for _, _, c in components}))
    assert set(after) <= set(before)
    before, after = rows["personal_data"]
    assert len(before) == len(after)
    texts = {r.doc_id: r.text for r in after}
    for r in before:
        changed = bool(brute_spans(r.text))
        assert not brute_spans(texts[r.doc_id]) and (texts[r.doc_id] != r.text or not changed)
    before, after = rows["mixing"]
    assert set(after) <= set(before) and max(Counter(r.doc_id for r in after).values()) <= 2
    before, after = rows["packing"]
    used, least = check_packing([tuple(r) for r in before], after)
    assert used <= 1.02 * least + 1


def test_run_and_registration(spark, monkeypatch):
    import __spark_entry__

    queries = __spark_entry__.queries()
    names = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in queries) == 1 for n in names) and "pipeline" in queries
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
    paths = []

    def noted(frame):
        result, path = stored_at(frame)
        paths.append(path.removeprefix("file:"))
        return result, path

    monkeypatch.setattr(corpus_pipeline, "stored_at", noted)
    assert Counter(corpus_pipeline.run(spark, SF).collect()) == Counter(docs.collect())
    assert [os.path.isdir(p) for p in paths] == [False, False, False, True]


def test_texts_go_to_python_in_short_batches(spark):
    """Batches of 10,000 texts, the default, made the executors' memory run out."""
    largest = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches)
    rows, before = spark.range(0, 5000, 1, 1), spark.conf.get(BATCH_SETTING)
    with short_batches(spark):
        assert max(r.n for r in rows.mapInArrow(largest, "n long").collect()) == BATCH_ROWS
    assert spark.conf.get(BATCH_SETTING) == before


def test_stages_stand_empty_tables(spark):
    docs = edge_docs(spark).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF))
        assert docs.count() == 0
