"""The pipeline against plain versions of its stages."""

from __future__ import annotations

import nasty
import numpy as np
from test_dedup import brute_force as duplicates
from test_text import brute_force as leaks

import corpus_pipeline as C
from cairn.llm import bag_minhash, decontaminate, language_id, packing, secrets


def test_windows_equal_plain_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    p = language_id.Params()
    m = language_id.fit(docs, p)
    texts = {}
    for r in docs.collect():
        raw = np.frombuffer(r.text.encode(), np.uint8)
        mean, _ = language_id.judge(m, raw, np.array([0, len(raw)]), p) if len(raw) else (np.zeros((1, 1)), None)
        if len(raw) and mean.max() >= p.min_probability:
            texts[r.doc_id] = r.text
    for gone, _ in duplicates(list(texts.items()), bag_minhash.Params()):
        del texts[gone]
    found = leaks(list(texts.items()), items, decontaminate.Params())
    for gone, _ in found:
        texts.pop(gone, None)
    kept = docs.join(spark.createDataFrame([(k,) for k in texts], "doc_id long"), "doc_id")
    masked = {r.doc_id: r.text for r in secrets.redact(kept).collect()}
    ends: dict[int, int] = {}
    rows = sorted(C.run(spark, sf).collect(), key=lambda r: (r.run, r.window))
    for r in rows:
        for s in r.spans:
            assert s.start == ends.get(s.doc_id, 0)
            ends[s.doc_id] = s.end
    assert found and len(masked) < docs.count()
    assert ends == {i: len(t) for i, t in masked.items() if t}


def test_stages_take_odd_rows_and_keep_columns(spark, sf, tmp_path):
    for start in (nasty.documents(spark), nasty.empty(spark)):
        docs = start
        for k, (_, stage) in enumerate(C.STAGES):
            out = stage(spark, docs, sf)
            assert k == len(C.STAGES) - 1 or out.columns == start.columns
            out.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert "spans" in docs.columns


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_near_dedup_sketches_texts_once(spark, sf, monkeypatch):
    plans, write = [], bag_minhash.checkpointed
    monkeypatch.setattr(bag_minhash, "checkpointed", lambda df: plans.append(plan(df)) or write(df))
    bag_minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet"))
    assert [x.count("ArrowEvalPython") for x in plans if "ArrowEvalPython" in x] == [1]


def test_packing_starts_no_workers_of_rdds(spark, sf):
    for docs in (spark.read.parquet(f"{sf}/documents.parquet"), nasty.empty(spark)):
        assert "ExistingRDD" not in plan(packing.packed(docs))
