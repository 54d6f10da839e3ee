import numpy as np

import corpus_pipeline
from kinspark.llm import common, langid, simhash, weakquality
from kinspark.llm.common import stored

from .test_filters import contaminated
from .test_simhash import brute_groups, brute_print
from .test_tokens import ids_of


def test_stages_keep_columns_and_clean_documents(spark, sf_dir):
    docs = start = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        kept[name] = docs
        if name != "window_packing":
            assert docs.columns == start.columns and docs.count() <= before.count()
    assert kept["language_id"].count() >= 0.98 * start.count()
    left = kept["simhash_dedup"]
    assert simhash.near_duplicates(left).select("component_id").distinct().count() == left.count()
    whole = docs.groupBy("doc_id").sum("length").count()
    assert whole == kept["benchmark_decontamination"].count()


def test_each_stage_is_brute_force_on_its_own_input(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)

    def step(name, df):
        out = stored(stages[name](spark, df, sf_dir), name)
        return out, {r.doc_id: r.text for r in df.collect()}, sorted(r.doc_id for r in out.collect()) if "text" in out.columns else None

    after, before, kept = step("language_id", docs)
    lang, score = langid.fit_language_model(docs).predict(list(before.values()))
    assert kept == sorted(i for i, x, s in zip(before, lang, score, strict=True) if x != "und" and s >= 0.25)

    docs, after = after, None
    after, before, kept = step("quality_classifier", docs)
    score = weakquality.fit_quality_model(docs).scores(list(before.values()))
    assert kept == sorted(i for i, s in zip(before, score, strict=True) if s >= 0.5)

    after, before, kept = step("simhash_dedup", after)
    ids = list(before)
    root = brute_groups([brute_print(before[i]) for i in ids])
    assert kept == sorted({min(i for i, g in zip(ids, root, strict=True) if g == mine) for mine in set(root)})

    after, before, kept = step("benchmark_decontamination", after)
    assert kept == sorted(r[0] for r in contaminated(before.items(), bench) if not r[5])

    after, before, _ = step("window_packing", after)
    pieces = {}
    for r in after.collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
    for i, text in before.items():
        got = sorted(pieces.pop(i))
        assert np.array_equal(np.cumsum([0, *(n for _, n in got)]), [*(s for s, _ in got), len(ids_of(tokenizer, text)) + 1])
    assert not pieces


def test_entry_lists_the_core_without_the_tokenizers(monkeypatch):
    import importlib
    import sys

    import __spark_entry__

    monkeypatch.setitem(sys.modules, "public_tokenizers", None)
    monkeypatch.delitem(sys.modules, "corpus_pipeline")
    try:
        assert {"clone_composition", "op1_token_counts", "pipeline"} <= set(importlib.reload(__spark_entry__).queries())
    finally:
        monkeypatch.undo()
        importlib.reload(__spark_entry__)


def test_run_and_empty_input(spark, sf_dir, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda _: str(tmp_path))
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["window_packing"]  # of the steps nothing is left
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    assert docs.count() == 0
