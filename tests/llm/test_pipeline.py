"""The stages one after the other, each on what the one before it kept."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import functions as F

from quirework.llm import decontaminate, jaccard
from quirework.session import stored, table


def test_stages_keep_columns_and_take_effect(spark, sf):
    docs = table(spark, sf, "documents")
    n = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stored(stage(spark, docs, sf))
        assert out.columns == docs.columns, name
        assert 0 < out.count() <= docs.count()
        docs = out
    assert docs.count() >= 0.6 * n
    assert jaccard.jaccard_components(docs, size=5, percent=80).count() == 0
    assert decontaminate.report(decontaminate.decontaminate(docs, table(spark, sf, "benchmark"))).where("contaminated").count() == 0
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert mixed.count() == docs.count() and mixed.where(F.col("taken") > 2 * F.col("size")).count() == 0


def test_names_and_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "jaccard_join", "decontamination", "mixing"]
