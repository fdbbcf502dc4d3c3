"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string")) % folds, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, *, held_out: Column, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of at most ``limit`` labelled documents that are not held out.

    The ids with the smallest hashes are taken, so the sample does not depend on partitions.
    A document labelled twice counts once, with the larger label; null ids, labels and texts
    give no row. Only the ids, at most ``limit``, are broadcast.
    """
    ids = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
        .dropna()
        .where(~held_out)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).dropna()
    return texts.join(F.broadcast(ids), "doc_id").select("doc_id", "label", "text")
