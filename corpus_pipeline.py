"""From raw documents to a training mix: the stages and how they run one after the other.

Each stage works on all documents that the one before it kept, and judges them as they are then.
Rows without an id pass the near-duplicate stages untouched, as nothing can be said to equal them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirework.llm import decontaminate, jaccard, line_dedup, mixing, toxicity
from quirework.session import stored, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from this stage's input, scores 0.5 or more go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, keep=True).where("score < 0.5").select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and similar lines the first stays; documents left without a line go."""
    return line_dedup.drop_lines(docs, **line_dedup.WHOLE)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of linked documents (five-word shingles, Jaccard similarity 0.8 or more) the one with the smallest id stays."""
    linked = jaccard.jaccard_components(docs, size=5, percent=80)
    later = linked.where("doc_id <> component_id").select(F.col("doc_id").alias("later"))
    return docs.join(later, docs.doc_id == later.later, "left_anti")


def reject_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item (or all of a shorter one) go."""
    found = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return found.where(F.size("hits") == 0).select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_repeated_lines),
    ("jaccard_join", one_of_each_group),
    ("decontamination", reject_contaminated),
    ("mixing", mix_sources),
]

#: Classifier scores, MinHash and keyed permutations aren't in SQL; tests/llm checks what each stage must hold to, not yet the whole run by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
