"""Pages as they arrive: the page-level analytics over a stream of files, and job events.

Page analytics need one page only, so they are stateless; what needs a whole document waits for
it: a document is one file, and one micro-batch reads whole files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

STAGES = ("analysis", "epub", "validation", "azw3", "complete")


def page_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def run_batches(stream: DataFrame, transform: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """``transform`` over every micro-batch, each written to a folder of its own number, so that a batch that runs again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        transform(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def job_progress(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The furthest stage of each job in windows of an hour: (window, job_id, stage_rank, n_events). ``events``: ts, job_id, stage."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STAGES]), F.col("stage"))
    return events.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "job_id").agg(F.max(rank).alias("stage_rank"), F.count(F.lit(1)).alias("n_events"))
