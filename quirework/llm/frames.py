"""Running the numpy kernels over DataFrames, whole texts and all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import spans


def map_texts(
    docs: DataFrame,
    kernel: Callable[[np.ndarray, np.ndarray], dict[str, pa.Array]],
    schema: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: bool = False,
) -> DataFrame:
    """``kernel(bytes, offsets)`` over each Arrow batch; its columns beside the id.

    With ``keep`` the whole input row comes back too, as one struct column ``row``, so that
    no name of the input can clash with a result. One map stage, no shuffle.
    """
    row_type = docs.schema
    names = [f.name for f in row_type]
    if keep:
        source = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"))
        head = [T.StructField("row", T.StructType(row_type.fields))]
        at = names.index(text_col)
    else:
        source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        head = [T.StructField("doc_id", row_type[id_col].dataType)]
    tail = T.StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first = batch.column(0)
            found = kernel(*spans(first.flatten()[at] if keep else batch.column(1)))
            yield pa.RecordBatch.from_arrays([first, *found.values()], [head[0].name, *found])

    return source.mapInArrow(run, T.StructType(head + tail.fields))


def strings(values: list[str]) -> pa.Array:
    return pa.array(values, pa.string())
