"""Text columns of Arrow batches as byte arrays, in pieces of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Texts are long, so 2,000 rows go to a Python worker at once rather than Spark's default of
    10,000. A session's own setting stays."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "2000")


#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE = 1 << 19


def pieces(batch: pa.RecordBatch, column: int | str, limit: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, the rows' bytes, their offsets in them). A null text has no bytes."""
    text = batch.column(column)
    n = len(text)
    if n == 0:
        return
    if text.null_count:
        text = text.fill_null("")
    text = text.cast(pa.large_utf8())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[text.offset : text.offset + n + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, side="right")) - 1)
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi
