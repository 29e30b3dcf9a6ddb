"""Arrow batches of texts inside tasks.

Rows reach Python as Arrow record batches. They are worked on in slices of about SLICE_BYTES of
text, so that memory follows one slice (or one very long text), not the number of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bytes of text that are worked on at a time; a longer single text is a slice of its own.
SLICE_BYTES = 1 << 18


#: Rows of an Arrow batch: with texts of some KB, a batch is a few MB on either side.
BATCH_ROWS = 1_000
BATCH_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def keep_batches_small(spark: SparkSession) -> None:
    """Lower the session's rows per Arrow batch to BATCH_ROWS where they are more or unbounded."""
    rows = int(spark.conf.get(BATCH_SETTING))
    if rows <= 0 or rows > BATCH_ROWS:
        spark.conf.set(BATCH_SETTING, BATCH_ROWS)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and its row borders; NULL rows are empty."""
    column = column.fill_null("").cast(pa.large_string())
    _, borders, data = column.buffers()
    offsets = np.frombuffer(borders, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive pieces of about `size` bytes of the text column."""
    if not batch.num_rows:
        return
    column = batch.column(batch.schema.get_field_index(text))
    lengths = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(lengths.buffers()[1], np.int64)
    offsets = offsets[lengths.offset : lengths.offset + len(lengths) + 1]
    group = (offsets[:-1] - offsets[0]) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
    for start, end in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(start, end - start)


def gathered(batches: Iterator[pa.RecordBatch], text: str, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in order, in pieces of about `size` bytes of the text column."""
    held, length = [], 0
    for batch in batches:
        for piece in slices(batch, text, size):
            held.append(piece)
            length += piece.column(batch.schema.get_field_index(text)).nbytes
            if length >= size:
                yield pa.concat_batches(held)
                held, length = [], 0
    if held:
        yield pa.concat_batches(held)


def map_texts(
    frame: DataFrame,
    schema: str | StructType,
    function: Callable[[pa.RecordBatch], pa.RecordBatch | None],
    text: str = "text",
) -> DataFrame:
    """Apply the function to slices of the frame's rows, inside the tasks that hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, text):
                result = function(piece)
                if result is not None and result.num_rows:
                    yield result

    keep_batches_small(frame.sparkSession)
    return frame.mapInArrow(run, schema)
