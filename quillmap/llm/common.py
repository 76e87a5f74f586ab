"""What the operators share: reading texts in slices, making batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import cut, shared_folder, ship  # noqa: F401

#: ASCII white space: words are maximal runs of anything else.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a worker holds as Python objects at once; a longer text is held alone.
SLICE_BYTES = 1 << 18


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that count, so no other column can clash. Ids are whole numbers or texts
    of such; another id ends the job with a cast error."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_slices(
    batch: pa.RecordBatch, column: int = 1, most: int = SLICE_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """(rows, their texts as bytes; null: empty) for slices of about `most` bytes of a batch."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64) + 1)
    start = 0
    while start < batch.num_rows:
        before = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, "right")))
        part = batch.slice(start, stop - start)
        yield part, [x or b"" for x in part.column(column).cast(pa.binary()).to_pylist()]
        start = stop


def to_batch(leading: list[pa.Array], rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Leading columns as they are, the others from rows of values."""
    fields = list(schema)[len(leading) :]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([*leading, *(pa.array(c, f.type) for c, f in zip(columns, fields))], schema=schema)


def by_document(fn: Callable[[bytes], tuple], schema: pa.Schema) -> Callable:
    """A mapInArrow function for `id_and_text` rows: fn takes the UTF-8 bytes of one whole text
    (null: empty) and returns the columns after doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in text_slices(batch):
                yield to_batch([part.column(0)], [fn(text) for text in texts], schema)

    return run
