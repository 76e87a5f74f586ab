"""Python functions of rows, over slices of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

SLICE = 256  #: rows that are Python objects at once; a batch of long texts has ten thousand


def in_slices(kind: DataType, arrow: pa.DataType, fn: Callable[..., list]):
    """A function of Columns from one of lists, each with the values of up to SLICE rows of a column.
    What a task holds is a batch as Arrow has it, and a slice of it as Python objects."""

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            columns = (columns,) if isinstance(columns, pa.Array) else columns  # of one column, the array itself
            for at in range(0, len(columns[0]), SLICE):
                yield pa.array(fn(*[c.slice(at, SLICE).to_pylist() for c in columns]), arrow)

    return F.arrow_udf(run, kind)
