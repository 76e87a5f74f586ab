"""Products of vectors block by block, in numpy: what needs every pair needs it once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.steps import ship

BLOCK = 256
GROUPS = 16  #: groups of blocks where all pairs are made: each block is sent to as many tasks
QUERY_GROUPS, CORPUS_GROUPS = 32, 4  #: groups of two sides that meet
HELD = 64 << 20  #: bytes of vectors of a group that a task holds


def packed(rows: DataFrame, columns: list[str], vector: str, keys: list[str], size: int = BLOCK) -> DataFrame:
    """keys, b, nb, an array for each column, flat: about `size` rows to a block; `flat` has their
    vectors one behind the other. Blocks of a key are numbered from 0 to nb - 1."""
    counts = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    nb = F.ceil(F.col("_n") / size).cast("int").alias("nb")
    sized = rows.join(counts.select(*keys, nb), keys) if keys else rows.crossJoin(F.broadcast(counts.select(nb)))  # one row
    dealt = sized.withColumn("b", F.pmod(F.xxhash64(*columns), "nb").cast("int"))
    members = F.collect_list(F.struct(*columns, F.col(vector).cast("array<double>").alias(vector))).alias("members")
    blocks = dealt.groupBy(*keys, "b", "nb").agg(members)
    field = lambda name: F.transform("members", lambda x: x[name])
    return blocks.select(*keys, "b", "nb", *[field(c).alias(c) for c in columns], F.flatten(field(vector)).alias("flat"))


def block_pairs(blocks: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Every two blocks of a key once, and every block with itself: keys, i, j (i <= j), and both
    sides' columns with `_a` and `_b`."""
    sides = [*columns, "flat"]
    to = F.explode(F.sequence(F.col("b"), F.col("nb") - 1)).alias("j")
    left = blocks.select(*keys, F.col("b").alias("i"), to, *[F.col(c).alias(f"{c}_a") for c in sides])
    right = blocks.select(*keys, F.col("b").alias("j"), *[F.col(c).alias(f"{c}_b") for c in sides])
    return left.join(right, [*keys, "j"])


def _groups(blocks: DataFrame, most: int, held: int) -> int:
    """How many groups: few for few blocks, and more than `most` only where a group would go beyond `held` bytes."""
    n, numbers = blocks.agg(F.count("*"), F.sum(F.size("flat").cast("long"))).first()
    return max(1, min(most, -(-n // 4)), -(-8 * (numbers or 0) // held) if held else 1)


def meetings(left: DataFrame, right: DataFrame, run: Callable[[Iterator], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """run takes (cell, row, row) of each row of `left` with each of `right`, and gives columns. Blocks
    are put into groups, and a task takes a group of each side: it holds that of the left and streams
    that of the right, so a block is sent to 4 tasks or 32, however many blocks there are. Of a cell,
    each row of the left is one object. Both sides should be cut, and have `b` and `flat`."""
    p, q = _groups(left, QUERY_GROUPS, HELD), _groups(right, CORPUS_GROUPS, 0)
    names = [[c for c in side.columns if c not in ("b", "nb")] for side in (left, right)]
    first = left.select(F.lit(0).alias("_side"), F.pmod("b", F.lit(p)).alias("_i"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("_j"), "b", F.struct(*names[0]).alias("_left"))
    second = right.select(F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0), F.lit(p - 1))).alias("_i"), F.pmod("b", F.lit(q)).alias("_j"), "b", F.struct(*names[1]).alias("_right"))
    return _over_cells(first.unionByName(second, allowMissingColumns=True), p * q, names, False, run, schema, ddl)


def all_pairs(blocks: DataFrame, run: Callable[[Iterator], Iterator[dict]], schema: pa.Schema, ddl: str) -> DataFrame:
    """As `meetings` for every two blocks once, and every block with itself: then both rows are the same
    object, read once, so its pairs don't depend on the order in which two readers would see it."""
    p = _groups(blocks, GROUPS, HELD)
    names = [c for c in blocks.columns if c not in ("b", "nb")]
    own = F.pmod("b", F.lit(p))
    first = blocks.select(F.lit(0).alias("_side"), own.alias("_i"), F.explode(F.sequence(own, F.lit(p - 1))).alias("_j"), "b", F.struct(*names).alias("_left"))
    second = blocks.where(own > 0).select(F.lit(1).alias("_side"), F.explode(F.sequence(F.lit(0), own - 1)).alias("_i"), own.alias("_j"), "b", F.struct(*names).alias("_right"))
    return _over_cells(first.unionByName(second, allowMissingColumns=True), p * (p + 1) // 2, [names, names], True, run, schema, ddl)


def _over_cells(sides: DataFrame, cells: int, names: list[list[str]], one: bool, run: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    ship(sides.sparkSession)
    dealt = sides.repartition(max(2, cells), "_i", "_j").sortWithinPartitions("_i", "_j", "_side", "b")

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held, cell = [], None
        for batch in batches:
            side, i, j = (batch.column(c).to_numpy() for c in ("_side", "_i", "_j"))
            structs = [batch.column(c) for c in ("_left", "_right")]
            columns = [{c: x.field(c) for c in own} for x, own in zip(structs, names)]
            for k in range(batch.num_rows):
                if (i[k], j[k]) != cell:
                    held, cell = [], (i[k], j[k])
                row = {c: np.array(_value(x, k)) for c, x in columns[side[k]].items()}
                for other in held if side[k] or (one and i[k] == j[k]) else ():
                    yield cell, other, row
                if not side[k]:
                    if one and i[k] == j[k]:
                        yield cell, row, row
                    held.append(row)

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(met(rows)):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return dealt.mapInArrow(batches, ddl)


def _value(column, k: int):
    x = column[k]
    return x.values.to_numpy(zero_copy_only=False) if isinstance(x, pa.ListScalar) else x.as_py()


def over_rows(pairs: DataFrame, fn: Callable[[dict], dict[str, np.ndarray]], schema: pa.Schema, ddl: str) -> DataFrame:
    """fn takes a row, its arrays as numpy arrays, and gives columns; one result batch for each row."""
    ship(pairs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                out = fn({name: _value(column, k) for name, column in zip(batch.schema.names, batch.columns)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return pairs.mapInArrow(run, ddl)


def matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return flat.reshape(rows, -1)


def arrow_type(kind: str) -> pa.DataType:
    """Of the simple types that articles are named by."""
    return {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "smallint": pa.int16()}[kind]
