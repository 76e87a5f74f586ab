"""Best-fit packing planned over a histogram of lengths.

Documents become token ids with an end id; only those longer than a sequence are cut. The histogram
of piece lengths (at most `capacity` entries, whatever the corpus) is packed by best-fit decreasing
over counts: for each length from the longest down, bins that have the smallest sufficient room are
filled, whole groups of equal bins at once. The plan is a list of (length, first rank) intervals,
bounded by the capacity alone, in which a piece finds its sequence and offset by its rank within
its length. Ranks come from counts over salted parts of each length, so a length that holds a third
of all pieces is not sorted by one task.

Defined results: a null text counts as empty and packs as the end id alone; repeated rows are
packed as often as they come; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import TextEncoder
from .common import cut, id_and_text, ship, text_slices, to_batch

CAPACITY, END_ID = 4096, 1
PART_ROWS = 50_000
ENCODED_BYTES = 2 << 20  #: of texts whose words are encoded together, each distinct one once


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_encoders: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    if path not in _encoders:
        _encoders[path] = TextEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian 32 bits, if asked for)."""
    ship(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    end = int(end_id).to_bytes(4, "little")
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        encode = encoder(path)
        for batch in batches:
            for part, texts in text_slices(batch, 1, ENCODED_BYTES):
                rows = []
                for doc_id, ids in zip(part.column(0).to_pylist(), encode.many(texts)):
                    ids += end
                    for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                        piece = ids[at : at + 4 * capacity]
                        row = (doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece))
                        rows.append((*row, piece) if with_ids else row)
                yield to_batch([], rows, schema)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids)


@dataclass
class _Bins:
    """`count` equal bins: room that is left, and (length, how many) in the order they were placed."""

    count: int
    room: int
    items: list[tuple[int, int]]


def best_fit(counts: dict[int, int], capacity: int) -> list[_Bins]:
    """Best-fit decreasing over counts."""
    rooms: list[int] = []  # sorted, distinct
    by_room: dict[int, list[_Bins]] = {}

    def put(bins: _Bins) -> None:
        if bins.room not in by_room:
            insort(rooms, bins.room)
            by_room[bins.room] = []
        by_room[bins.room].append(bins)

    def split(bins: _Bins, length: int, n: int) -> int:
        """Place up to n pieces in the bins, as many as fit in one before the next; returns those left."""
        each = bins.room // length
        full = min(bins.count, n // each)
        rest = n - full * each if full < bins.count else 0
        if full:
            put(_Bins(full, bins.room - each * length, [*bins.items, (length, each)]))
        if rest:
            put(_Bins(1, bins.room - rest * length, [*bins.items, (length, rest)]))
        if over := bins.count - full - bool(rest):
            put(_Bins(over, bins.room, bins.items))
        return n - full * each - rest

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                n = split(_Bins(-(-n // each), capacity, []), length, n)
                continue
            room = rooms[at]
            bins = by_room[room].pop()
            if not by_room[room]:
                del by_room[room], rooms[at]
            n = split(bins, length, n)
    return [b for group in by_room.values() for b in group]


@dataclass
class Plan:
    """Intervals of ranks, sorted by (length, first rank), with where their pieces go."""

    key: np.ndarray  #: length << 40 | first rank
    each: np.ndarray  #: pieces of this length to a bin
    sequence: np.ndarray  #: number of the interval's first bin
    offset: np.ndarray  #: place of the first of these pieces in its bin
    sequences: int

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length << 40) + rank, "right") - 1
        step = rank - (self.key[k] & (1 << 40) - 1)
        return self.sequence[k] + step // self.each[k], self.offset[k] + step % self.each[k] * length


def make_plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    rows, base, used = [], 0, dict.fromkeys(counts, 0)
    for bins in best_fit(counts, capacity):
        offset = 0
        for length, each in bins.items:
            rows.append(((length << 40) + used[length], each, base, offset))
            used[length] += each * bins.count
            offset += each * length
        base += bins.count
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return Plan(*(np.ascontiguousarray(table[:, k]) for k in range(4)), base)


def ranked(parts: DataFrame) -> DataFrame:
    """Add rank (from 0 within the length), by counts over salted parts of each length."""
    salts = max(1, math.ceil(parts.count() / PART_ROWS))
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    ahead = W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    counts = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    first = counts.select("length", "salt", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("first"))
    within = W.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    return salted.join(first, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(within) - 1).drop("salt", "first")


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces with sequence_id and offset."""
    parts = cut(pieces(docs, tokenizer, capacity, end_id, with_ids, id_col, text_col))
    plan = make_plan({r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}, capacity)
    wanted = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    slots = ranked(parts).select(*wanted, "rank")

    def run(batches):
        for batch in batches:
            sequence, offset = plan.place(batch.column("length").to_numpy(zero_copy_only=False), batch.column("rank").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence), pa.array(offset)], names=[*wanted, "sequence_id", "offset"])

    ddl = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", sequence_id long, offset long"
    return slots.mapInArrow(run, ddl)
