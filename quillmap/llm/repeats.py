"""Substring dedup by compaction of a de Bruijn graph over words.

Edges are the k-mers of `window` words, nodes the k-mers one word shorter that they begin and end
with. An edge that occurs twice or more is a repeated window.

1. Texts are put into compressed blocks. Of every window, the leftmost `k` words with the smallest
   hash are its anchor; equal windows have equal anchors. Only windows whose anchor occurs again
   anywhere can be repeated, and only these become edges.
2. Edges meet by hash: each learns whether it is repeated, and whether the word before it and the
   word after it are the same everywhere.
3. A document's repeated edges, in order, are pieces: they go on while the graph doesn't branch and
   no text begins or ends. A piece is an edge of the compacted graph, named by its words.
4. Pieces that meet at a node with one way in and one way out compact into paths, by joins that
   double the reach of pointers to the piece before. So a piece has a path and an offset on it.
5. Source coordinates (block, word) verify the pieces: the words at all places of a piece are
   hashed as a whole with 128 bits, and only pieces found at two places or more are repeated.

A block sends each of its distinct anchors, edges and pieces once, as packed arrays, and gets one
answer for each back by a join on the block. So a passage that is in every document takes one entry
a block, and no group of equal keys meets in one task.

Defined results: a null or empty text has no words; texts of fewer words than a window are never
shortened; repeated rows repeat each other's windows, whatever their ids; an empty table gives an
empty table; other columns are ignored. Hashes stand for word sequences: of 64 bits for anchors and
edges, of 32 bits for neighbouring words, of 128 bits for pieces.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .common import cut, id_and_text, ship, text_slices, to_batch

WINDOW, ANCHOR = 35, 8
BLOCK_BYTES, BUCKET_BYTES, TASK_BYTES = 2 << 20, 16 << 20, 64 << 20
CHECK_BASES = 0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1
REPEATED, ONE_BEFORE, ONE_AFTER = 1, 2, 4


# ---- blocks ---------------------------------------------------------------------------------

_BLOCK = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("n_bytes", pa.int64()), ("blob", pa.binary())])


def blocks_of(docs: DataFrame) -> DataFrame:
    """block, ids, sizes, n_bytes, blob: about 2 MB of whole texts to a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part, texts in text_slices(batch, 1, BLOCK_BYTES):
                joined = b"".join(texts)
                row = (task << 32 | k, part.column(0).to_pylist(), [len(x) for x in texts], len(joined), pack.compress(joined))
                yield to_batch([], [row], _BLOCK)
                k += 1

    return docs.mapInArrow(run, "block long, ids array<long>, sizes array<long>, n_bytes long, blob binary")


def texts_of(row: dict) -> list[bytes]:
    sizes = row["sizes"]
    joined = zstandard.ZstdDecompressor().decompress(row["blob"], max_output_size=max(1, sum(sizes)))
    ends = np.cumsum(sizes).tolist()
    return [joined[e - s : e] for e, s in zip(ends, sizes)]


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows, one at a time."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: column[k].as_py() for name, column in zip(batch.schema.names, batch.columns)}


# ---- anchors and edges of one block -----------------------------------------------------------


@dataclass
class Scan:
    """The words of a block and the anchors of its windows."""

    words: np.ndarray
    bounds: np.ndarray
    windows: np.ndarray  #: first words of the whole windows
    anchors: np.ndarray  #: hashes of the distinct anchors, ascending
    flags: np.ndarray  #: REPEATED: twice or more in this block
    anchor_of: np.ndarray  #: for each window, the number of its anchor


def scan(texts: list[bytes], window: int, k: int) -> Scan:
    words, bounds = K.words_of(texts)
    windows = K.whole_windows(bounds, window)
    if not len(windows):
        none = np.zeros(0, np.int64)
        return Scan(words, bounds, windows, none.astype(np.uint64), none.astype(np.uint8), none)
    grams = K.window_hashes(words, k, K.NODE_BASE)
    best = K.sliding_argmin(grams, window - k + 1)[windows]
    fresh = np.diff(best, prepend=-1) != 0
    anchors, number, counts = np.unique(grams[best[fresh]], return_inverse=True, return_counts=True)
    flags = np.where(counts > 1, REPEATED, 0).astype(np.uint8)
    return Scan(words, bounds, windows, anchors, flags, number[np.cumsum(fresh) - 1])


@dataclass
class Edges:
    """The windows of a block whose anchors are repeated."""

    starts: np.ndarray  #: first word of each window
    entry: np.ndarray  #: for each window, the number of its edge among the block's distinct edges
    keys: np.ndarray  #: hashes of the distinct edges, ascending
    before: np.ndarray  #: of each edge, the word before it at one of its places; 0 at a text's begin
    after: np.ndarray  #: and the word after it
    flags: np.ndarray  #: REPEATED, ONE_BEFORE, ONE_AFTER, as far as this block tells


def _neighbours(s: Scan, at: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """32 bits for the words at `at`, 0 where that is in another text."""
    out = np.zeros(len(at), np.uint32)
    out[inside] = (K.mix(s.words[at[inside]]) >> K.U(32)).astype(np.uint32) | np.uint32(1)
    return out


def edges(s: Scan, repeated: np.ndarray, window: int) -> Edges:
    starts = s.windows[repeated[s.anchor_of]] if len(s.windows) else s.windows
    owner = np.searchsorted(s.bounds, starts, "right") - 1
    before = _neighbours(s, starts - 1, starts > s.bounds[owner])
    after = _neighbours(s, starts + window, starts + window < s.bounds[owner + 1])
    keys, first, entry, counts = np.unique(K.span_hashes(s.words, starts, starts + window, K.WORD_BASE), return_index=True, return_inverse=True, return_counts=True)
    flags = np.where(counts > 1, REPEATED, 0).astype(np.uint8) | np.uint8(ONE_BEFORE | ONE_AFTER)
    flags[entry[before != before[first][entry]]] &= ~np.uint8(ONE_BEFORE)
    flags[entry[after != after[first][entry]]] &= ~np.uint8(ONE_AFTER)
    return Edges(starts, entry, keys, before[first], after[first], flags)


# ---- exchange: what all blocks say about an anchor or an edge ---------------------------------


def _bucket_runs(hashes: np.ndarray, buckets: int) -> list[tuple[int, int, int]]:
    """(bucket, start, end) of ascending hashes."""
    if not len(hashes):
        return []
    number = ((hashes >> K.U(32)) * K.U(buckets)) >> K.U(32)
    starts = np.flatnonzero(np.diff(number, prepend=number[0] + K.U(1)))
    return [(int(number[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(hashes)])]


_SENT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("before", pa.binary()), ("after", pa.binary()), ("flags", pa.binary())])
_SENT_DDL = "bucket int, block long, keys binary, before binary, after binary, flags binary"


def _sent(block: int, buckets: int, keys: np.ndarray, before: np.ndarray, after: np.ndarray, flags: np.ndarray) -> pa.RecordBatch:
    """A block's entries, one row for each bucket that has some."""
    runs = _bucket_runs(keys, buckets)
    rows = [(k, block, *(x[s:e].tobytes() for x in (keys, before, after, flags))) for k, s, e in runs]
    return to_batch([], rows, _SENT)


def _answer(table: pa.Table) -> pa.Table:
    """For one bucket: flags of every entry over all blocks, in the order in which its block sent it."""
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    keys, flags = joined("keys", np.uint64), joined("flags", np.uint8)
    order = np.argsort(keys, kind="stable")
    starts = np.flatnonzero(np.diff(keys[order], prepend=keys[order[0]] + K.U(1)))
    sizes = np.diff(np.append(starts, len(keys)))
    least, most = np.bitwise_and.reduceat(flags[order], starts), np.bitwise_or.reduceat(flags[order], starts)
    answer = np.where((sizes > 1) | (most & REPEATED > 0), REPEATED, 0).astype(np.uint8)
    for name, flag in (("before", ONE_BEFORE), ("after", ONE_AFTER)):
        words = joined(name, np.uint32)
        if len(words):  # anchors have none
            words = words[order]
            one = (np.minimum.reduceat(words, starts) == np.maximum.reduceat(words, starts)) & (least & flag > 0)
            answer |= np.where(one, flag, 0).astype(np.uint8)
    out = np.empty(len(keys), np.uint8)
    out[order] = np.repeat(answer, sizes)
    sent = [len(x) // 8 for x in table.column("keys").to_pylist()]
    raw, ends = out.tobytes(), np.cumsum(sent).tolist()
    told = pa.array([raw[e - n : e] for e, n in zip(ends, sent)], pa.binary())
    return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "flags": told})


def _flags(answers: list[dict] | None) -> np.ndarray:
    """A block's flags from all its buckets, in the order of the hashes."""
    parts = sorted(answers or [], key=lambda a: a["bucket"])
    return np.frombuffer(b"".join(p["flags"] for p in parts), np.uint8)


# ---- pieces and paths -------------------------------------------------------------------------

_PIECE = ("head", "check_a", "check_b", "n", "first", "last", "places")
_FOUND = pa.schema([("block", pa.int64()), ("starts", pa.binary()), ("piece", pa.binary()), *((c, pa.list_(pa.int64())) for c in _PIECE)])
_FOUND_DDL = "block long, starts binary, piece binary, " + ", ".join(f"{c} array<long>" for c in _PIECE)


def pieces_of(s: Scan, e: Edges, flags: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(first word and number of each piece's place, columns of the block's distinct pieces): the
    hash of the first edge, two hashes of all words, the edges, the nodes at both ends, the places."""
    own = flags[e.entry]
    kept = (own & REPEATED) > 0
    starts, own, key = e.starts[kept], own[kept], e.keys[e.entry[kept]]
    owner = np.searchsorted(s.bounds, starts, "right") - 1
    on = (starts[1:] == starts[:-1] + 1) & (owner[1:] == owner[:-1])
    on &= ((own[:-1] & ONE_AFTER) > 0) & ((own[1:] & ONE_BEFORE) > 0)
    begin = np.flatnonzero(np.concatenate([[True], ~on])) if len(starts) else np.zeros(0, np.int64)
    n = np.diff(np.append(begin, len(starts)))
    at, head = starts[begin], key[begin]
    a, b = (K.span_hashes(s.words, at, at + n + window - 1, base) for base in CHECK_BASES)
    first = K.span_hashes(s.words, at, at + window - 1, K.NODE_BASE)
    last = K.span_hashes(s.words, at + n, at + n + window - 1, K.NODE_BASE)
    order = np.lexsort((b, a, head))
    new = np.ones(len(order), bool)
    new[1:] = np.any([x[order][1:] != x[order][:-1] for x in (head, a, b)], axis=0)
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    one = order[new]
    columns = [x[one].view(np.int64) for x in (head, a, b)] + [n[one]] + [x[one].view(np.int64) for x in (first, last)]
    return at, number, [*columns, np.bincount(number, minlength=len(one))]


def _followed(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """From (piece, up, gap), where a piece begins `gap` edges after the piece before it: (piece, up,
    gap) to the first piece of the chain, and the pieces of rings, which have no first. Every round
    doubles how far back a pointer reaches; a round that ends no chain has only rings left."""
    done = links.where("false")
    open_, before = links, -1
    while n := open_.count():
        if n == before:
            break
        before = n
        every = done.select("piece", "up", "gap", F.lit(True).alias("ends")).unionByName(open_.select("piece", "up", "gap", F.lit(False).alias("ends")))
        ahead = every.select(F.col("piece").alias("up"), F.col("up").alias("far"), F.col("gap").alias("more"), "ends")
        step = open_.join(ahead, "up", "left")
        gap = (F.col("gap") + F.coalesce("more", F.lit(0))).alias("gap")
        step = cut(step.select("piece", F.coalesce("far", "up").alias("up"), gap, F.coalesce("ends", F.lit(True)).alias("ends")))
        done = done.unionByName(step.where("ends").drop("ends"))
        open_ = step.where("not ends").drop("ends")
    return done, open_


def compacted(pieces: DataFrame) -> DataFrame:
    """(piece, path, offset): the maximal nonbranching paths of a graph whose edges are pieces
    (piece, first, last, n). A path is named by its first piece; a ring is cut before every piece
    with a smaller number than the one before it."""
    one = F.count("*") == 1
    into = pieces.groupBy(F.col("last").alias("node")).agg(one.alias("one"), F.min("piece").alias("up"), F.min("n").alias("gap"))
    out = pieces.groupBy(F.col("first").alias("node")).agg(one.alias("alone"), F.min("piece").alias("piece"))
    links = cut(into.where("one").join(out.where("alone"), "node").where("piece != up").select("piece", "up", "gap"))
    found, rings = _followed(links)
    cut_open = links.join(rings.select("piece"), "piece", "left_semi").where("piece > up")
    found = found.unionByName(_followed(cut_open)[0])
    ends = found.select("piece", F.col("up").alias("path"), F.col("gap").alias("offset"))
    return pieces.select("piece").join(ends, "piece", "left").select("piece", F.coalesce("path", "piece").alias("path"), F.coalesce("offset", F.lit(0)).alias("offset"))


class Repeats:
    """The repeated windows of a corpus. `digest`, `spans`, `passages` and `texts` give results."""

    def __init__(self, docs: DataFrame, window: int = WINDOW, k: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text") -> None:
        if not 1 <= k <= window:
            raise ValueError("an anchor has at least one word and at most a window's")
        ship(docs.sparkSession)
        self.window = window
        self.blocks = cut(blocks_of(id_and_text(docs, id_col, text_col)))
        total = self.blocks.agg(F.sum("n_bytes")).first()[0] or 0
        buckets, self.tasks = (max(1, math.ceil(total / size)) for size in (BUCKET_BYTES, TASK_BYTES))
        empty = np.zeros(0, np.uint32)

        def send_anchors(batches):
            for row in _each(batches):
                s = scan(texts_of(row), window, k)
                yield _sent(row["block"], buckets, s.anchors, empty, empty, s.flags)

        def edges_in(row) -> tuple[Scan, Edges]:
            s = scan(texts_of(row), window, k)
            return s, edges(s, (_flags(row["anchors"]) & REPEATED) > 0, window)

        def send_edges(batches):
            for row in _each(batches):
                _, e = edges_in(row)
                yield _sent(row["block"], buckets, e.keys, e.before, e.after, e.flags)

        def find_pieces(batches):
            for row in _each(batches):
                s, e = edges_in(row)
                at, number, columns = pieces_of(s, e, _flags(row["edges"]), window)
                places = at.astype(np.int32).tobytes(), number.astype(np.int32).tobytes()
                yield to_batch([], [(row["block"], *places, *columns)], _FOUND)

        def exchanged(sent: DataFrame, name: str) -> DataFrame:
            dealt = sent.repartition(buckets, "bucket").groupBy("bucket")
            told = cut(dealt.applyInArrow(_answer, "block long, bucket int, flags binary"))
            return told.groupBy("block").agg(F.collect_list(F.struct("bucket", "flags")).alias(name))

        slim = self.blocks.select("block", "sizes", "blob")
        anchors = exchanged(slim.mapInArrow(send_anchors, _SENT_DDL), "anchors")
        some = self._beside(slim, anchors, "inner")
        told = exchanged(some.mapInArrow(send_edges, _SENT_DDL), "edges")
        # blocks without a repeated anchor have sent no edge
        found = self._beside(slim, anchors.join(told, "block"), "inner").mapInArrow(find_pieces, _FOUND_DDL)
        self.found = cut(found)
        each = F.posexplode(F.arrays_zip(*_PIECE)).alias("k", "p")
        placed = self.found.select("block", each).select("block", "k", "p.*")
        named = ["head", "check_a", "check_b", "n"]
        distinct = placed.groupBy(*named).agg(F.first("first").alias("first"), F.first("last").alias("last"), F.sum("places").alias("places"))
        self.pieces = cut(distinct.select(F.monotonically_increasing_id().alias("piece"), "*"))
        self.paths = cut(compacted(self.pieces))
        # coordinates: a piece is repeated if the same words are at two places or more
        on_paths = self.pieces.where("places > 1").join(self.paths, "piece").select(*named, "path", "offset")
        known = placed.join(on_paths, named).select("block", F.struct("k", "path", "offset", "n").alias("on"))
        self.known = cut(known.groupBy("block").agg(F.collect_list("on").alias("known")))

    def _beside(self, blocks: DataFrame, more: DataFrame, how: str) -> DataFrame:
        """Blocks with what is known of them; the number of tasks follows the texts."""
        return blocks.repartition(self.tasks, "block").join(more.repartition(self.tasks, "block"), "block", how)

    def _over(self, fn, schema: pa.Schema, ddl: str) -> DataFrame:
        """fn(doc_id, whole text, its repeated pieces as (first word, edges, path, offset), mask of its
        repeated words) gives rows."""
        window = self.window

        def run(batches):
            for row in _each(batches):
                texts = texts_of(row)
                known = {x["k"]: (x["n"], x["path"], x["offset"]) for x in row["known"] or ()}
                starts, number = (np.frombuffer(row[c] or b"", np.int32).tolist() for c in ("starts", "piece"))
                spots = [(at, *known[k]) for at, k in zip(starts, number) if k in known]
                begin, out = 0, []
                spots.reverse()
                for doc_id, text in zip(row["ids"], texts):
                    words = text.split()
                    own, gone = [], np.zeros(len(words) + 1, np.int32)
                    while spots and spots[-1][0] < begin + len(words):
                        at, n, path, offset = spots.pop()
                        own.append((at - begin, n, path, offset))
                        gone[at - begin] += 1
                        gone[at - begin + n + window - 1] -= 1
                    out += fn(doc_id, text, words, own, np.cumsum(gone[:-1]) > 0)
                    begin += len(words)
                yield to_batch([], out, schema)

        told = self.found.select("block", "starts", "piece").join(self.known, "block")
        return self._beside(self.blocks.drop("n_bytes"), told, "left").mapInArrow(run, ddl)

    def digest(self) -> DataFrame:
        """doc_id, n_words, n_removed, kept_sha256 for every row."""

        def one(doc_id, text, words, pieces, mask):
            gone = int(mask.sum())
            kept = [w for w, m in zip(words, mask.tolist()) if not m] if gone else words
            yield doc_id, len(words), gone, hashlib.sha256(b" ".join(kept)).hexdigest()

        schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
        return self._over(one, schema, "doc_id long, n_words long, n_removed long, kept_sha256 string")

    def spans(self) -> DataFrame:
        """doc_id, start, end: maximal runs of words that lie in repeated windows."""

        def one(doc_id, text, words, pieces, mask):
            bounds = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
            for s, e in zip(bounds[::2], bounds[1::2]):
                yield doc_id, s, e

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
        return self._over(one, schema, "doc_id long, start long, end long")

    def passages(self) -> DataFrame:
        """path, offset, doc_id, start, n_words: where each piece of a path is found in the texts. The
        pieces of one path, in the order of their offsets, are one passage."""
        window = self.window

        def one(doc_id, text, words, pieces, mask):
            for at, n, path, offset in pieces:
                yield path, offset, doc_id, at, n + window - 1

        names = ["path", "offset", "doc_id", "start", "n_words"]
        return self._over(one, pa.schema([(c, pa.int64()) for c in names]), ", ".join(f"{c} long" for c in names))

    def texts(self) -> DataFrame:
        """doc_id, text: the words that stay, joined by single spaces; texts that lose none stay as they are."""

        def one(doc_id, text, words, pieces, mask):
            if mask.any():
                text = b" ".join(w for w, m in zip(words, mask.tolist()) if not m)
            yield doc_id, text.decode("utf-8", "replace")

        return self._over(one, pa.schema([("doc_id", pa.int64()), ("text", pa.string())]), "doc_id long, text string")
