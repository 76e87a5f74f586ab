"""N-gram Jaccard join with an index of count vectors.

A document's set holds the hashes of its distinct word shingles. Documents with equal sets form a
class; one of each, its representative, goes on. A representative is a point: its tokens (shingle
hashes) are dealt into groups and counted. For any two sets the overlap is at most the sum of the
smaller coordinates, so an R-tree over the points, whose boxes hold the largest coordinates below
them, prunes pairs, and whole boxes, that can't reach the threshold. Survivors are verified by
their exact sets.

So that the index is spread over a cluster, its root splits points by token: a point goes to the
entries of the rarest among its `SKETCH` smallest hashes. Two sets with Jaccard similarity of 0.75
share fewer than SKETCH/4 of these with a probability below 1e-12 (and sets of up to SKETCH tokens
share more always), so linked points meet in one of the SKETCH - SKETCH/4 + 1 rarest tokens of
both; a point with no token that another one has takes part in nothing. Under a token, each point
is first held against one member that is drawn for the token, so a point meets as many others as it
has tokens, which links nearly all of a group of copies. Of the tokens whose members still are in different components, R-trees take the members and give the
pairs of different components that pass the bounds; of tokens with the same members, one counts.
That repeats, with components merged, until no such pair is unverified.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; equal rows are one
class; a null id joins nothing and gets a null component, whatever its text; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from . import kernels as K
from . import url_filters
from .common import cut, id_and_text, ship, text_slices, to_batch
from .stars import components, merged, with_labels

SHINGLE, PERCENT = 5, 75
SKETCH = 48
GROUPS = 256  #: coordinates of a point: counts of one byte, where 255 stands for 255 and more
BITS = 64  #: bytes of the bitmap of sketch tokens
LEAF, FAN = 64, 16  #: points to a leaf, nodes to a node above
PART = 4_096  #: members of a token in one part; more are dealt over several
CHUNK = 8_192  #: points of one token that one R-tree holds
BLOCK = 2_048  #: representatives to a block
SHARE = 20_000  #: rows of tokens with the same first component in one bucket
HELD_PAIRS = 1 << 18  #: that a task holds before it drops those it has twice
PAIRS = 8_192  #: pairs whose bounds are computed at once
FILTER_BITS = 10  #: for each id in the filter of texts that are read again
SHINGLE_BASE = 0x8EBC6AF09C88C6E3 | 1


def shingle_sets(texts: list[bytes], size: int = SHINGLE):
    """The sorted distinct shingle hashes of each text; A-Z count as a-z."""
    words, bounds = K.words_of(texts, lower=True)
    grams = K.window_hashes(words, size, SHINGLE_BASE)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            yield K.span_hashes(words[a:b], np.array([0]), np.array([b - a]), SHINGLE_BASE)
        else:
            yield np.zeros(0, np.uint64)


def _signature(tokens: np.ndarray) -> tuple[int, int]:
    a = int(np.add.reduce(K.mix(tokens ^ K.U(0x5851F42D4C957F2D))))
    b = int(np.bitwise_xor.reduce(K.mix(tokens + K.U(0x14057B7EF767814F))))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return signed(a), signed(b)


def _point(tokens: np.ndarray) -> bytes:
    return np.bincount((tokens >> K.U(20)).astype(np.int64) % GROUPS, minlength=GROUPS).clip(max=255).astype(np.uint8).tobytes()


def _bitmap(sketch: np.ndarray) -> bytes:
    bits = np.zeros(8 * BITS, bool)
    bits[(sketch % K.U(8 * BITS)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


_SLIM = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("first", pa.int64()),
        ("n", pa.int64()),
        ("sig_a", pa.int64()),
        ("sig_b", pa.int64()),
        ("point", pa.binary()),
        ("sketch", pa.binary()),
    ]
)
_SLIM_DDL = "doc_id long, first long, n long, sig_a long, sig_b long, point binary, sketch binary"


def _row(tokens: np.ndarray) -> tuple:
    if not len(tokens):
        return 0, None, None, None, None
    return len(tokens), *_signature(tokens), _point(tokens), tokens[:SKETCH].tobytes()


def _described(size: int):
    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                yield to_batch([part.column(0), part.column(2)], [_row(t) for t in shingle_sets(texts, size)], _SLIM)

    return run


def _needed(sketch_size: int) -> int:
    """Sketch tokens that linked sets share at least."""
    return max(1, sketch_size // 4)


# ---- tokens that more than one representative has -------------------------------------------


_BLOCKS = pa.schema([("block", pa.int64()), ("reps", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("tokens", pa.binary())])
_ASKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def _blocks(classes: DataFrame) -> DataFrame:
    def run(batches):
        task, k = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                sketches = part.column(1).to_pylist()
                row = (task << 32 | k, part.column(0).to_pylist(), [len(s) // 8 for s in sketches], b"".join(sketches))
                yield to_batch([], [row], _BLOCKS)
                k += 1

    return classes.select("rep", "sketch").mapInArrow(run, "block long, reps array<long>, sizes array<int>, tokens binary")


def _shared_tokens(classes: DataFrame) -> DataFrame:
    """(token, rep, m) for the rarest tokens of each representative, as far as others have them too;
    m is how many have the token among their smallest. A block asks for each of its distinct tokens
    once, so a token of all documents takes one entry a block."""
    blocks = cut(_blocks(classes))
    total = blocks.agg(F.sum(F.length("tokens"))).first()[0] or 0
    buckets = max(1, math.ceil(total / (6 << 20)))

    def distinct(row):
        tokens = np.frombuffer(row["tokens"], np.uint64)
        return np.unique(tokens, return_inverse=True, return_counts=True)

    def runs(hashes):
        # sketches hold small hashes: mix before dealing them out
        number = ((K.mix(hashes) >> K.U(32)) * K.U(buckets)) >> K.U(32)
        order = np.argsort(number, kind="stable")
        number = number[order]
        starts = np.flatnonzero(np.diff(number, prepend=number[0] + K.U(1))) if len(order) else np.zeros(0, np.int64)
        return order, [(int(number[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(order)])]

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, _, counts = distinct(row)
                order, parts = runs(tokens)
                tokens, counts = tokens[order], counts[order].astype(np.uint32)
                rows = [(k, row["block"], tokens[a:b].tobytes(), counts[a:b].tobytes()) for k, a, b in parts]
                yield to_batch([], rows, _ASKED)

    def answer(table: pa.Table) -> pa.Table:
        keys = table.column("keys").to_pylist()
        tokens = np.frombuffer(b"".join(keys), np.uint64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32)
        _, inverse = np.unique(tokens, return_inverse=True)
        sums = np.minimum(np.bincount(inverse, counts), 0x7FFFFFFF).astype(np.uint32)[inverse].tobytes()
        ends = np.cumsum([len(x) // 2 for x in keys]).tolist()
        found = pa.array([sums[e - len(x) // 2 : e] for e, x in zip(ends, keys)], pa.binary())
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "counts": found})

    asked = blocks.select("block", "tokens").mapInArrow(ask, "bucket int, block long, keys binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(answer, "block long, bucket int, counts binary")
    answers = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "counts")).alias("answers"))

    def keys(batches):
        for batch in batches:
            for row in batch.to_pylist():
                tokens, inverse, _ = distinct(row)
                order, _ = runs(tokens)
                counts = np.empty(len(tokens), np.uint32)
                told = sorted(row["answers"], key=lambda a: a["bucket"])
                counts[order] = np.frombuffer(b"".join(a["counts"] for a in told), np.uint32)
                found, own = counts[inverse], np.frombuffer(row["tokens"], np.uint64)
                spots, reps, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
                for rep, size in zip(row["reps"], row["sizes"]):
                    f = found[at : at + size]
                    rarest = np.lexsort((own[at : at + size], f))[: size - _needed(size) + 1]
                    rarest = rarest[f[rarest] > 1] + at
                    spots.append(rarest)
                    reps.append(np.full(len(rarest), rep, np.int64))
                    at += size
                spot = np.concatenate(spots)
                columns = [own[spot].view(np.int64), np.concatenate(reps), found[spot].astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "rep", "m"])

    return blocks.join(answers, "block").mapInArrow(keys, "token long, rep long, m int")


# ---- bounds, R-trees, verification ----------------------------------------------------------


def _enough(overlap, na, nb, percent: int):
    """Whether an overlap (or a bound of it) makes percent of the union of sets of these sizes."""
    return 100 * overlap >= percent * (na + nb - overlap)


def _matrix(column, kind, width: int) -> np.ndarray:
    """Values of one length, as rows; a view of an Arrow column where it is one piece."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, width), kind)
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(kind).reshape(-1, width)


def _bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """What the overlap is at most: the sum of the smaller coordinates; without bound where both
    have a coordinate that doesn't fit its byte."""
    low = np.minimum(a, b)
    return np.where((low == 255).any(-1), 1 << 40, low.sum(-1, dtype=np.int64))


@dataclass
class Points:
    """Sizes, count vectors and sketch bitmaps of some sets, row by row."""

    n: np.ndarray
    points: np.ndarray
    bits: np.ndarray

    @classmethod
    def of(cls, n: np.ndarray, points: pa.Array, bits: pa.Array) -> "Points":
        return cls(n, _matrix(points, np.uint8, GROUPS), _matrix(bits, np.uint64, BITS // 8))

    def __getitem__(self, k) -> "Points":
        return Points(self.n[k], self.points[k], self.bits[k])


def _passes(a: Points, i: np.ndarray, b: Points, j: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (i of a, j of b): may they be linked, and how many sketch bits have they in common?"""
    fine, score = np.zeros(len(i), bool), np.zeros(len(i), np.int64)
    for at in range(0, len(i), PAIRS):
        x, y = i[at : at + PAIRS], j[at : at + PAIRS]
        na, nb, ba, bb = a.n[x], b.n[y], a.bits[x], b.bits[y]
        common = np.bitwise_count(ba & bb).sum(-1, dtype=np.int64)
        fill = np.minimum(na, SKETCH) - np.bitwise_count(ba).sum(-1, dtype=np.int64)  # tokens that fell on one bit
        need = np.maximum(1, np.minimum(np.minimum(na, nb), SKETCH) // 4)
        left = np.flatnonzero((common + fill >= need) & _enough(np.minimum(na, nb), na, nb, percent))
        left = left[_enough(_bound(a.points[x[left]], b.points[y[left]]), na[left], nb[left], percent)]
        fine[at + left] = True
        score[at : at + PAIRS] = common
    return fine, score


def _filter_pairs(percent: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, PAIRS):
                part = batch.slice(at, PAIRS)
                c = dict(zip(part.schema.names, part.columns))
                one, two = (Points.of(c[f"n{k}"].to_numpy(zero_copy_only=False), c[f"p{k}"], c[f"b{k}"]) for k in "ab")
                row = np.arange(part.num_rows)
                mask = pa.array(_passes(one, row, two, row, percent)[0])
                yield pa.RecordBatch.from_arrays([c["a"], c["b"]], names=["a", "b"]).filter(mask)

    return run


class RTree:
    """Points packed into leaves of up to LEAF, sorted by size and then by their first coordinates,
    and FAN nodes of one level into one of the next, up to a root of at most FAN. The box of a node
    has the smallest and largest size and the largest coordinates of all points below it."""

    def __init__(self, own: Points) -> None:
        slab = np.argsort(own.n, kind="stable")
        self.leaves: list[np.ndarray] = []
        for at in range(0, len(slab), LEAF * FAN):  # tiles: by size, then by the first coordinate
            tile = slab[at : at + LEAF * FAN]
            tile = tile[np.argsort(own.points[tile, 0], kind="stable")]
            self.leaves += [tile[k : k + LEAF] for k in range(0, len(tile), LEAF)]
        low = np.array([own.n[x].min() for x in self.leaves])
        high = np.array([own.n[x].max() for x in self.leaves])
        self.levels = [(low, high, np.stack([own.points[x].max(0) for x in self.leaves]))]
        while len(self.levels[-1][0]) > FAN:
            low, high, box = self.levels[-1]
            at = np.arange(0, len(low), FAN)
            self.levels.append((np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(box, at)))

    def near(self, k: int, percent: int) -> np.ndarray:
        """Leaves, from k on, that can hold points linked to points of leaf k: from the root down,
        without the nodes whose boxes rule it out and those that end before k."""
        small, large, corner = (x[k] for x in self.levels[0])
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in reversed(range(len(self.levels))):
            low, high, box = (x[nodes] for x in self.levels[depth])
            fine = _enough(_bound(box, corner), small, low, percent)
            fine &= (100 * high >= percent * small) & (100 * large >= percent * low)
            nodes = nodes[fine & ((nodes + 1) * FAN**depth > k)]
            if depth:
                nodes = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return nodes


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Up to `most` pairs for each i, those with the highest score first; and each i that had more."""
    order = np.lexsort((j, -score, i))
    i, j = i[order], j[order]
    begin = np.flatnonzero(np.diff(i, prepend=-1))
    place = np.arange(len(i)) - np.repeat(begin, np.diff(np.append(begin, len(i))))
    return i[place < most], j[place < most], i[place == most]


def _pairs_of(own: Points, label: np.ndarray, mine: np.ndarray, percent: int, most: int):
    """Pairs (i, j) of different labels that pass the bounds, up to `most` for each i, and each i that
    had more. mine: the half of the points that pairs are wanted of, where there are two halves.
    No more than a leaf's pairs are held at once, beside `most` for each point."""
    tree = RTree(own)
    found = []
    for k, x in enumerate(tree.leaves):
        y = np.concatenate([tree.leaves[m] for m in tree.near(k, percent)] or [x[:0]])
        want = (label[x][:, None] != label[y][None, :]) & (mine[x][:, None] | mine[y][None, :])
        same = np.flatnonzero(np.isin(y, x))  # within the leaf, each pair once
        want[:, same] &= x[:, None] < y[same][None, :]
        i, j = np.nonzero(want)
        i, j = x[i], y[j]
        fine, score = _passes(own, i, own, j, percent)
        found.append(_best(i[fine], j[fine], score[fine], most))
    return [np.concatenate(x) for x in zip(*found)]


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    """Of columns (a, b), each once: pairs may meet under several tokens."""
    a, b = np.concatenate(parts, axis=1)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return np.stack([a[new], b[new]])


def _tree_pairs(percent: int, most: int):
    """For a bucket of tokens: the pairs under each token that `_pairs_of` gives. A row with b null
    says that there were more."""

    def run(table: pa.Table) -> pa.Table:
        place = pc.sort_indices(table, [("token", "ascending"), ("i", "ascending"), ("j", "ascending")]).to_numpy()
        num = lambda c: table.column(c).to_numpy()[place]
        rep, label, mine = num("rep"), num("label"), num("own")
        every = Points.of(table.column("n").to_numpy(), table.column("point"), table.column("bits"))
        new = np.ones(len(rep), bool)
        new[1:] = np.any([num(c)[1:] != num(c)[:-1] for c in ("token", "i", "j")], axis=0)
        starts = np.flatnonzero(new)
        both, fresh, more = np.zeros((2, 0), np.int64), [], [np.zeros(0, np.int64)]
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
            if (label[s:e] != label[s]).any():
                i, j, left = _pairs_of(every[place[s:e]], label[s:e], mine[s:e], percent, most)
                fresh.append(np.sort(np.stack([rep[i + s], rep[j + s]]), axis=0))
                more.append(rep[left + s])
                if sum(x.shape[1] for x in fresh) > HELD_PAIRS:
                    both, fresh = _distinct([both, *fresh]), []
        both = _distinct([both, *fresh])
        left = np.unique(np.concatenate(more))
        mask = np.concatenate([np.zeros(both.shape[1], bool), np.ones(len(left), bool)])
        return pa.table({"a": pa.array(np.concatenate([both[0], left])), "b": pa.array(np.concatenate([both[1], left]), mask=mask)})

    return run


def linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are links."""
    if not _enough(min(len(x), len(y)), len(x), len(y), percent):
        return False
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # two sorted runs: a merge
    return bool(_enough(int((both[1:] == both[:-1]).sum()), len(x), len(y), percent))


def _verify(percent: int):
    """Rows (a, b, exact set of a, exact set of b) that are links."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):  # views, one pair at a time
                keep.append(linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(mask)

    return run


def exact_sets(docs: DataFrame, classes: DataFrame, some: DataFrame, size: int) -> DataFrame:
    """(rep, tokens): the exact sets of some representatives, made from their texts again. docs:
    doc_id and text; classes: rep, doc_id and signature."""

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                sets = list(shingle_sets(texts, size))
                signed = zip(sets, part.column(2).to_pylist(), part.column(3).to_pylist())
                fine = pa.array([len(t) > 0 and _signature(t) == (a, b) for t, a, b in signed], pa.bool_())
                tokens = pa.array([t.tobytes() for t in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), tokens], names=["rep", "tokens"]).filter(fine)

    wanted = cut(some.join(classes, "rep").select("doc_id", "rep", "sig_a", "sig_b"))
    # the other documents' texts needn't be shuffled: nearly all of them fail a Bloom filter of the ids
    ids = wanted.select(F.col("doc_id").cast("string").alias("key")).distinct()
    n = ids.count()
    if n * FILTER_BITS <= 8 * url_filters.MAX_FILTER_BYTES:
        docs = docs.where(url_filters.bloom(ids, n, FILTER_BITS, 2, 9_000).reports(F.col("doc_id").cast("string")))
    texts = docs.join(wanted, "doc_id").select("rep", "text", "sig_a", "sig_b")
    return cut(texts.mapInArrow(run, "rep long, tokens binary").dropDuplicates(["rep"]))


class JaccardJoin:
    """The links of a corpus. `links` has pairs of class representatives that connect all linked
    classes (not every link of a component); `members` has the class and component of every row.

    Classes have numbers of their own (`rep`), in the order of their smallest `first_col` (the id, if
    not given; nulls last) and id, so one id may come with several texts."""

    def __init__(self, docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", first_col: str | None = None) -> None:
        if not 75 <= percent <= 100:
            raise ValueError("sketches are sized for 75 percent and more")
        ship(docs.sparkSession)
        self.size, self.percent = size, percent
        self.docs = id_and_text(docs, id_col, text_col)
        first = F.col(first_col or id_col).cast("long").alias("first")
        described = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), first)
        self.slim = cut(described.mapInArrow(_described(size), _SLIM_DDL))
        real = self.slim.where("n > 0 and doc_id is not null")
        head = F.min(F.struct(F.col("first").isNull().alias("last"), "first", "doc_id")).alias("head")
        same = [F.first(c).alias(c) for c in ("n", "point", "sketch")]
        classes = real.groupBy("sig_a", "sig_b").agg(head, F.count("*").alias("n_rows"), *same).orderBy("head", "sig_a", "sig_b")
        number = F.monotonically_increasing_id().alias("rep")
        classes = cut(classes.select("sig_a", "sig_b", "head.doc_id", number, "n_rows", "n", "point", "sketch"))
        self.classes = classes.select("sig_a", "sig_b", "rep", "doc_id", "n_rows")
        self.links, self.labels = self._connect(classes, cut(_shared_tokens(classes)))

    def _connect(self, classes: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
        percent = self.percent

        def of_tokens(tokens: DataFrame) -> DataFrame:
            """One row for each part of a token, so that a token of many meets its rows in several tasks."""
            return tokens.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

        parts = F.ceil(F.col("m") / PART).cast("int")
        shared = shared.select("token", "rep", parts.alias("parts"), F.pmod(F.xxhash64("rep"), parts).cast("int").alias("part"))
        # tokens with the same members make one group: the token with the smallest value speaks for it
        sums = F.sum(F.xxhash64("rep").cast("decimal(20,0)")), F.bit_xor(F.xxhash64(F.lit(1), "rep"))
        drawn = F.min(F.struct(F.xxhash64("token", "rep"), "rep"))["rep"].alias("pivot")
        groups = shared.groupBy("token").agg(F.struct(F.count("*"), *sums).alias("members"), drawn, F.count("*").alias("k"), F.first("parts").alias("parts"))
        one = F.min(F.struct("token", "pivot", "parts")).alias("one")
        groups = groups.where("k > 1").groupBy("members").agg(one).select("one.*")
        keys = cut(shared.join(of_tokens(groups), ["token", "part"]))
        pairs = keys.where("rep != pivot").select(F.least("pivot", "rep").alias("a"), F.greatest("pivot", "rep").alias("b")).distinct()
        members = keys.select("rep").distinct()

        def slim(batches):
            for batch in batches:
                bits = [_bitmap(np.frombuffer(s, np.uint64)) for s in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(bits, pa.binary())], names=["rep", "n", "point", "bits"])

        payload = classes.join(members, "rep").select("rep", "n", "point", "sketch")
        payload = cut(payload.mapInArrow(slim, "rep long, n long, point binary, bits binary"))

        def side(k: str) -> DataFrame:
            return payload.select(F.col("rep").alias(k), *[F.col(c).alias(c[0] + k) for c in ("n", "point", "bits")])

        def verified(p: DataFrame) -> DataFrame:
            ends = p.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
            sets = exact_sets(self.docs, self.classes, ends, self.size)
            left, right = (sets.select(F.col("rep").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
            return cut(p.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(_verify(percent), "a long, b long"))

        bounded = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", *[f"{c}{k}" for k in "ab" for c in "npb"])
        # pairs that don't pass the bounds are no links, and the trees, which hold the same bounds, don't give them
        tested = cut(bounded.mapInArrow(_filter_pairs(percent), "a long, b long"))
        links = verified(tested)
        labels = cut(components(links), again=True)
        most = 2_048
        while True:
            named = with_labels(keys.select("token", "part", "parts", "rep"), labels, "rep", "label")
            ends = F.min("label").alias("x"), F.max("label").alias("y")
            mixed = named.groupBy("token").agg(*ends, F.count("*").alias("m"), F.first("parts").alias("parts"))
            mixed = cut(mixed.where("x != y").select("token", "x", "m", "parts", F.ceil(F.col("m") / CHUNK).cast("int").alias("chunks")))
            total = mixed.agg(F.sum(F.col("m") * F.col("chunks"))).first()[0]
            if not total:
                break
            buckets = math.ceil(total / 20_000)
            # tokens of one group of copies go to few buckets, which drop the pairs that they have twice
            shares = mixed.groupBy("x").agg(F.ceil(F.sum(F.col("m") * F.col("chunks")) / SHARE).alias("shares"))
            mixed = mixed.join(shares, "x")
            rows = named.drop("parts").join(of_tokens(mixed), ["token", "part"]).join(payload, "rep")
            # a token of more than CHUNK points is split; each pair of its chunks meets once
            rows = rows.withColumn("chunk", F.pmod(F.xxhash64("rep"), "chunks").cast("int"))
            rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
            i, j = F.least("chunk", "other"), F.greatest("chunk", "other")
            share = F.pmod(F.xxhash64("token", i, j), "shares")
            bucket = F.pmod(F.xxhash64("x", share), F.lit(buckets)).alias("bucket")
            own = ((F.col("chunk") == i) | (i == j)).alias("own")
            dealt = rows.select(bucket, "token", i.alias("i"), j.alias("j"), "rep", "label", own, "n", "point", "bits")
            found = cut(dealt.groupBy("bucket").applyInArrow(_tree_pairs(percent, most), "a long, b long").distinct())
            fresh = cut(found.where("b is not null").join(tested, ["a", "b"], "left_anti"))
            if fresh.limit(1).count():
                new = verified(fresh)
                links, tested = links.unionByName(new), tested.unionByName(fresh)
                labels = merged(labels, new)
            if not found.where("b is null").limit(1).count():
                break
            most *= 8
        return links, labels

    def members(self) -> DataFrame:
        """doc_id, n_shingles, class_id (its smallest id), component_id (its first class's) for every row."""
        named = self.classes.join(self.labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        heads = self.classes.select(F.col("rep").alias("label"), F.col("doc_id").alias("component_id"))
        placed = salted_join(named.withColumnRenamed("doc_id", "class_id"), heads, ["label"], "rep")
        placed = cut(placed.select("sig_a", "sig_b", "class_id", "component_id", "n_rows"))
        rows = self.slim.select("doc_id", F.col("n").alias("n_shingles"), "sig_a", "sig_b")
        full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        joined = salted_join(rows.where(full), placed.drop("n_rows"), ["sig_a", "sig_b"], "doc_id", placed)
        alone = rows.where(~full).withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id")})
        return joined.unionByName(alone).select("doc_id", "n_shingles", "class_id", "component_id")
