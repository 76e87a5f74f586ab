"""Near-duplicates by MinHash: many universal hash minima, banding, signatures, exact verification.

A document's set holds the hashes of its distinct word shingles; documents with equal sets form a
class, and one of each class, its representative, goes on. Of each set `bands * rows` minima are
taken under multiply-add hashes of random odd multipliers (a strongly universal family); 16 bits of
each make the signature. Representatives that agree in all minima of a band share its bucket.

Two sets with Jaccard similarity s share a bucket with probability 1 - (1 - s^rows)^bands: at 0.8 all
but 3e-7 of the pairs, at 0.3 one pair of 28, at 0.05 one of a million. A pair goes on if its
signatures agree as far as similarity 0.8 less six standard deviations asks, and is a link once the
exact sets, made again from the texts, say so.

No bucket's pairs are listed. First each member of a bucket meets the bucket's pivot (the member
that comes first in one order of all representatives, so buckets of one group of copies mostly have
the same pivot), and of its pivots each representative is verified with the one whose signature is
nearest. Links become components by alternating large and small stars. Then only buckets with
members of more than one component are looked at: those that aren't of the bucket's largest
component are held against all its members, in chunks, first by signature, then by exact sets, where
they meet. A chunk gives no more links than it has components, and the pairs themselves never
leave it.

Defined results: a null or empty text, or one without words, has an empty set and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; equal rows are one
class; a null id joins nothing and gets a null component and a null `kept`; rows that share an id
keep their own sets; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import salted_join
from . import kernels as K
from .common import cut, id_and_text, ship, text_slices, to_batch
from .near_duplicates import _signature, _verify, exact_sets, linked, shingle_sets
from .stars import components, merged, with_labels

CHUNK = 2_048  #: signatures that are read at once
CHUNK_BYTES = 4 << 20  #: of sets and signatures of one side of a chunk
TASK_BYTES = 16 << 20  #: of chunks that one task takes together
PIECE = 1 << 15  #: tokens that are hashed at once

_SLIM = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sig_a", pa.int64()), ("sig_b", pa.int64()), ("minima", pa.binary())])
_SLIM_DDL = "doc_id long, n long, sig_a long, sig_b long, minima binary"


@dataclass(frozen=True)
class Family:
    """The hashes: for token x, of 32 bits, (a x + b) mod 2^64 for drawn odd a and any b."""

    rows: int = 6
    bands: int = 50
    seed: int = 11

    @property
    def size(self) -> int:
        return self.rows * self.bands

    def drawn(self) -> tuple[np.ndarray, np.ndarray]:
        rng = np.random.default_rng(self.seed)
        a, b = rng.integers(0, 1 << 64, (2, self.size), np.uint64)
        return a | K.U(1), b

    def minima(self, sets: list[np.ndarray]) -> np.ndarray:
        """16 bits of each minimum, a row for each of these sets (none is empty)."""
        x = K.mix(np.concatenate(sets)) >> K.U(32)
        ends = np.cumsum([len(s) for s in sets])
        least = np.full((self.size, len(sets)), ~K.U(0))
        hashed = np.empty(PIECE, np.uint64)
        for at in range(0, len(x), PIECE):
            some = x[at : at + PIECE]
            first, last = np.searchsorted(ends, [at, at + len(some) - 1], "right")
            starts = np.maximum(np.append(0, ends)[first : last + 1] - at, 0)
            h = hashed[: len(some)]
            for k, (a, b) in enumerate(zip(*self.drawn())):
                np.multiply(some, a, out=h)
                h += b
                own = least[k, first : last + 1]
                np.minimum(own, np.minimum.reduceat(h, starts), out=own)
        return np.ascontiguousarray((least >> K.U(24)).astype(np.uint16).T)  # these bits differ for any size of set

    def keys(self, minima: np.ndarray) -> np.ndarray:
        """A key for each band of each row; its last six bits are the band's number."""
        parts = minima.reshape(len(minima), self.bands, self.rows).astype(np.uint64) + K.U(1)
        base = K.powers(K.NODE_BASE, self.rows + 1)[0][1 : self.rows + 1]
        band = np.arange(self.bands, dtype=np.uint64)
        return K.mix((parts * base).sum(2, dtype=np.uint64) + (band << K.U(56))) & ~K.U(63) | band

    def needed(self, percent: int) -> int:
        """Minima that linked sets agree in at least, but for six standard deviations."""
        p = percent / 100
        return max(1, math.floor(self.size * p - 6 * math.sqrt(self.size * p * (1 - p))))


def _first_band(a: np.ndarray, b: np.ndarray, family: Family) -> np.ndarray:
    """The first band that rows of a and b share."""
    return (a == b).reshape(len(a), family.bands, family.rows).all(2).argmax(1)


def _read(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, width)


def _passing(table: pa.Table, family: Family, need: int):
    """(probe, targets) of a sorted table's pieces (key, i, j), as row numbers: of different
    components, signatures that agree enough, the nearest first; each pair in the first band that it
    shares, and once where both are odd."""
    key, rep, label, odd, probe = (table.column(c).to_numpy() for c in ("key", "rep", "label", "odd", "probe"))
    minima = _read(table.column("minima"), family.size)
    new = np.any([np.diff(table.column(c).to_numpy(), prepend=-1) != 0 for c in ("key", "i", "j")], axis=0)
    starts = np.flatnonzero(new)
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(rep)]):
        targets, band = s + np.flatnonzero(~probe[s:e]), int(key[s]) & 63
        theirs = minima[targets]
        for p in (s + np.flatnonzero(probe[s:e])).tolist():
            score = (theirs == minima[p]).sum(1)
            t = np.flatnonzero((label[targets] != label[p]) & (~odd[targets] | (rep[targets] > rep[p])) & (score >= need))
            t = t[_first_band(theirs[t], np.broadcast_to(minima[p], (len(t), family.size)), family) == band]
            if len(t):
                yield p, targets[t[np.argsort(-score[t], kind="stable")]]


class MinHash:
    """The links of a corpus at `percent` of Jaccard similarity on `size`-word shingles. `links` has
    pairs of representatives that connect all linked classes; `members` says it for every row."""

    def __init__(self, docs: DataFrame, size: int = 2, percent: int = 80, family: Family = Family(), id_col: str = "doc_id", text_col: str = "text") -> None:
        if family.bands > 64:
            raise ValueError("keys have room for 64 bands")
        ship(docs.sparkSession)
        self.size, self.percent, self.family = size, percent, family
        self.docs = id_and_text(docs, id_col, text_col)
        self.slim = cut(self.docs.mapInArrow(self._described(), _SLIM_DDL))
        real = self.slim.where("n > 0 and doc_id is not null")
        same = [F.first(c).alias(c) for c in ("n", "minima")]
        classes = real.groupBy("sig_a", "sig_b").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_rows"), *same)
        classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()))
        self.classes = classes.drop("minima")
        self.minima = classes.select("rep", "minima")
        self.links, self.labels = self._connect()

    def _described(self):
        size, family = self.size, self.family

        def run(batches):
            for batch in batches:
                for part, texts in text_slices(batch):
                    sets = list(shingle_sets(texts, size))
                    full = [s for s in sets if len(s)]
                    minima = iter(family.minima(full)) if full else iter(())
                    rows = [(len(s), *_signature(s), next(minima).tobytes()) if len(s) else (0, None, None, None) for s in sets]
                    yield to_batch([part.column(0)], rows, _SLIM)

        return run

    # ---- candidates -----------------------------------------------------------------------

    def _shared_buckets(self) -> DataFrame:
        """(key, rep, k, pivot) for buckets of k > 1 representatives."""
        family = self.family

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    keys = family.keys(_read(part.column(1), family.size))
                    reps = np.repeat(part.column(0).to_numpy(), family.bands)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(reps)], names=["key", "rep"])

        bands = self.minima.mapInArrow(run, "key long, rep long")
        pivot = F.min(F.struct(F.xxhash64("rep"), "rep"))["rep"].alias("pivot")
        groups = cut(bands.groupBy("key").agg(F.count("*").alias("k"), pivot).where("k > 1"))
        return cut(salted_join(bands, groups, ["key"], "rep", groups.select("key", F.col("k").alias("n_rows"))))

    def _with_pivots(self, buckets: DataFrame) -> DataFrame:
        """(a, b) to verify: each representative and the pivot with the nearest signature, and the
        members of buckets of two, if they pass."""
        family, need = self.family, self.family.needed(self.percent)
        met = buckets.where("rep != pivot").groupBy("rep", "pivot").agg(F.max(F.col("k") == 2).alias("two"))
        met = cut(met)
        side = lambda name, m: self.minima.select(F.col("rep").alias(name), F.col("minima").alias(m))
        both = salted_join(met, side("pivot", "theirs"), ["pivot"], "rep").join(side("rep", "own"), "rep")

        def run(batches):
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK):
                    part = batch.slice(at, CHUNK)
                    score = (_read(part.column(3), family.size) == _read(part.column(4), family.size)).sum(1)
                    fine = pa.array(score >= need)
                    yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(score)], names=["rep", "pivot", "two", "score"]).filter(fine)

        scored = both.select("rep", "pivot", "two", "theirs", "own").mapInArrow(run, "rep long, pivot long, two boolean, score long")
        scored = cut(scored)
        best = scored.groupBy("rep").agg(F.max(F.struct("score", "pivot"))["pivot"].alias("pivot"))
        pairs = best.unionByName(scored.where("two").select("rep", "pivot"))
        return cut(pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct())

    def _across(self, buckets: DataFrame, labels: DataFrame) -> DataFrame | None:
        """(a, b): links between different components that share a bucket; None if no bucket has
        members of more than one component. Members that aren't of their bucket's largest component
        are held against all its members. A first pass, by signatures, keeps those that have a pair
        which passes; the exact sets of these are made, and dealt as before, and pairs are verified
        where they meet, the nearest first, while their components are still apart there."""
        size, percent, family, need = self.size, self.percent, self.family, self.family.needed(self.percent)
        sizes = self.classes.select("rep", (8 * F.col("n") + 2 * family.size).alias("bytes"))
        named = cut(with_labels(buckets.where("k > 2").select("key", "rep"), labels, "rep", "label").join(sizes, "rep"))
        per = named.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("bytes").alias("bytes"))
        mixed = per.groupBy("key").agg(F.max(F.struct("bytes", "label")).alias("top"), F.sum("c").alias("n_rows"), F.sum("bytes").alias("bytes"), F.count("*").alias("labels"))
        parts = lambda size: F.greatest(F.lit(1), F.ceil(size / CHUNK_BYTES)).cast("int")
        chunks = [F.col("top.label").alias("top"), parts(F.col("bytes")).alias("chunks"), parts(F.col("bytes") - F.col("top.bytes")).alias("halves")]
        mixed = cut(mixed.where("labels > 1").select("key", "n_rows", *chunks))
        rows = salted_join(named, mixed.drop("n_rows"), ["key"], "rep", mixed.select("key", "n_rows"))
        odd = F.col("label") != F.col("top")
        own = ["key", "rep", "label", "bytes", odd.alias("odd")]
        target = rows.select(*own, F.lit(False).alias("probe"), F.pmod(F.xxhash64("rep"), "chunks").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("halves") - 1)).alias("j"))
        probes = rows.where(odd).select(*own, F.lit(True).alias("probe"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("i"), F.pmod(F.xxhash64(F.lit(1), "rep"), "halves").cast("int").alias("j"))
        met = cut(target.unionByName(probes))
        columns = ["key", "i", "j", "rep", "label", "bytes", "odd", "probe"]

        def dealt(rows: DataFrame, *more: DataFrame) -> DataFrame | None:
            total = rows.agg(F.sum("bytes")).first()[0]
            for table in (self.minima, *more):
                rows = rows.join(table, "rep")
            return rows.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(-(-total // TASK_BYTES)))) if total else None

        def keep(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in ("key", "i", "j")])
            kept = np.zeros(len(table), bool)
            for p, t in _passing(table, family, need):
                kept[p] = kept[t] = True
            return table.select(columns).filter(pa.array(kept))

        first = dealt(met)
        if first is None:
            return None
        left = cut(first.groupBy("task").applyInArrow(keep, "key long, i int, j int, rep long, label long, bytes long, odd boolean, probe boolean"))

        def link(table: pa.Table) -> pa.Table:
            table = table.sort_by([(c, "ascending") for c in ("key", "i", "j")])
            rep, label = table.column("rep").to_pylist(), table.column("label").to_pylist()
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("tokens")]
            root: dict[int, int] = {}

            def find(v: int) -> int:
                while (up := root.setdefault(v, v)) != v:
                    root[v] = v = root.setdefault(up, up)
                return v

            links = []
            for p, t in _passing(table, family, need):
                for k in t.tolist():
                    a, b = find(label[p]), find(label[k])
                    if a != b and linked(sets[p], sets[k], percent):
                        root[a] = b
                        links.append((min(rep[p], rep[k]), max(rep[p], rep[k])))
            return pa.table({c: pa.array([x[k] for x in links], pa.int64()) for k, c in enumerate("ab")})

        second = dealt(left, exact_sets(self.docs, self.classes, left.select("rep").distinct(), size))
        return second and cut(second.groupBy("task").applyInArrow(link, "a long, b long").distinct())

    # ---- links ------------------------------------------------------------------------------

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that are links, by their exact sets."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        sets = exact_sets(self.docs, self.classes, ends, self.size)
        left, right = (sets.select(F.col("rep").alias(k), F.col("tokens").alias(f"t{k}")) for k in "ab")
        with_a = salted_join(pairs, left, ["a"], "b")
        both = salted_join(with_a, right, ["b"], "a", pairs.groupBy("b").agg(F.count("*").alias("n_rows")))
        return cut(both.select("a", "b", "ta", "tb").mapInArrow(_verify(self.percent), "a long, b long"))

    def _connect(self) -> tuple[DataFrame, DataFrame]:
        buckets = self._shared_buckets()
        links = self._verified(self._with_pivots(buckets))
        labels = cut(components(links))
        if (more := self._across(buckets, labels)) is not None:
            links, labels = links.unionByName(more), merged(labels, more)
        return links, labels

    def members(self) -> DataFrame:
        """doc_id, n_shingles, class_id, component_id (smallest ids of the class and the component)
        and kept (whether the row's id is the component's) for every row."""
        named = cut(self.classes.join(self.labels, "rep", "left").withColumn("label", F.coalesce("label", "rep")).drop("n"))
        heads = cut(named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("n_rows")))
        placed = salted_join(named.withColumnRenamed("doc_id", "class_id").drop("rep"), heads.drop("n_rows"), ["label"], "class_id", heads)
        placed = cut(placed.select("sig_a", "sig_b", "class_id", "component_id", "n_rows"))
        rows = self.slim.select("doc_id", F.col("n").alias("n_shingles"), "sig_a", "sig_b")
        full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        joined = salted_join(rows.where(full), placed.drop("n_rows"), ["sig_a", "sig_b"], "doc_id", placed)
        alone = rows.where(~full).withColumns({"class_id": F.col("doc_id"), "component_id": F.col("doc_id")})
        kept = (F.col("doc_id") == F.col("component_id")).alias("kept")
        return joined.unionByName(alone).select("doc_id", "n_shingles", "class_id", "component_id", kept)
