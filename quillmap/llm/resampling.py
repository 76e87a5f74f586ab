"""Importance resampling of a corpus towards a target corpus, by hashed word n-grams.

Features are runs of 1 to `n` words; each falls into one of some thousand buckets by its CRC-32. A
bucket's gain is the logarithm of how much more frequent it is in the target than in the corpus, a
document's weight the mean gain of its features, and a seeded Gumbel draw over the weights takes
documents without replacement.

Postings are inverted and dealt by bucket: a task that reads texts counts (bucket, document) pairs
there and packs those of some hundred documents, a block, by part of the buckets. Each part of the
buckets has as many shares as it takes to keep a task's rows bounded, and a block goes to one share
of every part, so a word that all documents have is spread over all shares. A share's task first
meets its buckets' totals in both corpora, makes the gains from them, and then streams its
postings, block by block, into one sum for each document of the block. The sums of a document's
parts are added up at last. What is shuffled is some bytes a posting and 8 bytes a document and
part; totals are 10,000 numbers, aggregated before they are shuffled.

Defined results: a null text has no features, as an empty one; without features the weight is 0; a
null id is never drawn, doesn't count among the candidates and has no score; repeated rows count
each; rows of equal score and id are ranked by their number of features; an empty corpus gives an
empty table, an empty target gains from zero counts; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ranked
from . import kernels as K
from .common import cut, id_and_text, ship, text_slices, to_batch

PARTS = 16  #: parts of the buckets
TASK_BYTES = 32 << 20  #: of text whose postings of one part one task takes
SHORT = 64  #: bytes of a word that are hashed in step with the other words'

# Bytes of words: digits, letters and whatever is not ASCII.
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


def _crc_table() -> np.ndarray:
    return np.array([zlib.crc32(bytes([k])) ^ zlib.crc32(b"\0") for k in range(256)], np.uint32)


_CRC = _crc_table()


def crc_of_spans(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, state: np.ndarray) -> np.ndarray:
    """The CRC-32 register after raw[start:end], for each span from its state; bytes at one place of
    all spans are taken in one step."""
    order = np.argsort(starts - ends, kind="stable")  # the longest first
    at, left, out = starts[order], (ends - starts)[order], state[order]
    for j in range(min(SHORT, int(left[0]) if len(left) else 0)):
        m = int(np.searchsorted(-left, -j, "left"))  # spans with more than j bytes
        out[:m] = _CRC[(out[:m] ^ raw[at[:m] + j]) & 0xFF] ^ (out[:m] >> 8)
    for k in range(int(np.searchsorted(-left, -SHORT, "left"))):
        rest = raw[at[k] + SHORT : at[k] + left[k]].tobytes()
        out[k] = zlib.crc32(rest, int(out[k]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    back = np.empty_like(out)
    back[order] = out
    return back


def features(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(CRC-32 of every feature, its text, number of words of each text)."""
    raw = K._LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    edges = np.flatnonzero(np.diff(_WORD[raw], prepend=False))
    starts, ends = edges[::2], edges[1::2]
    bounds = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    own = K.owners(bounds)
    state = crc_of_spans(raw, starts, ends, np.full(len(starts), 0xFFFFFFFF, np.uint32))
    hashes, owners = [~state], [own]
    for size in range(2, n + 1):  # state: of the features one shorter, by the word they end with
        last = np.arange(size - 1, len(starts))
        last = last[own[last] == own[last - size + 1]]
        before = state[last - 1]
        before = _CRC[(before ^ 0x20) & 0xFF] ^ (before >> 8)
        state = np.zeros_like(state)
        state[last] = crc_of_spans(raw, starts[last], ends[last], before)
        hashes.append(~state[last])
        owners.append(own[last])
    return np.concatenate(hashes), np.concatenate(owners), np.diff(bounds)


_POSTINGS = pa.schema(
    [("block", pa.int64()), ("part", pa.int32()), ("buckets", pa.binary()), ("runs", pa.binary()), ("docs", pa.binary()), ("counts", pa.binary()), ("about", pa.binary())]
)
_POSTINGS_DDL = "block long, part int, buckets binary, runs binary, docs binary, counts binary, about binary"


@dataclass(frozen=True)
class Resampler:
    """Draws `percent` of the documents with at least `least_words` words."""

    n: int = 2
    buckets: int = 10_000
    percent: int = 25
    least_words: int = 20
    seed: str = "7:"

    # ---- corpora as buckets -------------------------------------------------------------

    def bucket_totals(self, texts: DataFrame) -> DataFrame:
        """(bucket, total) of a whole corpus: each task gives one row a bucket at most."""

        def run(batches):
            total = np.zeros(self.buckets, np.int64)
            for batch in batches:
                for _, some in text_slices(batch, 0):
                    total += np.bincount(features(some, self.n)[0] % np.uint32(self.buckets), minlength=self.buckets)
            held = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(total[held])], names=["bucket", "total"])

        return texts.mapInArrow(run, "bucket int, total long").groupBy("bucket").agg(F.sum("total").alias("total"))

    def postings(self, docs: DataFrame) -> DataFrame:
        """Of blocks of documents, a row for each part of the buckets: its buckets, how many postings
        each has, their documents (places in the block) and counts of at most 255 (a larger one is
        several postings). The row of part 0 tells about the documents: id, whether it is null,
        numbers of features and words."""

        def run(batches):
            task, k = TaskContext.get().partitionId(), 0
            wide = -(-self.buckets // PARTS)
            for batch in batches:
                for part, texts in text_slices(batch):
                    for at in range(0, len(texts), 1 << 16):
                        own, some = part.column(0).slice(at, 1 << 16), texts[at : at + (1 << 16)]
                        hashes, owner, n_words = features(some, self.n)
                        bucket = (hashes % np.uint32(self.buckets)).astype(np.int64)
                        place = bucket % PARTS * wide + bucket // PARTS  # by part, then by bucket
                        key, count = np.unique(place * len(some) + owner, return_counts=True)
                        pieces = -(-count // 255)
                        if (pieces > 1).any():
                            key, count, last = np.repeat(key, pieces), np.repeat(count, pieces), np.cumsum(pieces) - 1
                            rest = count[last] - 255 * (pieces - 1)
                            count = np.full(len(key), 255)
                            count[last] = rest
                        place, doc = key // len(some), key % len(some)
                        ids = own.fill_null(0).to_numpy(zero_copy_only=False)
                        about = np.stack([ids, own.is_null().to_numpy(zero_copy_only=False), np.bincount(owner, minlength=len(some)), n_words]).astype(np.int64)
                        ends = np.searchsorted(place, np.arange(1, PARTS + 1) * wide)
                        rows, start = [], 0
                        for p, end in enumerate(ends.tolist()):
                            held, runs = np.unique(place[start:end] - p * wide, return_counts=True)
                            packed = (held.astype(np.uint32), runs.astype(np.uint32), doc[start:end].astype(np.uint16), count[start:end].astype(np.uint8))
                            rows.append((task << 32 | k, p, *(x.tobytes() for x in packed), about.tobytes() if p == 0 else None))
                            start = end
                        yield to_batch([], rows, _POSTINGS)
                        k += 1

        return docs.mapInArrow(run, _POSTINGS_DDL)

    def _totals(self, docs: DataFrame, target: DataFrame) -> DataFrame:
        """(bucket, s, t): totals of both corpora side by side, for every bucket."""
        s = self.bucket_totals(docs.select("text")).withColumnRenamed("total", "s")
        t = self.bucket_totals(target.select("text")).withColumnRenamed("total", "t")
        every = docs.sparkSession.range(self.buckets).select(F.col("id").cast("int").alias("bucket"))
        return every.join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0)

    def _sizes(self, both: DataFrame) -> tuple[int, int]:
        row = both.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
        return row["s"], row["t"]

    def _gain(self, s: int, t: int, size_s: int, size_t: int) -> int:
        b = self.buckets
        return math.floor(1000 * math.log((t + 1.0) * (size_s + float(b)) / ((s + 1.0) * (size_t + float(b)))))

    # ---- weights --------------------------------------------------------------------------

    def weights(self, docs: DataFrame, target: DataFrame) -> DataFrame:
        """doc_id, n_words, n_features, weight of `id_and_text` rows."""
        spark = docs.sparkSession
        ship(spark)
        both = cut(self._totals(docs, target))
        size_s, size_t = self._sizes(both)
        size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
        shares = -(-8 * tasks // PARTS)  # several to a task, so that tasks are even
        wide = -(-self.buckets // PARTS)
        part = F.col("bucket") % PARTS
        totals = both.groupBy(part.cast("int").alias("part")).agg(F.collect_list(F.struct((F.col("bucket") / PARTS).cast("int").alias("k"), "s", "t")).alias("totals"))  # buckets / PARTS to a row
        totals = totals.select("part", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "totals")
        rows = self.postings(docs).withColumn("share", F.pmod(F.xxhash64("block"), F.lit(shares)).cast("int"))
        dealt = totals.unionByName(rows, allowMissingColumns=True).repartition(tasks, "part", "share")
        columns = ["part", "share", "block", "buckets", "runs", "docs", "counts", "about"]
        first = F.col("totals").isNull()
        dealt = dealt.sortWithinPartitions("part", "share", first).select(*columns, *(F.col(f"totals.{c}").alias(f"total_{c}") for c in "kst"))

        def contribute(batches):
            gain, of = np.zeros(wide), None
            for batch in batches:
                blocks, sums, abouts = [], [], []
                for p, share, block, held, runs, doc, count, about, k, s, t in zip(*batch.columns):
                    if k.is_valid:
                        gain, of = np.zeros(wide, np.int64), (p.as_py(), share.as_py())
                        gain[k.values.to_numpy()] = [self._gain(a, b, size_s, size_t) for a, b in zip(s.values.to_pylist(), t.values.to_pylist())]
                        continue
                    assert of == (p.as_py(), share.as_py())
                    read = lambda x, kind: np.frombuffer(x.as_buffer(), kind)
                    gains = np.repeat(gain[read(held, np.uint32)], read(runs, np.uint32)) * read(count, np.uint8)
                    place = read(doc, np.uint16).astype(np.int64)
                    total = np.zeros(int(place.max()) + 1 if len(place) else 0, np.int64)
                    np.add.at(total, place, gains)
                    blocks.append(block.as_py())
                    sums.append(total.tobytes())
                    abouts.append(about.as_py())
                yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), pa.array(sums, pa.binary()), pa.array(abouts, pa.binary())], names=["block", "sums", "about"])

        def reduce(table: pa.Table) -> pa.Table:
            """Of one block: its PARTS rows of sums, one of which tells about the documents."""
            about = next(x for x in table.column("about").to_pylist() if x is not None)
            ids, null, n_features, n_words = np.frombuffer(about, np.int64).reshape(4, -1)
            total = np.zeros(len(ids), np.int64)
            for x in table.column("sums").to_pylist():
                part = np.frombuffer(x, np.int64)
                total[: len(part)] += part
            weight = total // np.maximum(n_features, 1)
            return pa.table({"doc_id": pa.array(ids, mask=null.astype(bool)), "n_words": n_words, "n_features": n_features, "weight": weight})

        contributions = dealt.mapInArrow(contribute, "block long, sums binary, about binary")
        return contributions.groupBy("block").applyInArrow(reduce, "doc_id long, n_words long, n_features long, weight long")

    # ---- the draw ---------------------------------------------------------------------------

    def draw(self, docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
        """doc_id, n_words, n_features, weight, score, rank (null: not drawn) of every document."""
        own = id_and_text(docs, id_col, text_col)
        wanted = target.select(F.col(target_text_col).cast("string").alias("text"))
        h = F.conv(F.substring(F.sha2(F.concat(F.lit(self.seed), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("double")
        gumbel = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))
        scored = cut(self.weights(own, wanted).withColumn("score", F.col("weight") + gumbel))
        able = (F.col("n_words") >= self.least_words) & F.col("doc_id").isNotNull()
        number = scored.where(able).count() * self.percent // 100
        placed = ranked(scored.where(able), [], [F.col("score").desc(), "doc_id", "n_features"])
        drawn = placed.withColumn("rank", F.when(F.col("rank") < number, F.col("rank") + 1))
        rest = scored.where(~able).withColumn("rank", F.lit(None).cast("long"))
        return drawn.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
