"""Quality classifier: a byte-level convolutional network in numpy.

Bytes have learned vectors; learned filters run over overlapping windows of bytes in steps; the
windows of a document fall into chunks, whose windows overlap their neighbours', so that no byte of
the whole text is left out. The largest response in each chunk is rectified; a document's largest
and mean chunk response for each filter, with the log of its length, are combined into one
probability by a logistic layer. Training is Adam on log loss over a bounded sample of labelled
documents; scoring is one pass over the corpus with the weights in the closure.

Defined results: a null text counts as empty, and an empty one is a chunk of zero bytes; equal
texts get equal scores; without labelled documents of both kinds every score is the share of good
ones, or 0.5; an id counts once in training, with its smallest label and text, however often it
comes in either table; null labels and labels without a document don't count; an empty table gives
an empty table; other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, ship, text_slices

DIM, WIDTH, STEP, FILTERS = 8, 8, 4, 32
CHUNK = 128  #: windows to a chunk: 512 bytes and the overlap
PIECE = 512  #: chunks that are scored at once


@dataclass(frozen=True)
class Training:
    """Parameters. `documents` and `most_bytes` bound the sample of labelled documents: the first
    in a seeded order among those of up to `most_bytes`, whole texts."""

    documents: int = 4_000
    most_bytes: int = 65_536
    steps: int = 500  #: updates; a small sample is gone through more often
    batch: int = 32
    rate: float = 0.01
    seed: int = 7
    threshold: float = 0.3
    folds: int = 5  #: documents with crc32(id) mod folds = 0 are held out


@dataclass
class Model:
    """Weights of the network; `prior` alone decides if it has none."""

    prior: float = 0.5
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    def features(self, text: bytes) -> np.ndarray:
        """Largest and mean chunk responses, and the length."""
        w = self.weights
        largest, total, chunks = np.zeros(FILTERS, np.float32), np.zeros(FILTERS, np.float64), 0
        for part in _pieces(text):
            top = _responses(part, w)[0]
            np.maximum(largest, top.max(0), out=largest)
            total += top.sum(0)
            chunks += len(top)
        return np.concatenate([largest, total / chunks, [_length(text)]])

    def score(self, text: bytes) -> float:
        if not self.weights:
            return self.prior
        z = float(self.features(text) @ self.weights["out"] + self.weights["bias"][0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _length(text: bytes) -> float:
    return math.log1p(len(text)) / 10


def _pieces(text: bytes):
    """Whole chunks of bytes with the overlap that their last windows need; zeros at the end."""
    span = CHUNK * STEP
    n = max(1, -(-len(text) // span))
    raw = np.zeros(n * span + WIDTH - STEP, np.uint8)
    raw[: len(text)] = np.frombuffer(text, np.uint8)
    for k in range(0, n, PIECE):
        yield raw[k * span : min(n, k + PIECE) * span + WIDTH - STEP]


def _responses(raw: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(rectified largest response of each chunk and filter, response of every window)."""
    flat = w["bytes"][raw].reshape(-1)
    n = (len(raw) - WIDTH + STEP) // STEP
    windows = np.lib.stride_tricks.as_strided(flat, (n, WIDTH * DIM), (STEP * DIM * 4, 4), writeable=False)
    out = (np.ascontiguousarray(windows) @ w["filters"]).reshape(-1, CHUNK, FILTERS)
    return np.maximum(out.max(1) + w["offset"], 0), out


def _start(rng: np.random.Generator) -> dict[str, np.ndarray]:
    f32 = np.float32
    return {
        "bytes": rng.normal(0, 0.5, (256, DIM)).astype(f32),
        "filters": rng.normal(0, 1 / math.sqrt(WIDTH * DIM), (WIDTH * DIM, FILTERS)).astype(f32),
        "offset": np.zeros(FILTERS, f32),
        "out": rng.normal(0, 0.1, 2 * FILTERS + 1).astype(f32),
        "bias": np.zeros(1, f32),
    }


def _gradients(w: dict[str, np.ndarray], text: bytes, label: float) -> dict[str, np.ndarray]:
    """Of the log loss of one document. Only the windows with the largest responses count."""
    tops, bests, parts = [], [], []
    for raw in _pieces(text):
        top, out = _responses(raw, w)
        tops.append(top)
        bests.append(out.argmax(1))
        parts.append(raw)
    top = np.concatenate(tops)
    best = np.concatenate(bests)
    largest, at = top.max(0), top.argmax(0)
    x = np.concatenate([largest, top.mean(0), [_length(text)]]).astype(np.float32)
    z = float(x @ w["out"] + w["bias"][0])
    d = 1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - label
    back = np.repeat((d * w["out"][FILTERS : 2 * FILTERS] / len(top))[None, :], len(top), 0)
    back[at, np.arange(FILTERS)] += d * w["out"][:FILTERS]
    back *= top > 0
    raw = np.concatenate([p[: len(p) - (WIDTH - STEP)] for p in parts] + [parts[-1][len(parts[-1]) - (WIDTH - STEP) :]])
    chunk, filt = np.nonzero(back)
    g = back[chunk, filt].astype(np.float32)
    first = (chunk * CHUNK + best[chunk, filt]) * STEP
    seen = raw[first[:, None] + np.arange(WIDTH)]
    patches = w["bytes"][seen].reshape(len(g), -1)
    filters = np.zeros_like(w["filters"])
    np.add.at(filters.T, filt, patches * g[:, None])
    embed = np.zeros_like(w["bytes"])
    np.add.at(embed, seen, (w["filters"].T[filt] * g[:, None]).reshape(len(g), WIDTH, DIM))
    return {"bytes": embed, "filters": filters, "offset": back.sum(0), "out": d * x, "bias": np.array([d])}


def fit(texts: list[bytes], labels: list[int], training: Training = Training()) -> Model:
    """Train on whole texts; the same input gives the same model."""
    if not texts:
        return Model()
    prior = sum(labels) / len(labels)
    if prior in (0, 1):
        return Model(prior)
    rng = np.random.default_rng(training.seed)
    w = _start(rng)
    w["bias"][0] = math.log(prior / (1 - prior))
    first, second = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2))
    per = -(-len(texts) // training.batch)
    epochs = max(1, -(-training.steps // per))
    steps, total = 0, epochs * per
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), training.batch):
            some = order[at : at + training.batch]
            sums = {k: np.zeros_like(v) for k, v in w.items()}
            for k in some:
                for name, g in _gradients(w, texts[k], labels[k]).items():
                    sums[name] += g
            steps += 1
            rate = training.rate * (1 - 0.9 * steps / total)
            for name, g in sums.items():
                g = g / len(some)
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                w[name] -= (rate * (first[name] / (1 - 0.9**steps)) / (np.sqrt(second[name] / (1 - 0.99**steps)) + 1e-8)).astype(np.float32)
    return Model(prior, w)


def held_out(doc_id, folds: int):
    """Whether a row is never learned from. A null id counts as the text "null"."""
    return F.pmod(F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("null")), "UTF-8")), F.lit(folds)) == 0


def train(docs: DataFrame, labels: DataFrame, training: Training = Training(), label_col: str = "quality") -> Model:
    """Fit on a bounded sample of the labelled documents that aren't held out: at most
    `training.documents` texts of up to `training.most_bytes` reach the driver. Labels and ids of
    fitting documents are joined first, so labels without one take no place in the sample."""
    learnt = F.col("doc_id").isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col("doc_id"), training.folds)
    named = labels.where(learnt).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    named = named.groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = id_and_text(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.where(F.octet_length("text") <= training.most_bytes)
    order = F.xxhash64(F.lit(training.seed), "doc_id")
    some = named.join(texts.select("doc_id").distinct(), "doc_id").orderBy(order, "doc_id").limit(training.documents)
    sample = texts.join(F.broadcast(some), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = sorted(sample.collect(), key=lambda r: r["doc_id"])
    return fit([r["text"].encode() for r in rows], [r["label"] for r in rows], training)


def score(docs: DataFrame, model: Model, training: Training = Training()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row, from the whole text alone."""
    ship(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part, texts in text_slices(batch):
                scores = pa.array([model.score(x) for x in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(0), scores], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id"), training.folds).alias("held_out"), "score", (F.col("score") >= training.threshold).cast("int").alias("predicted"))
