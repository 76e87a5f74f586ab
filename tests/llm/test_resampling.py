import collections
import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmap.llm import resampling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def buckets(text, n=2, modulus=10_000):
    w = words(text)
    runs = [" ".join(w[k : k + size]) for size in range(1, n + 1) for k in range(len(w) - size + 1)]
    return [zlib.crc32(r.encode()) % modulus for r in runs]


def expected(rows, target, percent=25, least=20, **more):
    s, t = collections.Counter(), collections.Counter()
    for _, text in rows:
        s.update(buckets(text, **more))
    for text in target:
        t.update(buckets(text, **more))
    m = more.get("modulus", 10_000)
    n_s, n_t = s.total(), t.total()
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (n_s + m) / ((s[b] + 1) * (n_t + m)))) for b in s}
    out = []
    for i, text in rows:
        own = buckets(text, **more)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([i, len(words(text)), len(own), weight, score, None])
    able = sorted((r for r in out if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return collections.Counter(map(tuple, out))


def drawn(df, target, **more):
    return collections.Counter(tuple(r) for r in resampling.Resampler(**more).draw(df, target).collect())


@pytest.fixture(scope="module")
def target(spark):
    texts = ["word1 word2 word3 WORD4, word5", None, "", "word7 word8 word7 word8", "Größe 漢字 und x-y_z 12a"]
    return spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "item_id long, text string, block long")


def test_odd_rows(odd_docs, target):
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert drawn(odd_docs, target) == expected(rows, [r["text"] for r in target.collect()])


def test_empty_tables(odd_docs, no_docs, target):
    assert not drawn(no_docs, target)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    assert drawn(odd_docs, target.where("false")) == expected(rows, [])


def test_other_sizes_and_many_shares(odd_docs, target, monkeypatch):
    monkeypatch.setattr(resampling, "TASK_BYTES", 4_000)
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    got = drawn(odd_docs, target, n=3, buckets=97, percent=60, least_words=5)
    assert got == expected(rows, [r["text"] for r in target.collect()], percent=60, least=5, n=3, modulus=97)


def test_one_word_in_all_documents_and_counts_above_a_byte(spark, target):
    rows = [(k, "word1 " * (k % 7 * 150) + "other") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert drawn(df, target) == expected(rows, [r["text"] for r in target.collect()])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aZ9é漢 \n,-\0", max_size=40), min_size=1, max_size=5))
def test_features_are_those_of_the_pattern(texts):
    hashes, owner, n_words = resampling.features([t.encode() for t in texts], 2)
    assert n_words.tolist() == [len(words(t)) for t in texts]
    for k, t in enumerate(texts):
        assert sorted((hashes[owner == k] % 10_000).tolist()) == sorted(buckets(t))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=200), max_size=8), st.binary(max_size=5))
def test_checksums_of_spans(parts, before):
    raw = np.frombuffer(b"".join(parts), np.uint8)
    ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
    starts = ends - np.array([len(p) for p in parts], np.int64)
    state = np.full(len(parts), zlib.crc32(before) ^ 0xFFFFFFFF, np.uint32)
    got = resampling.crc_of_spans(raw, starts, ends, state) ^ np.uint32(0xFFFFFFFF)
    assert got.tolist() == [zlib.crc32(p, zlib.crc32(before)) for p in parts]


def test_draws_lean_to_the_target(spark):
    rows = [(k, ("apple pear plum " if k % 2 else "bolt nut screw ") * 10) for k in range(400)]
    goal = spark.createDataFrame([("apple pear plum " * 2_000,)], "text string")
    out = resampling.Resampler().draw(spark.createDataFrame(rows, "doc_id long, text string"), goal).where("rank is not null").collect()
    assert len(out) == 100 and sum(r["doc_id"] % 2 for r in out) > 90
