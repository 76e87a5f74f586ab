import collections
import itertools
import random
import re

import numpy as np
import pytest

from quillmap.llm import kernels as K
from quillmap.llm import minhash, stars
from quillmap.operators import joins

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, size=2):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset([tuple(w)] if 0 < len(w) < size else (tuple(w[k : k + size]) for k in range(len(w) - size + 1)))


def expected(rows, percent=80, size=2):
    """(doc_id, n_shingles, component_id, kept) by all pairs; each row of an id keeps its own set."""
    sets = [shingles(t, size) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations([k for k, (i, _) in enumerate(rows) if i is not None and sets[k]], 2):
        both = len(sets[a] & sets[b])
        if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    out = []
    for k, (i, _) in enumerate(rows):
        component = None if i is None else least[find(k)] if sets[k] else i
        out.append((i, len(sets[k]), component, None if i is None else i == component))
    return collections.Counter(out)


def found(df, **more):
    return collections.Counter(tuple(r) for r in minhash.MinHash(df, **more).members().drop("class_id").collect())


def test_odd_rows(odd_docs):
    rows = [(r[0], r[1]) for r in odd_docs.collect()]
    assert found(odd_docs) == expected(rows)


def test_no_rows(no_docs):
    assert minhash.MinHash(no_docs).members().collect() == []


def near_copies(rng, base, n, changes):
    for _ in range(n):
        words = list(base)
        for k in rng.sample(range(len(words)), rng.randrange(*changes)):
            words[k] = f"x{rng.randrange(10**6)}"
        yield " ".join(words)


def test_groups_of_near_copies_on_both_sides_of_the_threshold(spark):
    rng = random.Random(3)
    vocabulary = [f"w{k}" for k in range(3_000)]
    texts = []
    for size, n, changes in ((100, 120, (0, 12)), (60, 60, (2, 9)), (30, 40, (1, 4)), (7, 30, (0, 2))):
        texts += near_copies(rng, [rng.choice(vocabulary) for _ in range(size)], n, changes)
    texts += [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 150))) for _ in range(150)]
    texts += rng.sample(texts, 80)
    rng.shuffle(texts)
    rows = list(enumerate(texts, 5))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)) == expected(rows)


def test_small_chunks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(minhash, "CHUNK", 16)
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 12_000)
    monkeypatch.setattr(minhash, "TASK_BYTES", 40_000)
    monkeypatch.setattr(joins, "SHARE", 10)
    rng = random.Random(4)
    base = [f"w{k}" for k in range(90)]
    texts = [*near_copies(rng, base, 150, (3, 14)), *near_copies(rng, base[:40] + [f"v{k}" for k in range(50)], 60, (3, 12))]
    rows = list(enumerate(texts))
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == expected(rows)


def test_shares_of_minima_are_similarities():
    family = minhash.Family()
    rng = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8):
        errors = []
        for n in (40, 400, 4_000, 70_000):
            both = int(n * share)
            x = np.unique(K.mix(rng.integers(0, 1 << 63, 2 * n - both, np.uint64)))
            a, b = family.minima([x[:n], x[-n:]])
            errors.append((a == b).mean() - both / (len(x)))
        assert abs(np.mean(errors)) < 0.03 and np.abs(errors).max() < 0.12


def test_minima_by_the_definition():
    family = minhash.Family(rows=2, bands=3)
    a, b = family.drawn()
    rng = np.random.default_rng(2)
    sets = [rng.integers(0, 1 << 63, n, np.uint64) for n in (1, 5, 40_000, 3, 70_000)]
    want = [[min((int(p) * int(t) + int(q)) % (1 << 64) for t in (K.mix(s[:300]) >> K.U(32)).tolist()) >> 24 & 0xFFFF for p, q in zip(a, b)] for s in sets[:2]]
    got = family.minima(sets)
    assert got[:2].tolist() == want
    alone = np.concatenate([family.minima([s]) for s in sets])
    assert (alone == got).all()


def test_keys_tell_bands_apart():
    family = minhash.Family()
    keys = family.keys(np.zeros((2, family.size), np.uint16))
    assert (keys[0] == keys[1]).all() and len(set(keys[0].tolist())) == family.bands
    assert ((keys[0] & K.U(63)) == np.arange(family.bands)).all()


def test_what_the_bands_miss():
    family = minhash.Family()
    assert (1 - 0.8**family.rows) ** family.bands < 3e-7
    with pytest.raises(ValueError):
        minhash.MinHash(None, family=minhash.Family(rows=1, bands=65))


@pytest.mark.parametrize("part", [7, 10**6])
@pytest.mark.parametrize("shape", ["star", "path", "several", "none"])
def test_components_with_hubs(spark, monkeypatch, shape, part):
    monkeypatch.setattr(joins, "SHARE", 5)
    monkeypatch.setattr(stars, "PART", part)
    edges = {"star": [(0, k) for k in range(1, 60)] + [(k, 99) for k in range(50, 60)], "path": [(k, k + 1) for k in range(0, 40)], "several": [(1, 2), (2, 3), (10, 11), (11, 12), (12, 10), (7, 8)], "none": []}[shape]
    got = {r["rep"]: r["label"] for r in stars.components(spark.createDataFrame(edges, "a long, b long").repartition(5)).collect()}
    root = {}
    for a, b in edges:
        root.setdefault(a, a), root.setdefault(b, b)
    for _ in range(len(root)):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {k: v for k, v in root.items() if k != v}
