import random

import pytest

#: Columns that clash with names that operators use inside.
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, token string, rank int, label int, size int, bucket int, order int, block int, n int, `key` string"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing names."""
    rng = random.Random(5)
    vocabulary = ["word%d" % k for k in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n)) + "."
    base = prose(120)
    words = base.split()
    near = " ".join(words[:50] + ["changed"] + words[51:])
    passage = prose(60)
    texts = [
        (0, base, "s1"), (1, base, "s2"), (2, near, "s1"), (3, prose(40) + " " + passage + " " + prose(40), "s1"), (4, prose(30) + "\n" + passage, None), (5, None, "s1"), (6, "", "s2"), (7, " \t\n\x0b\x0c\r ", "s2"),
        (8, "one two three", "s3"), (9, "One TWO three", "s3"), (10, "a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a a", "s1"), (None, base, "s1"), (None, None, None),
        (11, prose(30_000), "s4"), (11, "same id, other text", "s4"), (12, "x" * 50_000, "s4"), (13, "nul\0 and   odd  spaces \x1c here ÉÀ 漢字 🙂", "s4"), (0, base, "s1"),
    ]
    texts += [(100 + k, prose(rng.randrange(1, 200)), f"s{k % 5}") for k in range(60)]
    rows = [(i, t, None if i == 3 else "en", s, None if t is None else len(t), "t", 1, 2, 3, 4, 5, 6, 7, "k") for i, t, s in texts]
    return spark.createDataFrame(rows, EXTRA).repartition(3).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], EXTRA)
