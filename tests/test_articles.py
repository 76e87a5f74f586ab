import hashlib
import json
import random
import re
import statistics

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from quillmap.functions import text as T
from quillmap.functions.slices import SLICE, in_slices
from quillmap.operators import articles as A
from quillmap.plans import catalog

DUPLICATES = [
    ("article-c", "Exact duplicate", False, "too_short"),
    ("article-a", "Exact duplicate", True, None),
    ("article-b", "Exact duplicate", True, None),
    ("article-case-sensitive", "exact duplicate", True, None),
    ("article-trailing-space", "Exact duplicate ", True, None),
    ("article-unique", "Unique content", True, None),
]
SCHEMA = "article_id string, content string, is_valid boolean, cleaning_reason string"


def test_duplicates_keep_the_smallest_id(spark):
    df = spark.createDataFrame(DUPLICATES, SCHEMA)
    marked = A.mark_duplicates(df)
    got = {r["article_id"]: (r["is_valid"], r["cleaning_reason"]) for r in marked.collect()}
    assert got["article-c"] == got["article-b"] == (False, "duplicate")
    assert all(got[a] == (True, None) for a in ("article-a", "article-case-sensitive", "article-trailing-space", "article-unique"))
    assert sorted(r[0] for r in A.newly_duplicate(df).collect()) == ["article-b", "article-c"]
    assert A.newly_duplicate(marked).count() == 0
    with pytest.raises(ValueError, match="batch_size must be positive"):
        A.newly_duplicate(df, batch_size=0)


def test_split_articles(spark):
    text = "before\n# One\nbody a\nbody b\n## Two\n\n#\ntext\n#Three\n# Four\nlast"
    papers = [("n", text), ("m", "  no heading \n"), ("e", " "), ("c", "one\r\ntwo\u2028three\r\n"), ("s", "#\n text \n   # \n"), ("h", "a\n##\n   # \n"), (None, "# T\nx"), ("z", None), ("l", "# A\rx\x1cy\x0b# B\x85z")]
    rows = A.split_articles(spark.createDataFrame(papers, "newspaper_id string, content string")).collect()
    got = {(r["newspaper_id"], r["article_index"]): (r["title"], r["content"]) for r in rows}
    want = {("n", 0): ("One", "body a\nbody b"), ("n", 1): ("# Two", "text"), ("n", 2): ("Four", "last"), ("m", 0): (None, "no heading")}
    want |= {("c", 0): (None, "one\r\ntwo\u2028three"), (None, 0): ("T", "x"), ("l", 0): ("A", "x\ny"), ("l", 1): ("B", "z")}
    want |= {("s", 0): (None, "#\n text \n   #")}  # headings that say nothing; in "h", one says "#" and has no text
    assert got == want


def test_ids_are_those_of_sorted_json(spark):
    df = spark.createDataFrame([(0, 'Ž "quoted"\n', "n", None), (1, "b", "n", "T")], "i int, c string, n string, t string")
    got = [r[0] for r in df.select(A.article_id("i", "c", "n", "t")).collect()]
    for value, (i, c, n, t) in zip(got, [(0, 'Ž "quoted"\n', "n", None), (1, "b", "n", "T")]):
        record = json.dumps({"article_index": i, "content": c, "newspaper_id": n, "title": t}, sort_keys=True, ensure_ascii=False)
        assert value == "article_" + hashlib.sha256(record.encode()).hexdigest()[:24]


def test_python_holds_a_slice_of_a_batch(spark):
    """Ten thousand long texts were Python objects at once."""

    def held(texts):
        return [len(texts)] * len(texts)

    rows = spark.range(1_000).select(F.col("id").cast("string").alias("c")).coalesce(1)
    sizes = [r[0] for r in rows.select(in_slices(IntegerType(), pa.int32(), held)("c")).collect()]
    assert len(sizes) == 1_000 and max(sizes) <= SLICE
    ids = rows.select("c", A.article_id(F.lit(0), "c", "c", F.lit(None).cast("string")).alias("i")).collect()
    assert all(r["i"] == A._article_ids([0], [r["c"]], [r["c"]], [None])[0] for r in ids)


IMAGES = [
    ('Text ![a](x.jpg "t") more', "Text more"),
    ("![a](x.jpg)", ""),
    ("A [link](y.html) stays", "A [link](y.html) stays"),
    ("a ![](one.jpg) ![](two.jpg) b", "a b"),
    ("![a](p(1(2)).jpg) b", "b"),
    (r"a \![no](x.jpg)", r"a \![no](x.jpg)"),
    ("one ![](x.jpg)\ntwo", "one\ntwo"),
    ("First ![](images/scan.jpg) paragraph.", "First paragraph."),
]


def test_markdown_images(spark):
    df = spark.createDataFrame(IMAGES, "t string, want string").select(T.remove_markdown_images(F.col("t")).alias("got"), "want")
    assert [r["got"] for r in df.collect()] == [w for _, w in IMAGES]


def test_validation_cascade(spark):
    prose = "Parliament discussed several important questions yesterday evening. " * 12
    cases = [("ok", prose, None), ("short", "abc", "too_short"), ("few", "x" * 500, "too_few_words"), ("digits", "ab 12345 " * 100, "too_many_non_letters"), ("vowels", "brtk " * 100, "too_few_vowels"), ("words", "ab ie " * 100, "average_word_too_short"), ("null", None, "too_short")]
    got = {r["article_id"]: (r["cleaning_reason"], r["is_valid"]) for r in A.validate(spark.createDataFrame([c[:2] for c in cases], "article_id string, content string")).collect()}
    assert got == {name: (reason, reason is None) for name, _, reason in cases}


def structure(text):
    """The metrics in plain Python, with its own classes of characters and its own case folding."""
    words = lambda t: re.findall(r"[^\W\d_]+", t)
    parts = lambda pattern: [len(words(x)) for x in re.split(pattern, text.strip()) if x.strip()]
    own, pars, sents = words(text), parts(r"(?:\r?\n\s*){2,}"), parts(r"(?<=[.!?])\s+")
    lengths, n, tokens = [len(w) for w in own], len(text), len(text.split())
    letters, numbers = sum(c.isalpha() for c in text), sum(c.isnumeric() for c in text)
    specials = sum(not c.isalnum() and not c.isspace() for c in text)
    vowels = sum(c.casefold() in set("aeiou") for c in text if c.isalpha())
    ratio = lambda a, b: a / b if b else 0.0
    shape = lambda x: (ratio(sum(x), len(x)), max(x, default=0), ratio(sum(k <= 3 for k in x), len(x)))
    return (
        n, sum(not c.isspace() for c in text), letters, numbers, specials, len(own), tokens, len(pars), len(sents), *shape(pars), *shape(sents),
        ratio(sum(lengths), len(own)), statistics.median(lengths) if lengths else 0.0, max(lengths, default=0), ratio(tokens, len(own)), ratio(len({w.casefold() for w in own}), len(own)),
        ratio(letters, n), ratio(vowels, letters), ratio(numbers, n), ratio(specials, n), ratio(numbers + specials, n), (letters - vowels) / vowels if vowels else None,
        *(-(-tokens // k) for k in (32, 64, 128, 256)),
    )


TEXTS = [
    "First paragraph.", "One two. Three!\n\nFour? 12 ½ ² 五十 & co.\r\n \n\nŽodis straße STRASSE Straße ﬁt FIT", "ΣΑΣ σας ς İstanbul i̇x ǰ J\u030c", "brr tsk", " \n ", "%%% 123", "a_b c-d\u00a0e\u2003f\x1cg", "word " * 400,
]


def test_structure_against_python(spark):
    df = spark.createDataFrame([(k, t, "t", None) for k, t in enumerate(TEXTS)] + [(98, None, "t", True), (99, "", "t", True)], "article_id int, content string, title string, is_valid boolean")
    rows = {r["article_id"]: r for r in A.text_structure(df).collect()}
    assert sorted(rows) == list(range(len(TEXTS))) and rows[0]["title"] == "t" and rows[0]["is_valid"] is None
    for k, text in enumerate(TEXTS):
        names = [*A.METRICS, *(f"estimated_token_chunks_{n}" for n in (32, 64, 128, 256))]
        for name, want in zip(names, structure(text), strict=True):
            assert rows[k][name] == (None if want is None else pytest.approx(want)), (text, name)
    r = A.text_structure(spark.createDataFrame([(1, "First ![](images/scan.jpg) paragraph.")], "article_id int, content string")).first()
    assert (r["characters"], r["words"], r["tokens"]) == (16, 2, 2)
    with pytest.raises(ValueError):
        A.text_structure(spark.createDataFrame([], "article_id int, content string"), sizes=(32, 32))


def test_structure_of_odd_characters_against_python(spark):
    rng = random.Random(11)
    odd = ["w", "W", "ww", "ß", "ẞ", "ſ", "ŉ", "ǰ", "İ", "i̇", "ς", "Σ", "µ", "ﬁ", "Ⅳ", "½", "²", "五", "\U00020001", "é", "É", "ж", "7", "٣", "_", "-", "\u0345", " ", " ", "\u00a0", "\n", "\r\n", "\n\n", ". ", "! ", "?", "\x1c"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.choice([1, 3, 10, 60]))) for _ in range(400)]
    rows = {r["k"]: r for r in A.text_structure(spark.createDataFrame(list(enumerate(texts)), "k int, t string"), "k", "t").collect()}
    names = [*A.METRICS, *(f"estimated_token_chunks_{n}" for n in (32, 64, 128, 256))]
    for k, text in enumerate(texts):
        for name, want in zip(names, structure(text), strict=True):
            assert rows[k][name] == (None if want is None else pytest.approx(want)), (text, name)


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_taken_from_a_text_once(spark):
    df = spark.createDataFrame([(1, "a b")], "article_id int, content string").repartition(2)
    assert _plan(A.text_structure(df)).count("regexp_extract_all(t#") == 1


def test_cleaning_takes_no_words_from_texts(spark, sf_dir):
    assert "regexp_extract_all" not in _plan(catalog._structured(spark, sf_dir))


def test_words(spark):
    df = spark.createDataFrame([("One two 123",), ("Žodis—kitas, third!",), ("Four_words",), ("",)], "t string")
    assert [r[0] for r in df.select(F.size(T.words(F.col("t")))).collect()] == [2, 3, 2, 0]


def test_metric_summary_against_python(spark):
    values = [1.0, 2.0, 4.0, 8.0, 16.0, None]
    df = spark.createDataFrame([(v,) for v in values], "m double")
    r = A.metric_summary(df, ["m"]).first()
    x = [v for v in values if v is not None]
    assert (r["count"], r["median"], r["q1"], r["q3"], r["median_absolute_deviation"]) == (5, 4.0, 2.0, 8.0, 3.0)
    assert r["standard_deviation"] == pytest.approx(statistics.pstdev(x))
    assert r["robust_upper_fence"] == pytest.approx(4 + 3 * 1.4826 * 3) and r["iqr_lower_fence"] == 2 - 1.5 * 6


def test_outliers_need_two_reasons(spark):
    rows = [(k, 0.8 + 0.001 * (k % 7), 0.4 + 0.001 * (k % 5), 5.0 + 0.01 * (k % 11), 1.0 + 0.01 * (k % 3), 0.01, True) for k in range(40)]
    rows += [(100, 0.1, 0.4, 5.0, 9.0, 0.01, True), (101, 0.1, 0.4, 5.0, 1.0, 0.01, True), (102, 0.8, 0.4, 5.0, 1.0, 0.5, True), (103, 0.1, 0.4, 5.0, 9.0, 0.5, False)]
    df = spark.createDataFrame(rows, "article_id int, letter_character_ratio double, vowel_letter_ratio double, mean_characters_per_word double, tokens_per_word double, numeric_or_special_character_ratio double, is_valid boolean")
    judged = A.classify_outliers(df)
    got = {r["article_id"]: r["reasons"] for r in judged.where("invalidate").collect()}
    assert got == {100: "outlier_low_letter_character_ratio;outlier_high_tokens_per_word", 102: "numeric_or_special_ratio_above_limit"}
    report = {r["article_id"]: (r["was_valid"], r["would_invalidate"]) for r in A.cleaning_report(judged).where("article_id > 99").collect()}
    assert report == {100: (1, 1), 101: (1, 0), 102: (1, 1), 103: (0, 0)}
    with pytest.raises(ValueError):
        A.classify_outliers(df.where("article_id < 0"))


def test_propagation(spark):
    articles = spark.createDataFrame([("v", True), ("i", False), ("n", None)], "article_id string, is_valid boolean")
    chunks = spark.createDataFrame([("cv", "v"), ("ci", "i"), ("cn", "n")], "chunk_id string, article_id string")
    embeddings = spark.createDataFrame([("ev", "cv"), ("ei", "ci"), ("en", "cn")], "embedding_id string, chunk_id string").withColumn("is_valid", F.lit(True))
    out = A.propagate_validation(embeddings, chunks, articles)
    assert {r["embedding_id"]: r["is_valid"] for r in out.collect()} == {"ev": True, "ei": False, "en": False}
    assert tuple(A.propagation_counts(out).first()) == (3, 1, 2)


def test_all_white_space_ends_sentences_and_paragraphs(spark):
    """As Python's re splits, whatever white space is behind a full stop or in a blank line."""
    spaces = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
    rng = random.Random(9)
    texts = ["One.\u00a0Two.\u2003Three. Four"] + [f"One.{c}Two!{c}{c} Three\n{c}\nfour" for c in spaces]
    texts += ["".join(rng.choice([*spaces, "\n", "\r\n", ". ", "!", "?", "word", "x"]) for _ in range(40)) for _ in range(200)]
    parts = lambda t, pattern: [p.strip() for p in re.split(pattern, t.strip()) if p.strip()]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    for r in df.select("t", T.sentences(F.col("t")).alias("s"), T.paragraphs(F.col("t")).alias("p")).collect():
        assert r["s"] == parts(r["t"], r"(?<=[.!?])\s+") and r["p"] == parts(r["t"], r"(?:\r?\n\s*){2,}")
