"""Articles: splitting, ids, validation, duplicates, text structure, statistical cleaning."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import StringType

from ..functions import text as T
from ..functions.slices import in_slices
from ..sources.steps import cut
from .joins import salted_join
from .selection import median, percentiles

# Limits of the validation cascade and of the statistical cleaning.
MIN_CHARACTERS, MIN_WORDS = 400, 80
MIN_LETTER_RATIO, MIN_VOWEL_RATIO, MIN_WORD_LENGTH = 0.60, 0.25, 3.5
MAX_NUMERIC_OR_SPECIAL, MAD_MULTIPLIER, MAD_SCALE, MIN_OUTLIERS = 0.10, 4.5, 1.4826, 2
OUTLIER_DIRECTIONS = {
    "letter_character_ratio": ("low",),
    "vowel_letter_ratio": ("low", "high"),
    "mean_characters_per_word": ("low", "high"),
    "tokens_per_word": ("high",),
}
HEAVY_METRIC, HEAVY_REASON = "numeric_or_special_character_ratio", "numeric_or_special_ratio_above_limit"
JUDGED = (HEAVY_METRIC, *OUTLIER_DIRECTIONS)  #: all that cleaning reads of a structure; it is written, so select these before
# The metrics of a text's structure, in the order of the result.
METRICS = (
    "characters", "non_whitespace_characters", "letters", "numeric_characters", "special_symbol_characters", "words", "tokens", "paragraphs", "sentences",
    "mean_words_per_paragraph", "max_words_per_paragraph", "short_paragraph_ratio", "mean_words_per_sentence", "max_words_per_sentence", "short_sentence_ratio",
    "mean_characters_per_word", "median_characters_per_word", "max_characters_per_word", "tokens_per_word", "type_token_ratio",
    "letter_character_ratio", "vowel_letter_ratio", "numeric_character_ratio", "special_symbol_character_ratio", "numeric_or_special_character_ratio", "consonant_vowel_ratio",
)
LABELS = ("title", "is_valid", "cleaning_reason")

HEADING = f"^{T.SPACE_CLASS}{{0,3}}#(.*)$"


def split_articles(newspapers: DataFrame) -> DataFrame:
    """newspaper_id, article_index, title, content from newspaper_id, content. Every line that
    begins with a number sign and says something opens an article; those that say nothing are left
    out; text before the first is dropped, as are articles without text. A newspaper without such a
    line is one article without a title: its text as it is, stripped. One expression over a row:
    newspapers are neither shuffled nor put together again."""
    text = T.text_or_empty(F.col("content"))
    lines = newspapers.select("newspaper_id", T.strip(text).alias("whole"), F.split(text, T.LINE_BREAK).alias("lines"))

    def marked(line: Column, k: Column) -> Column:
        title = F.when(line.rlike(HEADING), T.strip(F.regexp_extract(line, HEADING, 1)))
        return F.struct(k.alias("k"), line.alias("line"), title.alias("title"))

    lines = lines.select("newspaper_id", "whole", F.transform("lines", marked).alias("lines"))
    marks, rest = F.filter("lines", lambda x: x["title"].isNotNull()), F.filter("lines", lambda x: x["title"].isNull())
    lines = lines.select("newspaper_id", "whole", marks.alias("marks"), F.transform(rest, lambda x: x["line"]).alias("body"))
    # of the lines before the m-th mark, m are marks, and the others come before its article's body
    heads = F.transform("marks", lambda x, m: F.struct(x["title"].alias("title"), (x["k"] - m).alias("first")))
    lines = lines.select("newspaper_id", "whole", "body", F.filter(heads, lambda x: x["title"] != "").alias("heads"))

    def article(x: Column, k: Column) -> Column:
        end = F.coalesce(F.get("heads", k + 1)["first"], F.size("body"))
        below = F.slice("body", x["first"] + 1, end - x["first"])
        return F.struct(x["title"].alias("title"), T.strip(F.array_join(below, "\n")).alias("content"))

    parts = F.filter(F.transform("heads", article), lambda x: x["content"] != "")
    alone = F.array(F.struct(F.lit(None).cast("string").alias("title"), F.col("whole").alias("content")))
    some = F.when(F.size("heads") > 0, parts).when(F.col("whole") != "", alone)
    return lines.select("newspaper_id", F.posexplode(some).alias("article_index", "a")).select("newspaper_id", "article_index", "a.title", "a.content")


def _hashed(prefix: str, record: dict) -> str:
    return prefix + hashlib.sha256(json.dumps(record, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:24]


def newspaper_id(stem: Column) -> Column:
    return F.concat(F.lit("newspaper_"), F.substring(F.sha2(stem, 256), 1, 24))


def _article_ids(index: list, content: list, newspaper: list, title: list) -> list[str]:
    rows = zip(index, content, newspaper, title)
    return [_hashed("article_", {"article_index": int(i), "content": c, "newspaper_id": n, "title": t}) for i, c, n, t in rows]


def _chunk_ids(article: list, index: list, run: list, text: list) -> list[str]:
    return [_hashed("chunk_", {"article_id": a, "chunk_index": int(i), "chunking_run_id": r, "text": t}) for a, i, r, t in zip(article, index, run, text)]


article_id = in_slices(StringType(), pa.string(), _article_ids)
chunk_id = in_slices(StringType(), pa.string(), _chunk_ids)


def validation_metrics(content: Column) -> dict[str, Column]:
    clean = T.remove_markdown_images(T.text_or_empty(content))
    return {
        "n_chars": F.length(clean),
        "n_words": F.size(T.words(clean)),
        "letter_ratio": T.letter_ratio(clean),
        "vowel_ratio": T.vowel_ratio(clean),
        "average_word_length": T.average_word_length(clean),
    }


def validate(articles: DataFrame, content_col: str = "content") -> DataFrame:
    """Add is_valid and cleaning_reason: the first limit that an article misses, null if none."""
    m = {k: F.col(f"_v.{k}") for k in validation_metrics(F.col(content_col))}
    with_metrics = articles.withColumn("_v", F.struct(*[c.alias(k) for k, c in validation_metrics(F.col(content_col)).items()]))
    reason = (
        F.when(m["n_chars"] < MIN_CHARACTERS, "too_short")
        .when(m["n_words"] < MIN_WORDS, "too_few_words")
        .when(m["letter_ratio"] < MIN_LETTER_RATIO, "too_many_non_letters")
        .when(m["vowel_ratio"] < MIN_VOWEL_RATIO, "too_few_vowels")
        .when(m["average_word_length"] < MIN_WORD_LENGTH, "average_word_too_short")
    )
    return with_metrics.withColumn("cleaning_reason", reason).withColumn("is_valid", F.col("cleaning_reason").isNull()).drop("_v")


def validation_counts(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count("*").alias("n_articles"), F.count_if("is_valid").alias("n_valid"), F.count_if(~F.col("is_valid")).alias("n_invalid"))


BROADCAST_IDS = 1_000_000  #: ids of duplicates that are sent to all tasks; more are joined by their key


def content_groups(articles: DataFrame, id_col: str = "article_id", content_col: str = "content") -> DataFrame:
    """_digest, _first (smallest id), n_rows of each content; null contents have none. Also of a
    stream: the aggregate is combined before the shuffle, and its state is these rows."""
    keyed = articles.where(F.col(content_col).isNotNull()).select(_digest(content_col), F.col(id_col).alias("_id"))
    return keyed.groupBy("_digest").agg(F.min("_id").alias("_first"), F.count("*").alias("n_rows"))


def _digest(content_col: str) -> Column:
    return F.unhex(F.sha2(F.col(content_col), 256)).alias("_digest")


def duplicate_ids(articles: DataFrame, groups: DataFrame, id_col: str = "article_id", content_col: str = "content") -> DataFrame:
    """Ids of the articles that aren't the first of their content. What is shuffled is digests and ids;
    a content that many articles have is dealt over many tasks."""
    several = cut(groups.where("n_rows > 1"))
    keyed = articles.where(F.col(content_col).isNotNull()).select(_digest(content_col), F.col(id_col))
    joined = salted_join(keyed, several.select("_digest", "_first"), ["_digest"], id_col, several)
    return joined.where(F.col(id_col) != F.col("_first")).select(id_col)


def mark_duplicates(articles: DataFrame, id_col: str = "article_id", content_col: str = "content", groups: DataFrame | None = None) -> DataFrame:
    """Of articles with the same content, all but the one with the smallest id become invalid with
    the reason duplicate, whatever their reason was. 256 bits of digest stand for a content. The
    articles themselves aren't shuffled while the duplicates' ids are up to `BROADCAST_IDS`. groups:
    what `content_groups` says, if it is known."""
    groups = content_groups(articles, id_col, content_col) if groups is None else groups
    found = cut(duplicate_ids(articles, groups, id_col, content_col).distinct().withColumn("_again", F.lit(True)))
    joined = articles.join(F.broadcast(found) if found.count() <= BROADCAST_IDS else found, id_col, "left")
    again = F.coalesce("_again", F.lit(False))
    out = joined.withColumn("is_valid", F.when(again, F.lit(False)).otherwise(F.col("is_valid")))
    return out.withColumn("cleaning_reason", F.when(again, F.lit("duplicate")).otherwise(F.col("cleaning_reason"))).select(*articles.columns)


def newly_duplicate(articles: DataFrame, id_col: str = "article_id", content_col: str = "content", batch_size: int = 10_000) -> DataFrame:
    """Ids that `mark_duplicates` would change; those marked before aren't among them."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    groups = content_groups(articles, id_col, content_col)
    fresh = articles.where(~F.col("cleaning_reason").eqNullSafe(F.lit("duplicate")))
    return duplicate_ids(fresh, groups, id_col, content_col)


def _middle(ordered: Column) -> Column:
    """The median of an ordered array."""
    n = F.size(ordered)
    return (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2.0


def text_structure(
    articles: DataFrame,
    id_col: str = "article_id",
    content_col: str = "content",
    tokenizer: T.Tokenizer = T.whitespace_tokens,
    sizes: tuple[int, ...] = T.TOKEN_SIZES,
) -> DataFrame:
    """One row of metrics for each article that isn't empty, with its title, validity and reason as
    far as there are such columns. One pass without a shuffle, in steps, so that what several
    metrics need is computed once."""
    if not sizes or min(sizes) < 1 or len(set(sizes)) != len(sizes):
        raise ValueError("token sizes must be positive and without duplicates")
    labels = [c for c in LABELS if c in articles.columns]
    text = T.remove_markdown_images(F.col(content_col))
    base = articles.where(F.length(F.coalesce(F.col(content_col), F.lit(""))) > 0).select(F.col(id_col), *labels, text.alias("t"))
    t, letters, m = F.col("t"), F.col("l"), F.col("m")
    lengths = lambda parts: F.transform(parts, T.marks)
    base = base.select("*", F.length(t).alias("n"), T.letters_marked(t).alias("l"))
    base = base.select("*", T.words_marked(letters).alias("m"), T.marks(letters).alias("runs"), T.count_of(letters, r"\p{N}").alias("plain"))
    tokens = F.size(tokenizer(m if tokenizer is T.whitespace_tokens else t))
    found = {"v": T.words(t), "w": T.marks(m), "rest": F.length(m), "p": lengths(T.paragraphs(m)), "s": lengths(T.sentences(m)), "tokens": tokens}
    counts = {"spaces": T.count_in(m, T.SPACES), "alpha": F.col("n") - F.length(letters) + F.col("runs"), "ideographs": T.ideographic_numbers(t), "vowel": T.vowels(t)}
    base = base.select(F.col(id_col), *labels, "n", "plain", *[c.alias(k) for k, c in (found | counts).items()])
    own = {"v": F.sort_array(F.transform("v", lambda x: F.length(x))), "types": T.type_token_ratio(F.col("v"))}
    kept = [c for c in base.columns if c != "v"]
    base = base.select(*kept, (F.col("plain") + F.col("ideographs")).alias("numeric"), *[c.alias(k) for k, c in own.items()])
    n, w, tokens, alpha, numeric, vowel = (F.col(c) for c in ("n", "w", "tokens", "alpha", "numeric", "vowel"))
    special = n - alpha - F.col("plain") - F.col("spaces")
    inside = n - (F.col("rest") - w)  # characters of words
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    mean = lambda a: T.ratio(total(a), F.size(a))
    most = lambda a: F.coalesce(F.array_max(a), F.lit(0))
    short = lambda a: T.ratio(F.size(F.filter(a, lambda x: x <= T.SHORT_WORDS)), F.size(a))
    p, s, v = F.col("p"), F.col("s"), F.col("v")
    values = [
        n, n - F.col("spaces"), alpha, numeric, special, w, tokens, F.size(p), F.size(s),
        mean(p), most(p), short(p), mean(s), most(s), short(s),
        T.ratio(inside, w), F.coalesce(_middle(v), F.lit(0.0)), most(v), T.ratio(tokens, w), F.col("types"),
        T.ratio(alpha, n), T.ratio(vowel, alpha), T.ratio(numeric, n), T.ratio(special, n), T.ratio(numeric + special, n), F.when(vowel > 0, (alpha - vowel) / vowel),
    ]
    named = dict(zip(METRICS, values, strict=True)) | {f"estimated_token_chunks_{k}": T.estimated_chunks(tokens, k) for k in sizes}
    return base.select(F.col(id_col), *labels, *[c.alias(k) for k, c in named.items()])


def metric_summary(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """One row of 21 statistics for each metric; nulls are skipped. Percentiles are exact, by
    distributed selection, all metrics in the same passes; the deviations from the medians are a
    second selection over rows that are written once."""
    long = rows.select(*[F.col(m).cast("double").alias(m) for m in metrics])
    long = cut(long).unpivot([], metrics, "metric", "x").where("x is not null")
    names = {"p01": 0.01, "p05": 0.05, "q1": 0.25, "median": 0.5, "q3": 0.75, "p95": 0.95, "p99": 0.99}
    moments = [F.count("x").alias("count"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("standard_deviation")]
    first = long.groupBy("metric").agg(*moments, F.min("x").alias("minimum"), F.max("x").alias("maximum"))
    points = percentiles(long, ["metric"], "x", names)
    first = first.join(F.broadcast(points), "metric")  # a row a metric
    apart = long.join(F.broadcast(points.select("metric", "median")), "metric")
    mad = median(apart, ["metric"], F.abs(F.col("x") - F.col("median")), "median_absolute_deviation")
    iqr, deviation = F.col("q3") - F.col("q1"), 3 * F.col("standard_deviation")
    spread = 3 * MAD_SCALE * F.col("median_absolute_deviation")
    return first.join(F.broadcast(mad), "metric").select(
        "metric", "count", "mean", "standard_deviation", "minimum", "p01", "p05", "q1", "median", "q3", "p95", "p99", "maximum",
        iqr.alias("iqr"), (F.col("q1") - 1.5 * iqr).alias("iqr_lower_fence"), (F.col("q3") + 1.5 * iqr).alias("iqr_upper_fence"),
        (F.col("mean") - deviation).alias("mean_minus_3_std"), (F.col("mean") + deviation).alias("mean_plus_3_std"),
        "median_absolute_deviation", (F.col("median") - spread).alias("robust_lower_fence"), (F.col("median") + spread).alias("robust_upper_fence"),
    )


@dataclass(frozen=True)
class Cleaning:
    max_numeric_or_special: float = MAX_NUMERIC_OR_SPECIAL
    multiplier: float = MAD_MULTIPLIER
    min_outliers: int = MIN_OUTLIERS


def robust_bounds(rows: DataFrame, cleaning: Cleaning = Cleaning()) -> DataFrame:
    """metric, lower, upper: median and scaled median deviation of the valid rows."""
    valid = cut(rows.where("is_valid").select(*[F.col(m).cast("double").alias(m) for m in OUTLIER_DIRECTIONS]))
    long = valid.unpivot([], list(OUTLIER_DIRECTIONS), "metric", "x").where("x is not null")
    medians = median(long, ["metric"], "x", "median")
    apart = long.join(F.broadcast(medians), "metric")  # four rows
    spread = medians.join(median(apart, ["metric"], F.abs(F.col("x") - F.col("median")), "mad"), "metric")
    reach = cleaning.multiplier * MAD_SCALE * F.col("mad")
    return spread.select("metric", (F.col("median") - reach).alias("lower"), (F.col("median") + reach).alias("upper"))


def classify_outliers(rows: DataFrame, cleaning: Cleaning = Cleaning()) -> DataFrame:
    """Add `reasons`, joined by semicolons, and `invalidate`. Only valid rows are judged: too many
    numbers and special characters count at once, outlying metrics from `min_outliers` on. The rows
    are written once; the bounds are four pairs of numbers, collected."""
    rows = cut(rows)
    bounds = {r["metric"]: (r["lower"], r["upper"]) for r in robust_bounds(rows, cleaning).collect()}
    if not bounds:
        raise ValueError("no valid articles to take bounds from")
    tests = []
    for metric, directions in OUTLIER_DIRECTIONS.items():
        low, high = bounds[metric]
        for direction in directions:
            outside = F.col(metric) < low if direction == "low" else F.col(metric) > high
            tests.append(F.when(outside, f"outlier_{direction}_{metric}"))
    none = F.array().cast("array<string>")
    outliers = F.filter(F.array(*tests), lambda x: x.isNotNull())
    heavy = F.when(F.col(HEAVY_METRIC) > cleaning.max_numeric_or_special, F.array(F.lit(HEAVY_REASON))).otherwise(none)
    found = F.concat(heavy, F.when(F.size(outliers) >= cleaning.min_outliers, outliers).otherwise(none))
    reasons = F.when(F.col("is_valid"), found).otherwise(none)
    return rows.withColumn("reasons", F.array_join(reasons, ";")).withColumn("invalidate", F.size(reasons) > 0)


def cleaning_report(classified: DataFrame, id_col: str = "article_id") -> DataFrame:
    """What cleaning would do: a row for every article, with the metrics that it is judged by."""
    flags = F.col("is_valid").cast("int").alias("was_valid"), F.col("invalidate").cast("int").alias("would_invalidate")
    return classified.select(F.col(id_col), *flags, "reasons", HEAVY_METRIC, *OUTLIER_DIRECTIONS)


def reason_counts(classified: DataFrame) -> DataFrame:
    split = classified.where("reasons != ''").select(F.explode(F.split("reasons", ";")).alias("reason"))
    return split.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def apply_cleaning(articles: DataFrame, classified: DataFrame, id_col: str = "article_id") -> DataFrame:
    """Articles with what `classify_outliers` found against them."""
    against = classified.where("invalidate").select(F.col(id_col), F.col("reasons").alias("_reasons"))
    joined = articles.join(against, id_col, "left")
    hit = F.col("_reasons").isNotNull()
    valid = F.when(hit, F.lit(False)).otherwise(F.col("is_valid"))
    reason = F.when(hit, F.col("_reasons")).otherwise(F.col("cleaning_reason"))
    return joined.withColumns({"is_valid": valid, "cleaning_reason": reason}).drop("_reasons")


def propagate_validation(embeddings: DataFrame, chunks: DataFrame, articles: DataFrame, batch_size: int = 10_000) -> DataFrame:
    """Embeddings with is_valid taken from their chunk's article; never validated counts as invalid."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    flags = chunks.select("chunk_id", "article_id").join(articles.select("article_id", F.col("is_valid").alias("_valid")), "article_id").select("chunk_id", "_valid")
    return embeddings.drop("is_valid").join(flags, "chunk_id", "left").withColumn("is_valid", F.coalesce("_valid", F.lit(False))).drop("_valid")


def propagation_counts(embeddings: DataFrame) -> DataFrame:
    return embeddings.agg(F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), F.count_if(~F.col("is_valid")).alias("invalid"))
