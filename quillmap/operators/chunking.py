"""Chunkers (one article to many chunks), overlap of neighbours, and summaries of chunking runs.

Every chunker cleans the article of images, cuts it, cleans and strips each chunk, drops empty ones
and numbers the rest from 0. All but the recursive splitter are expressions over one row.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import ArrayType, IntegerType, StringType

from ..functions import text as T
from ..functions.slices import in_slices
from ..sources.steps import ship

SEPARATORS = ("\n\n", "\n", ". ", " ", "")
METHODS = ("noop", "paragraph", "sentence", "token", "split")


def _windows(parts: Column, count: int, overlap: int, glue: str) -> Column:
    """Windows of parts; `parts` must be a column and no expression, or each window computes it anew."""
    starts = F.when(F.size(parts) > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - overlap), F.lit(count - overlap)))
    # the last window is the first that reaches the end
    return F.transform(starts, lambda k: F.array_join(F.slice(parts, k, F.lit(count)), glue))


def _window_sizes(method: str, params: dict[str, int]) -> tuple[int, int]:
    """Parts to a window and parts that neighbours share."""
    default = {"sentence": 1, "token": 512}[method]
    count, overlap = params.get(f"{method}_count", default), params.get(f"{method}_overlap", 0)
    if count < 1 or not 0 <= overlap < count:
        raise ValueError("the count must be positive and the overlap smaller")
    return count, overlap


def library_windows(path: str, count: int, overlap: int):
    """Windows of the tokens that a tokenizer file gives, decoded: for `tokenizers` files, whose path
    all machines must see."""

    def run(texts: list) -> list[list[str]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        out = []
        for text in texts:
            ids = tokenizer.encode(text or "", add_special_tokens=False).ids
            starts = range(0, max(1, len(ids) - overlap), count - overlap) if ids else ()
            out.append([tokenizer.decode(ids[k : k + count], skip_special_tokens=False) for k in starts])
        return out

    return in_slices(ArrayType(StringType()), pa.list_(pa.string()), run)


def library_token_count(path: str):
    """The number of such tokens, for the structure of texts."""

    def run(texts: list) -> list[list[int]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        return [tokenizer.encode(text or "", add_special_tokens=False).ids for text in texts]

    return in_slices(ArrayType(IntegerType()), pa.list_(pa.int32()), run)


def _raw_chunks(texts: DataFrame, method: str, tokenizer: T.Tokenizer | str, params: dict[str, int]) -> DataFrame:
    """article_id, _c (an array of raw chunks) from article_id, _t."""
    text = F.col("_t")
    if method == "token" and isinstance(tokenizer, str):
        return texts.select("article_id", library_windows(tokenizer, *_window_sizes(method, params))(text).alias("_c"))
    if method in ("sentence", "token"):
        count, overlap = _window_sizes(method, params)
        parts = T.sentences(text) if method == "sentence" else tokenizer(text)
        return texts.select("article_id", parts.alias("_p")).select("article_id", _windows(F.col("_p"), count, overlap, " ").alias("_c"))
    if method == "noop":
        made = F.array(text)
    elif method == "paragraph":
        made = T.paragraphs(text)
    elif method == "split":
        made = recursive_split(params.get("chunk_size", 2000), params.get("chunk_overlap", 200))(text)
    else:
        raise ValueError(f"unknown chunking method {method}")
    return texts.select("article_id", made.alias("_c"))


def _pieces(text: str, size: int, separators: tuple[str, ...]) -> list[str]:
    """Parts of up to `size` characters, cut at the first separator that is in the text; each
    separator stays at the end of its part."""
    if len(text) <= size:
        return [text] if text else []
    at = next((k for k, s in enumerate(separators) if s and s in text), None)
    if at is None:
        return [text[k : k + size] for k in range(0, len(text), size)]
    parts = text.split(separators[at])
    parts = [p + separators[at] for p in parts[:-1]] + [parts[-1]]
    return [x for p in parts if p for x in _pieces(p, size, separators[at + 1 :])]


def split_text(text: str, size: int, overlap: int) -> list[str]:
    """Neighbouring pieces joined up to `size` characters; a chunk begins with as many whole pieces
    of the one before as fit into `overlap`."""
    chunks, held, length = [], [], 0
    for piece in _pieces(text, size, SEPARATORS):
        if held and length + len(piece) > size:
            chunks.append("".join(held))
            while held and (length > overlap or length + len(piece) > size):
                length -= len(held.pop(0))
        held.append(piece)
        length += len(piece)
    return [*chunks, "".join(held)] if held else chunks


def recursive_split(size: int, overlap: int):
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("the chunk size must be positive and the overlap smaller")

    def run(texts: list) -> list[list[str]]:
        return [split_text(t or "", size, overlap) for t in texts]

    return in_slices(ArrayType(StringType()), pa.list_(pa.string()), run)


def chunk(
    articles: DataFrame,
    method: str,
    id_col: str = "article_id",
    content_col: str = "content",
    tokenizer: T.Tokenizer | str = T.whitespace_tokens,
    **params: int,
) -> DataFrame:
    """article_id, chunk_index, text. The tokenizer of token windows makes an array of tokens from a
    text column, or is the path of a tokenizer file."""
    ship(articles.sparkSession)
    clean = T.remove_markdown_images(T.text_or_empty(F.col(content_col)))
    texts = articles.select(F.col(id_col).alias("article_id"), clean.alias("_t")).where(T.strip(F.col("_t")) != "")
    made = _raw_chunks(texts, method, tokenizer, params)
    kept = F.filter(F.transform("_c", lambda c: T.strip(T.remove_markdown_images(c))), lambda c: c != "")
    return made.select("article_id", F.posexplode(kept).alias("chunk_index", "text"))


def run_config(method: str, **params: int | str) -> Column:
    """The JSON record of a chunking run."""
    fields = {"remove_markdown_images": True, **params}
    return F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in fields.items()]))


_PROBE, _TRIES = 12, 64


def suffix_prefix_length(before: str, after: str) -> int:
    """The longest suffix of one text that is a prefix of the other. Places where the prefix's first
    characters are found are tried from the longest on; texts that offer too many take the prefix
    function, whose time is in proportion to their length."""
    n = min(len(before), len(after))
    at, tries = len(before) - n, 0
    while at < len(before):
        probe = after[: min(_PROBE, len(before) - at)]
        found = before.find(probe, at)
        if found < 0:  # only shorter ones than the probe are left
            at = max(at, len(before) - len(probe)) + 1
            continue
        if after.startswith(before[found:]):
            return len(before) - found
        at, tries = found + 1, tries + 1
        if tries > _TRIES:
            return _by_prefix_function(before[at:], after)
    return 0


def _by_prefix_function(before: str, after: str) -> int:
    n = min(len(before), len(after))
    joined = after[:n] + "\0" + before[len(before) - n :]
    border, k = [0] * len(joined), 0
    for i in range(1, len(joined)):
        while k and joined[i] != joined[k]:
            k = border[k - 1]
        k += joined[i] == joined[k]
        border[i] = k
    return border[-1] if n else 0


def _overlaps(before: list, after: list) -> list[int]:
    return [0 if a is None or b is None else suffix_prefix_length(a, b) for a, b in zip(before, after)]


suffix_prefix_overlap = in_slices(IntegerType(), pa.int32(), _overlaps)


def transitions_of(chunks: DataFrame, keys: list[str], order: str = "chunk_index") -> DataFrame:
    """Each chunk with the one after it in its group."""
    own = W.partitionBy(*keys).orderBy(order)
    return chunks.withColumn("next_text", F.lead("text").over(own))


def chunk_overlaps(chunks: DataFrame, keys: list[str], order: str = "chunk_index", token_chunks: bool | Column = False) -> DataFrame:
    """overlap (characters) and share of the later chunk for each transition. Where `token_chunks`,
    the later chunk is taken without the mark of a word piece that it may begin with."""
    ship(chunks.sparkSession)
    marked = token_chunks if isinstance(token_chunks, Column) else F.lit(token_chunks)
    pairs = transitions_of(chunks, keys, order).where("next_text is not null")
    following = F.when(marked, T.normalize_token_chunk_start(F.col("next_text"))).otherwise(F.col("next_text"))
    pairs = pairs.withColumn("next_text", following).withColumn("overlap", suffix_prefix_overlap("text", "next_text"))
    return pairs.select(*keys, order, "overlap", T.ratio(F.col("overlap"), F.length("next_text")).alias("overlap_share"))


def chunk_summary(chunks: DataFrame, run_col: str = "chunking_run_id", token_chunks: bool | Column = False) -> DataFrame:
    """One row for each run: articles, chunks, chunks per article, lengths, overlaps. Percentages of
    no transitions, or of no overlaps, are null. `token_chunks` says which runs have token windows."""
    half = F.lit(0.5)
    marked = (token_chunks if isinstance(token_chunks, Column) else F.lit(token_chunks)).alias("_marked")
    chunks = chunks.select(run_col, "article_id", "chunk_index", "text", marked)
    per = chunks.groupBy(run_col, "article_id").agg(F.count("*").alias("n"))
    mean, median = F.avg("n").alias("mean_chunks_per_article"), F.percentile("n", half).alias("median_chunks_per_article")
    articles = per.groupBy(run_col).agg(F.count("*").alias("num_articles"), mean, median)
    sized = chunks.select(run_col, F.length("text").alias("c"), F.size(T.words(F.col("text"))).alias("w"))
    lengths = sized.groupBy(run_col).agg(
        F.count("*").alias("num_chunks"),
        F.avg("c").alias("mean_characters"),
        F.percentile("c", half).alias("median_characters"),
        F.percentile("c", F.lit(0.95)).alias("p95_characters"),
        F.avg("w").alias("mean_words"),
        F.percentile("w", half).alias("median_words"),
    )
    found = chunk_overlaps(chunks, [run_col, "article_id"], token_chunks=F.col("_marked"))
    hit = F.col("overlap") > 0
    overlaps = found.groupBy(run_col).agg(
        F.count("*").alias("num_transitions"),
        F.count_if(hit).alias("num_overlapping_transitions"),
        (100 * F.avg(hit.cast("double"))).alias("overlap_transition_percent"),
        (100 * F.avg(F.when(hit, F.col("overlap_share")))).alias("mean_positive_overlap_percent"),
    )
    out = articles.join(lengths, run_col).join(overlaps, run_col, "left")
    return out.fillna(0, ["num_transitions", "num_overlapping_transitions"])


def first_runs(runs: DataFrame) -> DataFrame:
    """The first run of each method and configuration."""
    own = W.partitionBy("method", "config_json").orderBy("created_at", "chunking_run_id")
    return runs.withColumn("_n", F.row_number().over(own)).where("_n = 1").drop("_n")


def chunk_memory(summary: DataFrame) -> DataFrame:
    """Characters of all chunks in units of 2**20."""
    return summary.withColumn("megabytes", F.round(F.col("mean_characters") * F.col("num_chunks") / 2**20))


def unembedded(chunks: DataFrame, embeddings: DataFrame, run_id: str, max_characters: int | None = None, limit: int | None = None) -> DataFrame:
    """Chunks without an embedding in this run, none longer than `max_characters`; `limit` asks for
    so many of them, those with the smallest ids."""
    for name, value in (("max_characters", max_characters), ("limit", limit)):
        if value is not None and value < 1:
            raise ValueError(f"{name} must be positive")
    done = embeddings.where(F.col("embedding_run_id") == run_id).select("chunk_id")
    left = chunks.join(done, "chunk_id", "left_anti")
    if max_characters is not None:
        left = left.where(F.length("text") <= max_characters)
    return left.orderBy("chunk_id").limit(limit) if limit is not None else left


def oversized(chunks: DataFrame, embeddings: DataFrame, run_id: str, max_characters: int) -> DataFrame:
    """Chunks without an embedding that are too long for one."""
    return unembedded(chunks, embeddings, run_id).where(F.length("text") > max_characters)


def embed(chunks: DataFrame, model, dimension: int, batch_size: int = 256) -> DataFrame:
    """chunk_id, embedding from chunk_id, text. `model()` gives a function from a list of texts to a
    list of vectors, made once for each task. A batch that fails is left out, so that a later run
    finds its chunks among the unembedded."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")

    def run(batches):
        encode = model()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), batch_size):
                try:
                    vectors = [list(map(float, v)) for v in encode(texts[at : at + batch_size])]
                except Exception as error:
                    print(f"embedding batch of {len(texts[at : at + batch_size])} texts failed: {error}")
                    continue
                if any(len(v) != dimension for v in vectors):
                    raise ValueError(f"expected vectors of {dimension} components")
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, batch_size), pa.array(vectors, pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    kind = chunks.schema["chunk_id"].dataType.simpleString()
    return chunks.select("chunk_id", "text").mapInArrow(run, f"chunk_id {kind}, embedding array<float>")
