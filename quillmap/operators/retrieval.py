"""Exact nearest neighbours of vectors, and retrieval measures over relevance judgements.

Queries and corpus are packed into blocks, and these dealt into groups; a task takes a group of queries
and streams a group of the corpus. Two blocks meet in one matrix product, of which every query keeps
what is among its k best so far. The lists of up to four tasks are merged by a rank that Spark limits
to k. What is shuffled is up to 36 copies of the vectors and 4 lists of k rows a query, whatever the
size of the corpus (more only where a group of queries goes beyond 64 MB).

Similarities are cosines, compared at nine decimals; of equal ones the document that comes first in
the order of ids wins, so the result doesn't depend on blocks. Vectors of length zero have similarity
0 with all.

Measures follow the usual definitions of retrieval benchmarks: gains are linear and discounted by
log2(rank + 1), the ideal order has all judged documents by descending gain, average precision is
divided by the number of relevant documents, and means are over queries with a relevant document.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..sources.steps import cut
from . import blocks as B
from .geometry import unit_vectors
from .joins import salted_join

DECIMALS = 9
SLACK = 2e-9  #: more than rounding moves two similarities
DEPTHS = (1, 3, 5, 10, 20, 100)


def _units(vectors: DataFrame, id_col: str, to: str, vector_col: str) -> DataFrame:
    return unit_vectors(vectors.select(F.col(id_col).alias(to), F.col(vector_col).alias("embedding")).where(F.col(to).isNotNull() & F.col("embedding").isNotNull()))


class _Best:
    """The k best so far of a block of queries. What is less near than a query's k-th is left out where
    it is found; the rest is put in order once it is as much as four lists."""

    def __init__(self, own: dict, k: int, same: bool):
        self.ids, self.k, self.same = own["query"], k, same
        self.x = B.matrix(own["flat"], len(self.ids))
        self.limit = np.full(len(self.ids), -np.inf)
        self.i, self.doc, self.similarity = np.zeros(0, np.int64), self.ids[:0], np.zeros(0)
        self.parts, self.waiting = [], 0

    def add(self, other: dict) -> None:
        docs = other["doc"]
        cosine = self.x @ B.matrix(other["flat"], len(docs)).T
        limit = self.limit - SLACK
        if self.k < len(docs) and np.isinf(limit).any():
            place = len(docs) - self.k - self.same  # one more, if a query may be among them
            if place >= 0:
                limit = np.maximum(limit, np.partition(cosine, place, axis=1)[:, place] - SLACK)
        i, j = np.nonzero(cosine >= limit[:, None])
        if self.same:
            apart = self.ids[i] != docs[j]
            i, j = i[apart], j[apart]
        self.parts.append((i, docs[j], np.round(cosine[i, j], DECIMALS) + 0.0))
        self.waiting += len(i)
        if self.waiting > 4 * self.k * len(self.ids) or np.isinf(self.limit).any():
            self.merge()

    def merge(self) -> None:
        i, doc, similarity = (np.concatenate(c) for c in zip((self.i, self.doc, self.similarity), *self.parts))
        self.parts, self.waiting = [], 0
        place = np.lexsort((doc, -similarity, i))
        i = i[place]
        rank = np.arange(len(i)) - np.searchsorted(i, np.arange(len(self.ids)))[i]
        first = rank < self.k
        self.i, self.doc, self.similarity = i[first], doc[place][first], similarity[place][first]
        last = rank[first] == self.k - 1
        self.limit[self.i[last]] = self.similarity[last]

    def rows(self) -> dict:
        self.merge()
        return {"query": self.ids[self.i], "doc": self.doc, "similarity": self.similarity}


def nearest(queries: DataFrame, corpus: DataFrame, k: int, query_col: str = "query", doc_col: str = "doc", vector_col: str = "embedding", same: bool = False, block: int = B.BLOCK) -> DataFrame:
    """query, doc, rank (from 1), similarity of the k documents that are nearest to each query. same:
    queries and corpus name the same things, and none is its own neighbour. Rows without an id or a
    vector are left out."""
    if k < 1:
        raise ValueError("k must be positive")
    q, d = _units(queries, query_col, "query", vector_col), _units(corpus, doc_col, "doc", vector_col)
    kinds = [x.schema[c].dataType.simpleString() for x, c in ((q, "query"), (d, "doc"))]
    left = B.packed(q, ["query"], "embedding", [], block)
    right = B.packed(d, ["doc"], "embedding", [], block)
    schema = pa.schema([("query", B.arrow_type(kinds[0])), ("doc", B.arrow_type(kinds[1])), ("similarity", pa.float64())])

    def run(met: Iterator) -> Iterator[dict]:
        for _, cell in groupby(met, lambda m: m[0]):
            lists: dict[int, _Best] = {}
            for _, own, other in cell:
                if id(own) not in lists:
                    lists[id(own)] = _Best(own, k, same)
                lists[id(own)].add(other)
            for best in lists.values():
                yield best.rows()

    found = B.meetings(cut(left), cut(right), run, schema, f"query {kinds[0]}, doc {kinds[1]}, similarity double")
    by = W.partitionBy("query").orderBy(F.desc("similarity"), "doc")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query", "doc", "rank", "similarity")


def judged_by(ranked: DataFrame, judgements: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """(query, rank, gain of what was found; query, n_relevant, ideal gains) from judgements (query,
    doc, gain), each pair once. Gains that are null or not positive aren't relevant."""
    relevant = judgements.where("gain > 0").select("query", "doc", F.col("gain").cast("double").alias("gain"))
    found = ranked.join(relevant, ["query", "doc"], "left").select("query", "rank", F.coalesce("gain", F.lit(0.0)).alias("gain"))
    by = W.partitionBy("query").orderBy(F.desc("gain"), "doc")
    top = relevant.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= depth)
    gains = F.transform(F.array_sort(F.collect_list(F.struct("_k", "gain"))), lambda x: x["gain"]).alias("ideal")  # depth values at most
    counts = relevant.groupBy("query").agg(F.count("*").alias("n_relevant"))
    return found, top.groupBy("query").agg(gains).join(counts, "query")


def judged_by_label(ranked: DataFrame, labels: DataFrame, depth: int, id_col: str = "doc", label_col: str = "label", same: bool = True) -> tuple[DataFrame, DataFrame]:
    """As `judged_by` where what has the query's label is relevant; labels: (id, label) of queries and
    documents, which are the same things. No pair is made but those that were found, and a label that
    a third of the documents share is dealt over many tasks."""
    own = cut(labels.select(F.col(id_col).alias("query"), F.col(label_col).alias("label")).where("label is not null"))
    of_doc = own.select(F.col("query").alias("doc"), F.col("label").alias("found"))
    joined = ranked.join(own, "query").join(of_doc, "doc", "left")
    found = joined.select("query", "rank", F.coalesce((F.col("label") == F.col("found")).cast("double"), F.lit(0.0)).alias("gain"))
    sizes = cut(own.groupBy("label").agg(F.count("*").alias("n_rows")))
    placed = salted_join(own, sizes.select("label", (F.col("n_rows") - F.lit(int(same))).alias("n_relevant")), ["label"], "query", sizes)
    some = placed.where("n_relevant > 0")
    return found, some.select("query", "n_relevant", F.array_repeat(F.lit(1.0), F.least(F.col("n_relevant"), F.lit(depth)).cast("int")).alias("ideal"))


def measures(judged: tuple[DataFrame, DataFrame], depths: Sequence[int] = DEPTHS) -> DataFrame:
    """depth, n_queries, ndcg, map, recall, precision, mrr: one row for each depth. A query that found
    nothing counts with zeros; one without a relevant document doesn't count."""
    if not depths or min(depths) < 1:
        raise ValueError("depths must be positive")
    found, ideal = judged
    discount = F.log2(F.col("rank") + 1)
    upto = W.partitionBy("query").orderBy("rank")
    hits = found.where((F.col("gain") > 0) & (F.col("rank") <= max(depths))).withColumn("_hits", F.row_number().over(upto))
    sums = []
    for k in depths:
        inside = F.col("rank") <= k
        sums += [
            F.sum(F.when(inside, F.col("gain") / discount)).alias(f"dcg_{k}"),
            F.sum(F.when(inside, F.col("_hits") / F.col("rank"))).alias(f"precisions_{k}"),
            F.count_if(inside).alias(f"hits_{k}"),
            F.min(F.when(inside, F.col("rank"))).alias(f"first_{k}"),
        ]
    per = ideal.join(hits.groupBy("query").agg(*sums), "query", "left")
    rows = []
    for k in depths:
        best = F.aggregate(F.transform(F.slice("ideal", 1, k), lambda g, i: g / F.log2(i + F.lit(2))), F.lit(0.0), lambda a, x: a + x)
        zero = lambda c: F.coalesce(c, F.lit(0.0))
        rows.append(
            F.struct(
                F.lit(k).alias("depth"),
                zero(F.col(f"dcg_{k}") / best).alias("ndcg"),
                zero(F.col(f"precisions_{k}") / F.col("n_relevant")).alias("map"),
                zero(F.col(f"hits_{k}") / F.col("n_relevant")).alias("recall"),
                zero(F.col(f"hits_{k}") / F.lit(float(k))).alias("precision"),
                zero(1 / F.col(f"first_{k}")).alias("mrr"),
            )
        )
    each = per.select(F.explode(F.array(*rows)).alias("m")).select("m.*")
    return each.groupBy("depth").agg(F.count("*").alias("n_queries"), *[F.avg(c).alias(c) for c in ("ndcg", "map", "recall", "precision", "mrr")])
