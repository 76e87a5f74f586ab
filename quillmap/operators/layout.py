"""Two-dimensional layouts that keep neighbourhoods: a neighbour graph, its weights, a spectral start,
and gradient steps over its edges (the method of uniform manifold approximation and projection).

The graph is made by neighbour descent. Vectors start with their nearest ones inside a block of near
vectors; then, round by round, the neighbours of a vector (and those whose neighbour it is) meet each
other, since neighbours of a neighbour are likely neighbours. Each meeting is some forty vectors, and
gives a vector only what is nearer than its k-th so far. Weights fall with distance on a scale of each
vector's own. The start is two eigenvectors of the weighted graph, by power steps that are joins.
Layout rounds deal the plane into blocks of some thousand near points; a task moves its own points
over their edges, with the other ends, and some points from anywhere, standing still.

No task holds more than a block or a group of meetings, and the driver holds a few pivots, sums and 256 points.
All draws come from seed, round and number, so a layout can be made again. Rows without a vector
are left out; of equal similarities (at nine decimals) the vector that comes first counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vectors as V
from ..sources.steps import cut, ship
from . import blocks as B
from .geometry import _near_pivots, dimension_of, unit_vectors
from .ranks import numbered

DECIMALS = 9
FAR = 256  #: points from anywhere that every block sees
GROUPS = 12  #: groups of meetings; more only where the vectors of one would go beyond `HELD`
HELD = 256 << 20  #: bytes of vectors that a task of meetings holds
AT_ONCE = 1_024  #: meetings whose findings a task holds
REPEL = 5  #: random points that an end of an edge is pushed from
# Fixed values of the method: the curve of low-dimensional weights for a least distance of 0.1.
CURVE_A, CURVE_B = 1.5769, 0.8951
CLIP = 4.0

_FOUND = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64())])


@dataclass(frozen=True)
class Layout:
    k: int = 15
    descents: int = 8  #: rounds of neighbour descent at most
    sample: int = 20  #: neighbours of each direction that meet
    power_steps: int = 24
    rounds: int = 8  #: layout rounds, of `epochs` epochs each
    epochs: int = 25
    block: int = 256  #: vectors of a first block
    plane_block: int = 4_096  #: points of a block of the plane
    seed: int = 42

    # ---- neighbours -------------------------------------------------------------------------

    def indexed(self, vectors: DataFrame, id_col: str) -> DataFrame:
        """idx, id, unit vectors, and the vectors as they were stored (`raw`) with what divides them."""
        single = vectors.schema["embedding"].dataType.elementType.typeName() == "float"
        raw = F.col("embedding") if single else V.doubles(F.col("embedding"))
        held = vectors.select(F.col(id_col).alias("id"), raw.alias("raw")).where(F.col("id").isNotNull() & F.col("raw").isNotNull())
        own = V.doubles(F.col("raw"))
        return cut(numbered(held, ["id"]).withColumns({"embedding": V.unit(own), "by": V.divisor(own)}))

    def _nearest(self, rows: DataFrame) -> DataFrame:
        by = W.partitionBy("u").orderBy(F.desc("s"), "v")
        return rows.withColumn("_k", F.row_number().over(by)).where(F.col("_k") <= self.k).drop("_k")

    def _nearest_of(self, found: DataFrame) -> DataFrame:
        """The same of rows that may be there twice, with one shuffle for both."""
        return self._nearest(found.repartition("u").dropDuplicates(["u", "v"]))

    def first_graph(self, units: DataFrame, dimension: int) -> DataFrame:
        """u, v, s: nearest vectors inside blocks."""
        k = self.k
        named = units.select(F.col("idx").alias("article"), F.col("embedding").alias("centroid"))
        # blocks of near vectors by two sets of pivots, so that borders differ, and blocks of any vectors
        ways = [_near_pivots(named, dimension, self.block, self.seed + k) for k in range(2)] + [named.withColumn("cell", F.lit(0))]

        def best(row: dict) -> dict:
            ids = np.sort(row["article"])
            x = B.matrix(row["flat"], len(ids))[np.argsort(row["article"])]
            return _best(ids, x, k, np.full(len(ids), -np.inf))

        found = None
        for way in ways:
            packs = B.packed(way, ["article"], "centroid", ["cell"], self.block)
            own = B.over_rows(packs.select("article", "flat"), best, _FOUND, "u long, v long, s double")
            found = own if found is None else found.unionByName(own)
        return self._nearest_of(found)

    def descend(self, units: DataFrame, edges: DataFrame, number: int) -> DataFrame:
        """The graph after one more round."""
        k = self.k
        draw = F.xxhash64(F.lit(self.seed), F.lit(number), "c", "m")
        sides = []
        for c, m in (("u", "v"), ("v", "u")):
            side = edges.select(F.col(c).alias("c"), F.col(m).alias("m"))
            place = F.row_number().over(W.partitionBy("c").orderBy(draw, "m"))
            sides.append(side.withColumn("_k", place).where(F.col("_k") <= self.sample).drop("_k"))
        own = units.select(F.col("idx").alias("c"), F.col("idx").alias("m"))
        members = sides[0].unionByName(sides[1]).unionByName(own)
        least = edges.groupBy("u").agg(F.count("*").alias("n"), F.min("s").alias("low"))
        least = least.select(F.col("u").alias("m"), F.when(F.col("n") >= k, F.col("low")).alias("low"))  # with fewer, anything counts
        many = _groups(*_sizes(units), 2 * self.sample + 1)
        found = _met(_sent(units, members, least, many), many, k)
        return cut(self._nearest_of(edges.unionByName(found)), again=True)

    def graph(self, units: DataFrame) -> DataFrame:
        """u, v, s: about the k nearest of each vector. Rounds end once they add next to nothing."""
        d = dimension_of(units)
        edges = cut(self.first_graph(units, d)) if d else units.sparkSession.createDataFrame([], "u long, v long, s double")
        before = None
        for number in range(self.descents if d else 0):
            total = edges.agg(F.sum(F.col("s") + 1)).first()[0] or 0.0
            if before is not None and total - before <= 1e-4 * total:
                break
            before, edges = total, self.descend(units, edges, number)
        return edges

    # ---- weights ------------------------------------------------------------------------------

    def weights(self, edges: DataFrame) -> DataFrame:
        """u < v, w: the probability that at least one of both ends holds the edge."""
        goal = np.log2(self.k)
        near = edges.groupBy("u").agg(F.sort_array(F.collect_list(F.struct("v", "s"))).alias("r"))  # k values

        def weigh(row: dict) -> dict:
            d = np.sqrt(np.maximum(2 - 2 * row["s"], 0))
            rest = np.maximum(d - (d[d > 0].min() if (d > 0).any() else 0), 0)
            low, high = 0.0, np.inf
            scale = 1.0
            for _ in range(64):
                if np.exp(-rest / scale).sum() > goal:
                    high = scale
                    scale = (low + high) / 2
                else:
                    low = scale
                    scale = scale * 2 if high == np.inf else (low + high) / 2
            return {"u": np.full(len(d), row["u"]), "v": row["v"], "w": np.exp(-rest / max(scale, 1e-3 * d.mean(), 1e-12))}

        schema = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("w", pa.float64())])
        directed = B.over_rows(near.select("u", F.col("r.v").alias("v"), F.col("r.s").alias("s")), weigh, schema, "u long, v long, w double")
        both = directed.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        return cut(both.agg((1 - F.product(1 - F.col("w"))).alias("w")).where("w > 0"), again=True)

    # ---- start ----------------------------------------------------------------------------------

    def start(self, units: DataFrame, weights: DataFrame) -> DataFrame:
        """idx, x, y: the two leading eigenvectors of the normalised graph after the trivial one."""
        both = weights.unionByName(weights.select(F.col("v").alias("u"), F.col("u").alias("v"), "w"))
        degrees = both.groupBy("u").agg(F.sum("w").alias("deg"))
        nodes = units.select(F.col("idx").alias("u")).join(degrees, "u", "left").select("u", F.coalesce("deg", F.lit(1e-12)).alias("deg"))
        nodes = cut(nodes, again=True)
        root = lambda c: F.sqrt(F.col(c))
        far = nodes.select(F.col("u").alias("v"), F.col("deg").alias("deg_v"))
        step = both.join(nodes, "u").join(far, "v").select("u", "v", (F.col("w") / (root("deg") * root("deg_v"))).alias("a"))
        step = cut(step, again=True)
        length = np.sqrt(nodes.agg(F.sum("deg")).first()[0] or 1.0)
        unit = lambda k: (F.pmod(F.xxhash64(F.lit(self.seed), F.lit(k), "u"), F.lit(1 << 40)) + 0.5) / (1 << 40)
        now = nodes.select("u", (root("deg") / F.lit(length)).alias("q"), (unit(1) - 0.5).alias("x"), (unit(2) - 0.5).alias("y"))
        for _ in range(self.power_steps):
            moved = step.join(now.select(F.col("u").alias("v"), "x", "y"), "v").groupBy("u").agg(*[F.sum(F.col("a") * F.col(c)).alias(f"new_{c}") for c in "xy"])
            mean = [((F.col(c) + F.coalesce(f"new_{c}", F.lit(0.0))) / 2).alias(c) for c in "xy"]
            now = cut(now.join(moved, "u", "left").select("u", "q", *mean), again=True)
            products = [F.sum(F.col(a) * F.col(b)).alias(a + b) for a, b in ("xx", "xy", "yy", "xq", "yq")]
            g = now.agg(*products).first()
            if g["xx"] is None:
                break
            x = F.col("x") - F.lit(g["xq"]) * F.col("q")
            y = F.col("y") - F.lit(g["yq"]) * F.col("q")
            xx, xy, yy = g["xx"] - g["xq"] ** 2, g["xy"] - g["xq"] * g["yq"], g["yy"] - g["yq"] ** 2
            along = xy / xx if xx > 0 else 0.0
            rest = max(yy - along * xy, 1e-300)
            now = now.select("u", "q", (x / F.lit(np.sqrt(max(xx, 1e-300)))).alias("x"), ((y - F.lit(along) * x) / F.lit(np.sqrt(rest))).alias("y"))
        size = now.agg(F.max(F.greatest(F.abs("x"), F.abs("y")))).first()[0] or 1.0
        noise = lambda k: (unit(k) - 0.5) * 1e-3
        return cut(now.select(F.col("u").alias("idx"), *[(F.round(F.col(c) / F.lit(size) * 10, 6) + noise(k)).alias(c) for k, c in ((3, "x"), (4, "y"))]), again=True)

    # ---- layout ---------------------------------------------------------------------------------

    def moved(self, places: DataFrame, weights: DataFrame, number: int) -> DataFrame:
        """idx, x, y after one round of steps inside blocks of the plane."""
        if not (n := places.count()):
            return places
        order = F.xxhash64(F.lit(self.seed), F.lit(number), "idx"), F.col("idx")
        drawn = places.orderBy(*order).limit(max(FAR, min(1_024, -(-n // self.plane_block)))).collect()  # bounded
        drawn = np.array([[r["x"], r["y"]] for r in drawn])
        pivots, far = drawn[: -(-n // self.plane_block)], drawn[:FAR]
        parts = F.array(*[F.struct(((F.col("x") - F.lit(float(px))) ** 2 + (F.col("y") - F.lit(float(py))) ** 2).alias("d"), F.lit(i).alias("i")) for i, (px, py) in enumerate(pivots)])
        dealt = places.withColumn("cell", F.array_min(parts)["i"])
        sizes = dealt.groupBy("cell").agg(F.ceil(F.count("*") / self.plane_block).cast("int").alias("shares"))
        dealt = cut(dealt.join(F.broadcast(sizes), "cell").withColumn("block", F.struct("cell", F.pmod(F.xxhash64(F.lit(number), "idx"), "shares").alias("share"))).select("idx", "x", "y", "block"))  # 1,024 rows
        a, b = (dealt.select(F.col("idx").alias(e), *[F.col(c).alias(f"{e}_{c}") for c in ("x", "y", "block")]) for e in "uv")
        edges = weights.join(a, "u").join(b, "v")
        half = F.explode(F.array_distinct(F.array("u_block", "v_block"))).alias("block")
        edges = edges.select(half, "u", "v", "w", "u_x", "u_y", "v_x", "v_y", "u_block", "v_block")
        rows = edges.select("block", "u", "v", "w", "u_x", "u_y", "v_x", "v_y", (F.col("u_block") == F.col("block")).alias("u_in"), (F.col("v_block") == F.col("block")).alias("v_in"))
        seed, epochs, first, last = self.seed, self.epochs, 1 - number / self.rounds, 1 - (number + 1) / self.rounds

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("u", "ascending"), ("v", "ascending")])
            col = lambda c: table.column(c).to_numpy()
            u, v, w = col("u"), col("v"), col("w")
            names, place = np.unique(np.concatenate([u, v]), return_inverse=True)
            i, j = place[: len(u)], place[len(u) :]
            at, own = np.zeros((len(names), 2)), np.zeros(len(names), bool)
            for ends, e, inside in ((i, "u", "u_in"), (j, "v", "v_in")):
                at[ends] = np.stack([col(f"{e}_x"), col(f"{e}_y")], 1)
                own[ends] |= col(inside)
            rng = np.random.default_rng([seed, number, int(names[own].min())])
            for alpha in np.linspace(first, last, epochs, endpoint=False):
                taken = np.flatnonzero(rng.random(len(w)) < w / w.max())
                for some in np.array_split(rng.permutation(taken), 8):
                    _step(at, own, i[some], j[some], far, alpha, rng)
            return pa.table({"idx": names[own], "x": at[own, 0], "y": at[own, 1]})

        steps = rows.groupBy("block").applyInArrow(run, "idx long, x double, y double")
        alone = places.join(steps.select("idx", F.col("x").alias("_x"), F.col("y").alias("_y")), "idx", "left")
        return cut(alone.select("idx", F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y")), again=True)

    def project(self, vectors: DataFrame, id_col: str) -> DataFrame:
        """id_col, x, y of every vector."""
        ship(vectors.sparkSession)
        units = self.indexed(vectors, id_col)
        weights = self.weights(self.graph(units))
        places = self.start(units, weights)
        for number in range(self.rounds):
            places = self.moved(places, weights, number)
        return places.join(units.select("idx", F.col("id").alias(id_col)), "idx").select(id_col, "x", "y")


def _groups(n: int, held: int, each: int) -> int:
    """How many groups: few for few meetings, and more than `GROUPS` only where the vectors that meet in
    one, of `held` bytes and with meetings of `each`, would go beyond `HELD`."""
    many = GROUPS
    while held * (1 - (1 - 1 / many) ** each) > HELD:
        many += GROUPS
    return max(1, min(many, -(-n // B.BLOCK)))


def _sizes(units: DataFrame) -> tuple[int, int]:
    """Vectors, and bytes of them."""
    wide = 4 if units.schema["raw"].dataType.elementType.typeName() == "float" else 8
    n, numbers = units.agg(F.count("*"), F.sum(F.size("raw").cast("long"))).first()
    return n, wide * (numbers or 0)


def _sent(units: DataFrame, members: DataFrame, least: DataFrame, many: int) -> DataFrame:
    """g, m, low, by, raw, cs: a vector once for each group that it has meetings in, with their centres."""
    g = F.pmod(F.xxhash64("c"), F.lit(many)).alias("g")
    placed = members.select("m", g, "c").repartition("m").groupBy("m", "g").agg(F.collect_set("c").alias("cs"))
    full = placed.join(units.select(F.col("idx").alias("m"), "raw", "by"), "m").join(least, "m", "left")
    return full.select("g", "m", F.coalesce("low", F.lit(-2.0)).alias("low"), "by", "raw", "cs")


def _met(sent: DataFrame, many: int, k: int) -> DataFrame:
    """u, v, s: what the meetings of each group find, of some meetings the k nearest of a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            g = batch.column("g").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(g)) + 1), len(g)]
            for first, end in zip(edges, edges[1:]):
                if first == end:
                    continue
                if held and g[first] != group:
                    yield from _meetings(held, k)
                    held = []
                group = g[first]
                held.append(batch.slice(first, end - first))
        if held:
            yield from _meetings(held, k)

    ship(sent.sparkSession)
    # four times as many tasks as groups at most, so that few get two of them
    return sent.repartition(4 * many, "g").sortWithinPartitions("g").mapInArrow(run, "u long, v long, s double")


def _meetings(held: list[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    col = lambda name: np.concatenate([b.column(name).to_numpy() for b in held])
    flat = lambda name: np.concatenate([b.column(name).flatten().to_numpy(zero_copy_only=False) for b in held])
    m, low, by, x, c = col("m"), col("low"), col("by"), B.matrix(flat("raw"), sum(len(b) for b in held)), flat("cs")
    row = np.repeat(np.arange(len(m)), np.concatenate([b.column("cs").value_lengths().to_numpy() for b in held]))
    held.clear()
    order = np.lexsort((m[row], c))
    row, starts = row[order], np.flatnonzero(np.diff(c[order], prepend=-1))
    ends = [*starts[1:], len(row)]
    for at in range(0, len(starts), AT_ONCE):
        met = [row[a:b] for a, b in zip(starts[at : at + AT_ONCE], ends[at : at + AT_ONCE])]
        found = [_best(m[r], x[r].astype(float) / by[r][:, None], k, low[r]) for r in met]
        u, v, s = (np.concatenate([f[name] for f in found]) for name in "uvs")
        order = np.lexsort((-s, v, u))  # each pair once
        u, v, s = (a[order] for a in (u, v, s))
        once = np.append(True, (np.diff(u) != 0) | (np.diff(v) != 0))[: len(u)]
        u, v, s = (a[once] for a in (u, v, s))
        order = np.lexsort((v, -s, u))
        u, v, s = (a[order] for a in (u, v, s))
        place = np.arange(len(u)) - np.searchsorted(u, u)
        yield pa.RecordBatch.from_arrays([pa.array(a[place < k]) for a in (u, v, s)], schema=_FOUND)


def _best(ids: np.ndarray, x: np.ndarray, k: int, low: np.ndarray) -> dict:
    """For each of these vectors its k nearest others, those above `low`; ids are sorted."""
    s = np.round(x @ x.T, DECIMALS) + 0.0
    np.fill_diagonal(s, -np.inf)
    order = np.argsort(-s, axis=1, kind="stable")[:, :k]
    i = np.repeat(np.arange(len(ids)), order.shape[1])
    j = order.ravel()
    fine = np.isfinite(s[i, j]) & (s[i, j] >= low[i])
    return {"u": ids[i[fine]], "v": ids[j[fine]], "s": s[i[fine], j[fine]]}


def _step(at: np.ndarray, own: np.ndarray, i: np.ndarray, j: np.ndarray, far: np.ndarray, alpha: float, rng: np.random.Generator) -> None:
    """Pull the ends of edges together and push them from random points; only own points move."""
    change = np.zeros_like(at)
    gap = at[i] - at[j]
    square = (gap**2).sum(1)
    with np.errstate(divide="ignore", invalid="ignore"):
        pull = np.where(square > 0, -2 * CURVE_A * CURVE_B * square ** (CURVE_B - 1) / (1 + CURVE_A * square**CURVE_B), 0)
    moves = np.clip(pull[:, None] * gap, -CLIP, CLIP)
    np.add.at(change, i, moves)
    np.add.at(change, j, -moves)
    pool = np.concatenate([at, far])
    for ends in (i, j):
        for _ in range(REPEL):
            gap = at[ends] - pool[rng.integers(0, len(pool), len(ends))]
            square = (gap**2).sum(1)
            push = 2 * CURVE_B / ((0.001 + square) * (1 + CURVE_A * square**CURVE_B))
            np.add.at(change, ends, np.where(square[:, None] > 0, np.clip(push[:, None] * gap, -CLIP, CLIP), 0))
    at[own] += alpha * change[own]


def trustworthiness(vectors: DataFrame, places: DataFrame, id_col: str, k: int = 12) -> float | None:
    """How far neighbours in the plane are neighbours among the vectors: 1 less the normalised excess
    of their ranks. It ranks all vectors around each one, so it is for samples of some thousand."""
    units = unit_vectors(vectors.select(F.col(id_col).alias("id"), "embedding"))
    joined = units.join(places.select(F.col(id_col).alias("id"), "x", "y"), "id")
    packs = cut(B.packed(joined, ["id", "x", "y"], "embedding", [], B.BLOCK))
    n = joined.count()
    if n < 3 * k:
        return None
    kind = joined.schema["id"].dataType.simpleString()

    def near(met: Iterator) -> Iterator[dict]:
        for _, one, two in met:
            a, b = one["id"], two["id"]
            s = np.round(B.matrix(one["flat"], len(a)) @ B.matrix(two["flat"], len(b)).T, DECIMALS)
            d = (one["x"][:, None] - two["x"]) ** 2 + (one["y"][:, None] - two["y"]) ** 2
            other = a[:, None] != b[None, :]
            i, j = np.nonzero(other)
            yield {"own": a[i], "id": b[j], "s": s[other], "d": d[other]}

    schema = pa.schema([("own", B.arrow_type(kind)), ("id", B.arrow_type(kind)), ("s", pa.float64()), ("d", pa.float64())])
    rows = B.meetings(packs, packs, near, schema, f"own {kind}, id {kind}, s double, d double")
    high = F.row_number().over(W.partitionBy("own").orderBy(F.desc("s"), "id"))
    low = F.row_number().over(W.partitionBy("own").orderBy("d", "id"))
    excess = rows.withColumn("high", high).withColumn("low", low).where(F.col("low") <= k).agg(F.sum(F.greatest(F.lit(0), F.col("high") - k))).first()[0]
    return 1 - 2 / (n * k * (2 * n - 3 * k - 1)) * excess
