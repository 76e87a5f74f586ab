"""Exact percentiles by distributed selection: no task sorts, or holds, all values of a key.

A population is the values of a key inside an open interval. While it is large, a sketch of fixed
size (mergeable, with a grid of approximate percentiles) gives cut points around each wanted rank,
and a second pass counts exactly what lies below, on and between them. A rank that falls on a cut
point is found; one between two of them goes on with that interval as its population, a few
thousandths of the last one. The sketch only says where to look: what is found comes from exact
counts. Once a population has at most `BOUND` values it is sorted in one task. All keys and
fractions are narrowed in the same passes, and each pass is an aggregate that Spark combines before
it shuffles; the driver holds some numbers for each key and fraction.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOUND = 1 << 16  #: values that one task sorts
GRID = 1_024  #: steps of the sketch's percentiles
ACCURACY = 10_000  #: of the sketch: the error of a rank is a part of so many


@dataclass
class Population:
    """Values of a key above `low` and below `high` (None: no bound); `before` are smaller."""

    key: tuple
    n: int
    before: int
    ranks: list[int]
    low: float | None = None
    high: float | None = None
    cuts: list[float] = field(default_factory=list)


def order_statistics(rows: DataFrame, keys: Sequence[str], value: str, ranks: Callable[[int], list[int]]) -> tuple[dict[tuple, int], dict[tuple, dict[int, float]]]:
    """For each key: how many values aren't null, and the values at the ranks (0: the smallest) that
    `ranks` asks for of so many. NaN is the largest value. `rows` are read some times: write what is
    costly to compute. Keys are few: they and their ranks are held on the driver."""
    x = rows.select(*keys, F.lit(0).alias("_one"), F.col(value).cast("double").alias("_x")).where("_x is not null")
    sizes = {tuple(r[:-1]): r["n"] for r in x.groupBy(*keys).agg(F.count("*").alias("n")).collect() if r["n"]}
    found: dict[tuple, dict[int, float]] = {key: {} for key in sizes}
    left = [Population(key, n, 0, sorted(set(ranks(n)))) for key, n in sizes.items()]
    left = [p for p in left if p.ranks]
    while left:
        large = [p for p in left if p.n > BOUND]
        for p, values in _sorted(x, keys, [p for p in left if p.n <= BOUND]):
            found[p.key] |= zip(p.ranks, values)
        left = []
        for p, grid in _sketched(x, keys, large):
            p.cuts = sorted({grid[k] for r in p.ranks for k in _around((r - p.before) / p.n)}, key=_order)
        for p, slots in _counted(x, keys, large):
            at = p.before
            for slot in range(2 * len(p.cuts) + 1):
                n = slots.get(slot, 0)
                inside = [r for r in p.ranks if at <= r < at + n]
                if inside and slot % 2:
                    found[p.key] |= dict.fromkeys(inside, p.cuts[slot // 2])
                elif inside:
                    ends = [p.low, *p.cuts, p.high]
                    left.append(Population(p.key, n, at, inside, ends[slot // 2], ends[slot // 2 + 1]))
                at += n
    return sizes, found


def _order(v: float) -> tuple[bool, float]:
    return (True, 0.0) if math.isnan(v) else (False, v)


def _around(share: float) -> tuple[int, int]:
    k = math.floor(share * GRID)
    return max(0, k - 1), min(GRID, k + 2)


def _members(x: DataFrame, keys: Sequence[str], some: list[Population], extra: str, values: Callable[[Population], list]) -> DataFrame:
    """Rows of the populations with `_p`, the population's number, and an array that it brings along."""
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in x.select(*keys).schema)
    table = x.sparkSession.createDataFrame([(*p.key, k, p.low, p.high, values(p), 0) for k, p in enumerate(some)], f"{kinds}_p int, _low double, _high double, {extra}, _one int")
    left, right = x.alias("x"), F.broadcast(table.alias("t"))  # a row a population
    same = [F.col(f"x.{k}").eqNullSafe(F.col(f"t.{k}")) for k in [*keys, "_one"]]
    inside = [F.col("_low").isNull() | (F.col("_x") > F.col("_low")), F.col("_high").isNull() | (F.col("_x") < F.col("_high"))]
    return left.join(right, [*same, *inside]).select("_p", "_x", extra.split()[0])


def _sorted(x: DataFrame, keys: Sequence[str], some: list[Population]) -> list[tuple[Population, list[float]]]:
    if not some:
        return []
    members = _members(x, keys, some, "_ranks array<int>", lambda p: [r - p.before for r in p.ranks])
    values = F.sort_array(F.collect_list("_x")).alias("v")  # BOUND values at most
    picked = members.groupBy("_p").agg(values, F.first("_ranks").alias("r")).select("_p", F.transform("r", lambda k: F.get("v", k)).alias("v"))
    return [(some[r["_p"]], r["v"]) for r in picked.collect()]


def _sketched(x: DataFrame, keys: Sequence[str], some: list[Population]) -> list[tuple[Population, list[float]]]:
    if not some:
        return []
    grid = F.percentile_approx("_x", [k / GRID for k in range(GRID + 1)], ACCURACY).alias("grid")
    members = _members(x, keys, some, "_none array<int>", lambda p: [])
    return [(some[r["_p"]], r["grid"]) for r in members.groupBy("_p").agg(grid).collect()]


def _counted(x: DataFrame, keys: Sequence[str], some: list[Population]) -> list[tuple[Population, dict[int, int]]]:
    """How many values lie on (odd) and between (even) the cut points, in their order."""
    if not some:
        return []
    members = _members(x, keys, some, "_cuts array<double>", lambda p: p.cuts)
    below = F.aggregate("_cuts", F.lit(0), lambda n, c: n + (c < F.col("_x")).cast("int"))
    slot = (2 * below + F.array_contains("_cuts", F.col("_x")).cast("int")).alias("slot")
    out: list[tuple[Population, dict[int, int]]] = [(p, {}) for p in some]
    for r in members.groupBy("_p", slot).agg(F.count("*").alias("n")).collect():
        out[r["_p"]][1][r["slot"]] = r["n"]
    return out


def percentiles(rows: DataFrame, keys: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """One row for each key with a value: the keys and a column for each named fraction, interpolated
    between the two neighbouring ranks as Spark's `percentile` does."""
    names = list(fractions)
    ends = lambda n, p: (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))
    sizes, found = order_statistics(rows, keys, value, lambda n: [r for p in fractions.values() for r in ends(n, p)])
    out = []
    for key, n in sizes.items():
        own, row = found[key], []
        for name in names:
            at, (low, high) = fractions[name] * (n - 1), ends(n, fractions[name])
            row.append(own[low] if low == high or own[low] == own[high] else (high - at) * own[low] + (at - low) * own[high])
        out.append((*key, *row))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.select(*keys).schema]
    return rows.sparkSession.createDataFrame(out, ", ".join([*kinds, *(f"{n} double" for n in names)]))


def median(rows: DataFrame, keys: Sequence[str], value: str | Column, name: str) -> DataFrame:
    made = value if isinstance(value, Column) else F.col(value)
    return percentiles(rows.select(*keys, made.alias("_value")), keys, "_value", {name: 0.5})
