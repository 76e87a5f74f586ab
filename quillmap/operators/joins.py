"""Joins with tables of one row a key whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 1_000  #: keys that are dealt over several tasks
SHARE = 1_000  #: rows of a hot key in one share
MOST_SHARES = 512


def _plain(value):
    return bytes(value) if isinstance(value, bytearray) else value


def salted_join(rows: DataFrame, table: DataFrame, keys: list[str], salt: str, counts: DataFrame | None = None, how: str = "inner") -> DataFrame:
    """Join rows with a table that has each key once. The thousand keys with most rows are dealt over
    shares by `salt`, with the table's row in each share, so no task gets all rows of a key: any other
    key has a thousandth of the rows at most. counts: the keys and `n_rows`, if they are known."""
    counts = counts if counts is not None else rows.groupBy(*keys).agg(F.count("*").alias("n_rows"))
    hot = counts.where(F.col("n_rows") > SHARE).select(*keys, "n_rows").orderBy(F.desc("n_rows")).limit(HOT_KEYS).collect()  # a thousand rows at most
    if not hot:
        return rows.join(table, keys, how)
    dealt = [(*map(_plain, r[:-1]), min(MOST_SHARES, -(-r["n_rows"] // SHARE))) for r in hot]
    kinds = ", ".join(f"{k} {dict(rows.dtypes)[k]}" for k in keys)
    shares = F.broadcast(rows.sparkSession.createDataFrame(dealt, f"{kinds}, _shares int"))
    of = F.coalesce("_shares", F.lit(1))
    left = rows.join(shares, keys, "left").withColumn("_share", F.pmod(F.xxhash64(salt), of).cast("int")).drop("_shares")
    right = table.join(shares, keys, "left").withColumn("_share", F.explode(F.sequence(F.lit(0), of - 1))).drop("_shares")
    return left.join(right, [*keys, "_share"], how).drop("_share")
