"""URL filters by Bloom filter cascades, in DataFrame operations only.

A cascade answers exactly, for every key of the corpus, whether the key is on a list: level 1 is a
Bloom filter of the listed keys, level 2 one of the corpus's keys that level 1 wrongly reports,
level 3 one of the listed keys that level 2 reports, and so on until no key is reported wrongly.
A lookup is a few bit tests in an expression; corpus rows are never joined or shuffled. The filters
are as large as the list asks for: level 1 has `level_bits` bits for each listed key, later ones 2.
Lists are DataFrames (or short tuples). A filter is gathered by Spark into one value and goes into
the lookup as one constant, whose size is checked; Spark allows no subquery inside the functions
over arrays that the lookup needs.

The keys of an url are its host and the host's parent domains (for the host list), and each of
these followed by a prefix of the path that is as long as some rule's path (for the rules).

Defined results: a null url or one without "://" has an empty host and path, no rule, and the
verdict allow; equal urls get equal results; an empty table gives an empty table, and cascades of
an empty universe have one level; null and repeated entries of a list don't count; other columns of
the input don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

BLOCK_RULES = ("net/", "example.com/de/")
ALLOW_RULES = ("example.net/en/", "org/fr/")
# Names of the default block list, each under the three test domains.
BLOCKED_NAMES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
BLOCKED_HOSTS = tuple(f"{name}.example.{top}" for name in BLOCKED_NAMES for top in ("com", "net", "org"))
MAX_LEVELS = 64
MAX_FILTER_BYTES = 64 << 20  #: of one level: at 12 bits a key, for 44 million listed keys
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its 64-bit words in one text, their number, hash functions, salt."""

    words: str
    size: int
    hashes: int
    salt: int

    def reports(self, key: Column) -> Column:
        # constant: Spark makes it one array before it runs the query
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        first, *rest = [_bit(words, p) for p in _positions(key, self.size * 64, self.hashes, self.salt)]
        for test in rest:
            first = first & test
        return first


def _bit(words: Column, position: Column) -> Column:
    word = F.get(words, F.floor(position / 64).cast("int"))
    return F.call_function("shiftright", word, F.pmod(position, F.lit(64)).cast("int")).bitwiseAND(F.lit(1).cast("long")) == 1


def _positions(key: Column, bits: int, hashes: int, salt: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt * 64 + k), key), F.lit(bits).cast("long")) for k in range(hashes)]


def bloom(keys: DataFrame, n: int, bits_per_key: float, hashes: int, salt: int) -> Level:
    """A filter of the distinct strings in keys.key, of which there are n. Its size follows from n,
    not from the corpus, and is checked before it is gathered."""
    size = max(1, -(-int(n * bits_per_key + 63) // 64))
    if 8 * size > MAX_FILTER_BYTES:
        raise ValueError(f"a filter of {n} keys takes {8 * size} bytes; at most {MAX_FILTER_BYTES} are sent to all tasks")
    spots = keys.select(F.explode(F.array(*_positions(F.col("key"), size * 64, hashes, salt))).alias("spot"))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("spot", F.lit(64)).cast("int"))
    set_ = spots.select(F.floor(F.col("spot") / 64).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    every = keys.sparkSession.range(size).select(F.col("id").alias("word")).join(set_, "word", "left")
    pairs = F.array_sort(F.collect_list(F.struct("word", F.coalesce("bits", F.lit(0)).alias("bits"))))
    text = F.array_join(F.transform(pairs, lambda x: x["bits"].cast("string")), ",")
    return Level(every.agg(text.alias("words")).first()["words"], size, hashes, salt)


@dataclass(frozen=True)
class Cascade:
    """Exact membership for the keys of the universe that it was built over."""

    levels: tuple[Level, ...]

    def holds(self, key: Column) -> Column:
        out = None
        for k in reversed(range(len(self.levels))):
            hit = self.levels[k].reports(key)
            if k % 2 == 0:
                out = hit if out is None else hit & out
            else:
                out = ~hit if out is None else ~hit | out
        return out


def first_level(listed: DataFrame, salt: int, level_bits: int = 12, hashes: int = 8) -> Level:
    return bloom(listed, listed.count(), level_bits, hashes, salt)


def build(listed: DataFrame, first: Level, reported: DataFrame, salt: int) -> Cascade:
    """listed.key: the list's distinct keys; reported.key: distinct keys of the corpus that level 1
    reports. Both sides shrink by half a level on average."""
    levels = [first]
    wrong = cut(reported.join(listed, "key", "left_anti"))  # few: the filter has let them through
    sides = [listed, wrong]
    n = wrong.count()
    while n:
        if len(levels) == MAX_LEVELS:
            raise RuntimeError("the cascade doesn't end: keys of the list and the corpus hash alike")
        level = bloom(sides[len(levels) % 2], n, 2.0, 1, salt + len(levels))
        other = (len(levels) + 1) % 2
        levels.append(level)
        sides[other] = cut(sides[other].where(level.reports(F.col("key"))))
        n = sides[other].count()
    return Cascade(tuple(levels))


def keys_frame(spark: SparkSession, keys: DataFrame | Sequence[str]) -> DataFrame:
    """Distinct keys of a list: the first column of a DataFrame, or a short sequence."""
    if not isinstance(keys, DataFrame):
        keys = spark.createDataFrame([(k,) for k in keys], "key string")
    first = F.col(f"`{keys.columns[0]}`").cast("string").alias("key")
    return keys.select(first).where("key is not null").distinct()


def host_of(url: Column) -> Column:
    return F.translate(_part(url, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return _part(url, 2)


def _part(url: Column, k: int) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", k), F.lit(""))


def _domains(host: Column) -> Column:
    """The host and its parent domains, longest first; none for an empty host."""
    parts = F.split(host, r"\.")
    tails = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, k, F.size(parts)), "."))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(tails)


def _rule_keys(domains: Column, path: Column, lengths: list[int]) -> Column:
    """Keys that a rule can have, longest first, then the one with the longer host."""
    def cut_to(n: int) -> Column:
        fitting = F.when(F.length(path) >= n, domains).otherwise(F.array().cast("array<string>"))
        key = lambda d: F.concat(d, F.substring(path, 1, n)).alias("key")
        return F.transform(fitting, lambda d: F.struct((-F.length(d) - n).alias("a"), (-F.length(d)).alias("b"), key(d)))

    per = [cut_to(n) for n in lengths] or [F.array().cast("array<struct<a:int,b:int,key:string>>")]
    return F.transform(F.array_sort(F.concat(*per)), lambda s: s["key"])


def judge(
    pages: DataFrame,
    block_rules: DataFrame | Sequence[str] = BLOCK_RULES,
    allow_rules: DataFrame | Sequence[str] = ALLOW_RULES,
    blocked_hosts: DataFrame | Sequence[str] = BLOCKED_HOSTS,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """page_id, host, path, rule, verdict. Two cascades over the complete universe of the corpus's
    keys hold the blocked keys (rules and hosts) and the allowed ones; the longest rule that fits
    decides, else the host list. A rule is a host and a path prefix that begins with a slash."""
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    block, allow = cut(keys_frame(spark, block_rules)), cut(keys_frame(spark, allow_rules))
    slash = F.instr("key", "/")
    both = block.unionByName(allow)
    if both.where(slash == 0).limit(1).count():
        raise ValueError("a rule has a host and a path")
    found = both.select((F.length("key") - slash + 1).alias("n")).distinct().collect()  # lengths of paths of rules
    lengths = sorted(r["n"] for r in found)
    keyed = pages.select(F.col(id_col).alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    keyed = keyed.withColumn("domains", _domains(F.col("host")))
    keyed = keyed.withColumn("rules", _rule_keys(F.col("domains"), F.col("path"), lengths))

    listed = block.unionByName(keys_frame(spark, blocked_hosts)).distinct()
    lists = {"block": cut(listed), "allow": allow}
    firsts = {name: first_level(frame, 1 + 100 * k) for k, (name, frame) in enumerate(lists.items())}

    def anyone(key: Column) -> Column:
        return firsts["block"].reports(key) | firsts["allow"].reports(key)

    universe = keyed.select(F.explode(F.filter(F.concat("domains", "rules"), anyone)).alias("key"))
    reported = cut(universe.distinct())
    cascades = {}
    for k, (name, frame) in enumerate(lists.items()):
        cascades[name] = build(frame, firsts[name], reported.where(firsts[name].reports(F.col("key"))), 2 + 100 * k)
    block, allow = cascades["block"].holds, cascades["allow"].holds
    rule = F.get(F.filter("rules", lambda key: block(key) | allow(key)), F.lit(0))
    out = keyed.select("page_id", "host", "path", "domains", rule.alias("rule"))
    by_method = F.exists("domains", block)
    by_rule = F.when(allow(F.col("rule")), "allow").otherwise("block")
    verdict = F.when(F.col("rule").isNotNull(), by_rule).when(by_method, "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"))
