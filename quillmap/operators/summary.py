"""Result tables: identities, merging, grids, derived metrics, order, and rendering."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ["model_id", "chunking_strategy"]
LATEX_ESCAPES = {"\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}"}


def with_identity(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results with model_id and chunking_strategy (the chunking run) from the run table; a run that
    isn't there is an error."""
    missing = [r[0] for r in results.select("embedding_run_id").join(runs, "embedding_run_id", "left_anti").limit(5).collect()]
    if missing:
        raise ValueError(f"unknown embedding runs: {sorted(missing)}")
    strategy = F.get_json_object("config_json", "$.chunking_run_id").alias("chunking_strategy")
    return results.drop(*KEYS).join(runs.select("embedding_run_id", "model_id", strategy), "embedding_run_id")


def check_unique(table: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    again = table.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if again:
        raise ValueError(f"duplicate keys: {sorted(tuple(r)[:-1] for r in again)}")
    return table


def merge(tables: dict[str, DataFrame], keys: list[str] = KEYS) -> DataFrame:
    """Tables with the same keys side by side; columns get their table's name as a prefix."""
    out = None
    for name, table in tables.items():
        check_unique(table, keys)
        own = table.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in table.columns if c not in keys])
        if out is None:
            out, first = own, name
            continue
        sides = out.select(*keys, F.lit(1).alias("_a")).join(own.select(*keys, F.lit(1).alias("_b")), keys, "full_outer")
        if sides.where("_a is null or _b is null").limit(1).count():
            raise ValueError(f"{first} and {name} don't have the same keys")
        out = out.join(own, keys)
    return out


def degradation_share(d: Column, negative: Column, positive: Column) -> Column:
    """d / (d + (positive - negative)); null where it has no meaning."""
    gap = positive - negative
    return F.when((d >= 0) & (gap >= 0) & (d + gap > 0), F.try_divide(d, d + gap))


def retained_similarity(d: Column, negative: Column) -> Column:
    """((1 - negative) - d) / (1 - negative); null where it has no meaning."""
    room = 1 - negative
    return F.when((d >= 0) & (room > 0), F.try_divide(room - d, room))


def complete_grid(table: DataFrame, models: Iterable[str], strategies: Iterable[str]) -> DataFrame:
    """One row for every model and strategy; both lists are short."""
    spark = table.sparkSession
    rows = [(m, s) for m in models for s in strategies]
    return spark.createDataFrame(rows, "model_id string, chunking_strategy string").join(table, KEYS, "left")


def missing_cells(grid: DataFrame, metric: str) -> DataFrame:
    return grid.agg(F.count_if(F.col(metric).isNull()).alias("missing"))


def rank_in(column: Column, order: list[str]) -> Column:
    """Place in a list; what isn't in it comes after all that is."""
    place = F.array_position(F.array(*map(F.lit, order)), column)
    return F.when(place > 0, place).otherwise(len(order) + 1)


def ordered(table: DataFrame, models: list[str], strategies: list[str]) -> DataFrame:
    m, s = F.col("model_id"), F.col("chunking_strategy")
    return table.orderBy(rank_in(m, models), m, rank_in(s, strategies), s)


def overlap_series(table: DataFrame, size: int = 256) -> DataFrame:
    """Rows of the token windows of one size, with their overlap as a number."""
    overlap = F.regexp_extract("chunking_strategy", f"^token_{size}_([0-9]+)$", 1)
    return table.where(overlap != "").withColumn("overlap", overlap.cast("int")).orderBy("model_id", "overlap")


def format_metric(value: Column, kind: str = "decimal", missing: str = "--") -> Column:
    """decimal: four places; percent: two places of a share; integer: as it is."""
    number = value.cast("double")
    percent = F.concat(F.format_string("%.2f", 100 * number), F.lit("\\%"))
    text = {"decimal": F.format_string("%.4f", number), "percent": percent, "integer": value.cast("string")}[kind]
    return F.when(value.isNull(), missing).otherwise(text)


def latex_escape(text: str, only: str | None = None) -> str:
    """With `only`, just these characters."""
    return "".join(LATEX_ESCAPES[c] if c in LATEX_ESCAPES and (only is None or c in only) else c for c in text)


def latex_table(
    table: DataFrame,
    columns: dict[str, str],
    caption: str,
    label: str,
    numbers: dict[str, str] | None = None,
    group_by: str | None = None,
    width: str | None = None,
) -> str:
    """A booktabs table of a small result: columns maps names to titles, numbers names to formats.
    The rows of a group are set apart, and only the first one names it; with `width`, the table is
    scaled to it and goes over both columns of a page."""
    numbers = numbers or {}
    shown = [format_metric(F.col(c), numbers[c]).alias(c) if c in numbers else F.col(c).cast("string").alias(c) for c in columns]
    star = "*" if width else ""
    align = "l" * (len(columns) - len(numbers)) + "r" * len(numbers)
    head = [rf"\begin{{table{star}}}[{'t' if width else 'htbp'}]", r"\centering", rf"\caption{{{latex_escape(caption)}}}", rf"\label{{{label}}}"]
    head += [rf"\resizebox{{{width}}}{{!}}{{%"] if width else []
    head += [rf"\begin{{tabular}}{{{align}}}", r"\toprule", " & ".join(latex_escape(t) for t in columns.values()) + r" \\", r"\midrule"]
    body, before = [], None
    for row in table.select(*shown).collect():
        again = bool(group_by) and bool(body) and row[group_by] == before
        if group_by and body and not again:
            body.append(r"\midrule")
        before = row[group_by] if group_by else None
        cells = ["" if again and c == group_by else row[c] if c in numbers else latex_escape(row[c] or "") for c in columns]
        body.append(" & ".join(cells) + r" \\")
    foot = [r"\bottomrule", r"\end{tabular}" + ("%" if width else ""), *(["}"] if width else []), rf"\end{{table{star}}}", ""]
    return "\n".join([*head, *body, *foot])


def pivoted(table: DataFrame, metric: str, swap: bool = False, values: list[str] | None = None) -> DataFrame:
    """Models down and strategies across, or the other way round."""
    down, across = KEYS if not swap else KEYS[::-1]
    return table.groupBy(down).pivot(across, values).agg(F.first(metric))


def column_order(groups: list[str], wanted: list[str] | None) -> list[str]:
    if wanted is None:
        return groups
    if sorted(wanted) != sorted(groups):
        raise ValueError(f"the order must name each of {groups} once")
    return wanted


def prefixed(table: DataFrame, prefix: str) -> DataFrame:
    return table.withColumnsRenamed({c: f"{prefix}_{c}" for c in table.columns})
