"""Grouping, value counts, list statistics, and the aggregates over run logs and ratings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import semantics as S

AGGREGATES = ("mean", "sum", "min", "max", "count")


def group_by(df: DataFrame, columns: list[str], aggregate_column: str | None = None, aggregate: str = "mean") -> DataFrame:
    """One aggregate per group; null and the empty text are one group, unknown group columns are ignored.

    Cells that are no numbers are left out: ``sum`` of none is 0, the others are null; ``count`` counts all rows. Keys keep
    their type, text keys merge null into the empty text. Aggregation is partial before the shuffle."""
    if aggregate not in AGGREGATES:
        raise ValueError(f"Unknown aggregate '{aggregate}'.")
    fields = [f for c in columns if (f := S.field(df, c)) is not None]
    if not fields:
        raise ValueError("Pick at least one column to group by.")
    keys = [S.exact_key(f).alias(f.name) for f in fields]
    if aggregate == "count":
        return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))
    f = S.required(df, aggregate_column or "")
    n = S.to_number(f)
    value: Column = {"mean": F.avg(n), "sum": F.coalesce(F.sum(n), F.lit(0.0)), "min": F.min(n), "max": F.max(n)}[aggregate]
    return df.groupBy(*keys).agg(value.alias(f"{aggregate}_{f.name}"))


def value_counts(df: DataFrame, column: str, top: int = 40) -> DataFrame:
    """The most frequent values without case, blanks as ``(empty)``, with the number of distinct values and of rows."""
    f = S.required(df, column)
    shown = F.when(S.blank(f), F.lit("(empty)")).otherwise(F.lower(S.key(f)))
    counts = df.groupBy(shown.alias("value")).agg(F.count(F.lit(1)).alias("count"))
    totals = counts.agg(F.count(F.lit(1)).alias("distinct"), F.coalesce(F.sum("count"), F.lit(0)).alias("total"))
    return counts.orderBy(F.desc("count"), "value").limit(top).crossJoin(F.broadcast(totals))  # totals is one row


def list_statistics(df: DataFrame, column: str) -> DataFrame:
    """Of the numbers listed in each text: count, mean, upper median, extremes, sample standard deviation (0 for one)."""
    parts = F.filter(F.transform(F.split(F.col(column), r"[,;\s]+"), lambda x: S.text_to_number(x)), lambda x: x.isNotNull())
    v = F.array_sort(parts)
    n = F.size(v)
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0))
    spread = F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    deviation = F.when(n > 1, F.sqrt(spread / (n - 1))).when(n == 1, 0.0)
    return df.select("*", n.alias("count"), mean.alias("mean"), F.get(v, F.floor(n / 2).cast("int")).alias("median"), F.get(v, F.lit(0)).alias("min"), F.get(v, n - 1).alias("max"), deviation.alias("std_dev"))


def metric_frequency(runs: DataFrame, column: str = "metrics") -> DataFrame:
    """How often each metric's name occurs in the runs' JSON maps, most frequent first, then by name."""
    flat = runs.select(F.explode(F.from_json(column, "map<string,double>")).alias("metric", "value"))
    return flat.groupBy("metric").agg(F.count(F.lit(1)).alias("runs")).orderBy(F.desc("runs"), "metric")


def average_rating(ratings: DataFrame, by: str, stars: str) -> DataFrame:
    """Mean stars to one decimal (half to even), 0 without ratings, and their number."""
    return ratings.groupBy(by).agg(F.coalesce(F.bround(F.avg(stars), 1), F.lit(0.0)).alias("avg_rating"), F.count(stars).alias("ratings"))


def rollup(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    """Sums over all prefixes of the columns, with the grouping level."""
    return df.rollup(*columns).agg(F.sum(value).alias(f"sum_{value}"), F.grouping_id().alias("level"))


def cube(df: DataFrame, columns: list[str], value: str) -> DataFrame:
    return df.cube(*columns).agg(F.sum(value).alias(f"sum_{value}"), F.grouping_id().alias("level"))
