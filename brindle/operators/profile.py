"""Column profiles: missing and distinct counts, numeric statistics, top values, equal-width histograms, inferred types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import semantics as S


def _long(df: DataFrame, fields: list[T.StructField]) -> DataFrame:
    """One row per cell: column, rendered text, number, blankness. Feeds aggregates that combine before the shuffle."""
    cells = F.array(*[F.struct(F.lit(f.name).alias("column"), S.render(f).alias("text"), S.to_number(f).alias("number"), S.blank(f).alias("blank")) for f in fields])
    return df.select(F.explode(cells).alias("c")).select("c.*")


def upper_medians(numbers: DataFrame, by: str = "column", value: str = "number") -> DataFrame:
    """``(by, median)``: the upper middle of each group's numbers, exactly. Groups are columns, so they are few.

    Approximate percentiles on both sides of the middle (off by a ten-thousandth of the rows at most) bracket it; only the
    distinct numbers between them are ranked, above a count of those below."""
    near = numbers.groupBy(by).agg(F.count(value).alias("_n"), F.percentile_approx(value, [0.49, 0.51], 10000).alias("_near"))
    wide = numbers.join(F.broadcast(near), by).where(F.col(value) <= F.col("_near")[1])  # one row per column
    inner = F.when(F.col(value) >= F.col("_near")[0], F.col(value)).alias("_v")
    counted = wide.groupBy(by, "_n", inner).agg(F.count(F.lit(1)).alias("_here"))
    reached = F.sum("_here").over(Window.partitionBy(by).orderBy(F.asc_nulls_first("_v")).rowsBetween(Window.unboundedPreceding, 0))
    past = counted.withColumn("_reached", reached).where("_v is not null and _reached > floor(_n / 2)")
    return past.groupBy(by).agg(F.min("_v").alias("median"))


def profile(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: ``missing``, ``distinct`` (without case) and, of its numbers, ``min, max, mean, median, std_dev``.

    The median is the upper middle; ``std_dev`` is the sample's, 0 for one number. Columns without numbers have nulls. The
    statistics of all columns are one pass over the rows; distinct values are counted by a grouping of the cells, whose
    partial counts keep a frequent value to one row per task."""
    fields = [S.required(df, c) for c in columns] if columns else df.schema.fields
    numeric = [f for f in fields if S.logical(f) == "Numeric" or isinstance(f.dataType, T.NumericType)]
    cells = _long(df, fields)
    counted = cells.groupBy("column", F.when(~F.col("blank"), F.lower("text")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    counts = counted.groupBy("column").agg(F.sum(F.when(F.col("value").isNull(), F.col("n")).otherwise(0)).alias("missing"), F.count("value").alias("distinct"))
    numbers = _long(df, numeric).where("not blank and number is not null") if numeric else cells.where("false")
    stats = numbers.groupBy("column").agg(F.min("number").alias("min"), F.max("number").alias("max"), F.avg("number").alias("mean"), F.coalesce(F.stddev_samp("number"), F.lit(0.0)).alias("std_dev"))
    described = counts.join(F.broadcast(stats), "column", "left").join(F.broadcast(upper_medians(numbers)), "column", "left")  # one row per column
    return described.select("column", "missing", "distinct", "min", "max", "mean", "median", "std_dev")


def top_values(df: DataFrame, columns: list[str] | None = None, top: int = 8) -> DataFrame:
    """The ``top`` most frequent non-blank values of each column, without case, ties by value."""
    fields = [S.required(df, c) for c in columns] if columns else df.schema.fields
    counts = _long(df, fields).where("not blank").groupBy("column", F.lower("text").alias("value")).agg(F.count(F.lit(1)).alias("count"))
    rank = F.row_number().over(Window.partitionBy("column").orderBy(F.desc("count"), "value"))
    return counts.withColumn("rank", rank).where(F.col("rank") <= top)


def bin_number(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The equal-width bin of a value: the last bin is closed, a constant column has one bin."""
    width = (high - low) / F.lit(float(bins))
    return F.when(high - low < 1e-12, F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor(F.try_divide(value - low, width)).cast("int")))


def histogram(df: DataFrame, column: str, bins: int = 12) -> DataFrame:
    """Counts per equal-width bin of a column's numbers, with the bins' edges."""
    f = S.required(df, column)
    numbers = df.select(S.to_number(f).alias("v")).where("v is not null")
    ends = numbers.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    placed = numbers.crossJoin(F.broadcast(ends)).withColumn("bin", bin_number(F.col("v"), F.col("low"), F.col("high"), bins))
    width = (F.col("low_end") - F.col("first")) / F.lit(float(bins))
    counted = placed.groupBy("bin").agg(F.count(F.lit(1)).alias("count"), F.first("low").alias("first"), F.first("high").alias("low_end"))
    return counted.select("bin", (F.col("first") + F.col("bin") * width).alias("from"), F.when(width < 1e-12 / bins, F.col("low_end")).otherwise(F.col("first") + (F.col("bin") + 1) * width).alias("to"), "count")


def inferred_types(df: DataFrame) -> DataFrame:
    """Each column's logical type from its first 500 rows."""
    return df.sparkSession.createDataFrame(list(S.infer(df).items()), "column string, logical string")
