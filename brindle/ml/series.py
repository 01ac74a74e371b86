"""Long series: places, products of lagged vectors and singular spectrum forecasts, with no series in one task.

Values are sorted by range over (series, order) and written once; a value's place is its place in its range plus the values
of its series in earlier ranges. A series is then cut into pieces of so many values; each piece also gets the first ``window - 1``
values of the next one, so that every lagged vector lies in one piece. Pieces give sums of products, which are added.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.ml.custom import recurrent_forecast
from brindle.sources import scratch

PIECE = 50_000


def placed(df: DataFrame, column: str, order: str, by: list[str] | None = None, last: int | None = None) -> DataFrame:
    """``(by..., _at, _v)``: the values of each series and their places from 0, gaps left out; only the ``last`` ones if given.

    Values of equal order follow by value. The table is in the shared folder."""
    by = by or []
    rows = df.select(*by, F.col(column).cast("double").alias("_v"), F.col(order).alias("_o")).where("_v is not null")
    keys = [*by, "_o", "_v"]
    sorted_ = rows.repartitionByRange(*keys, F.monotonically_increasing_id()).sortWithinPartitions(*keys).select(*by, "_v", F.monotonically_increasing_id().alias("_id"))
    table, _ = scratch.stored(sorted_)
    part = F.shiftright("_id", 33)
    runs = table.groupBy(*by, part.alias("_part")).agg(F.min("_id").alias("_from"), F.count(F.lit(1)).alias("_rows"))
    series = Window.partitionBy(*by)
    before = F.coalesce(F.sum("_rows").over(series.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A series has a row here for each range that it reaches into.
    shifts = runs.withColumn("_shift", before - F.col("_from")).withColumn("_n", F.sum("_rows").over(series)).drop("_from", "_rows")
    same = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in by]
    on = F.col("t._part") == F.col("s._part")
    for s in same:
        on = on & s
    met = table.withColumn("_part", part).alias("t").join(shifts.alias("s"), on)
    found = met.select(*[F.col(f"t.{c}").alias(c) for c in by], (F.col("_id") + F.col("_shift")).alias("_at"), "_v", "_n")
    if last is not None:
        found = found.where(F.col("_at") >= F.col("_n") - last).withColumn("_at", F.col("_at") - F.greatest(F.col("_n") - last, F.lit(0)))
    return found.drop("_n")


def _repeated(part: pd.DataFrame, by: list[str], n: int) -> dict[str, pd.Series]:
    """The group's keys as columns of ``n`` rows."""
    return {c: pd.Series([None if pd.isna(part[c].iloc[0]) else part[c].iloc[0]] * n, dtype=object) for c in by}


def lag_products(values: DataFrame, window: int, by: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """``(by..., cell, product)``: entry ``cell // window, cell % window`` of the sum of all lagged vectors' outer products."""
    by = by or []
    if piece < window:
        raise ValueError("A piece must hold a window.")
    own = F.floor(F.col("_at") / piece)
    pieces = F.when((F.col("_at") % piece < window - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    dealt = values.withColumn("_piece", F.explode(pieces))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x = part.sort_values("_at")["_v"].to_numpy()
        lagged = np.lib.stride_tricks.sliding_window_view(x, window) if len(x) >= window else np.zeros((0, window))
        return pd.DataFrame({**_repeated(part, by, window**2), "cell": np.arange(window**2, dtype=np.int32), "product": (lagged.T @ lagged).ravel()})

    schema = ", ".join([*(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in by), "cell int, product double"])
    return dealt.groupBy(*by, "_piece").applyInPandas(run, schema).groupBy(*by, "cell").agg(F.sum("product").alias("product"))


def forecast(df: DataFrame, column: str, order: str, horizon: int = 7, window: int = 14, series_length: int = 60, by: list[str] | None = None, piece: int = PIECE) -> DataFrame:
    """What ``custom.forecast`` gives, where a task holds a piece of a series or ``window * window`` sums."""
    keys = by or []
    values = placed(df, column, order, by, max(series_length, 2 * window))
    products = lag_products(values, window, by, piece).select(*keys, F.lit(0).alias("_kind"), F.col("cell").cast("long").alias("_at"), F.col("product").alias("_v"))
    ends = values.groupBy(*keys).agg((F.max("_at") + 1).alias("_n"))
    short = ends.where(F.col("_n") < 2 * window).select("_n").first()
    if short or not ends.limit(1).count():
        raise ValueError(f"The series has {short['_n'] if short else 0} values; a window of {window} needs {2 * window}.")
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"s.{c}")) for c in keys]
    t, s = values.alias("t"), ends.alias("s")
    tails = t.join(s, on) if on else t.crossJoin(F.broadcast(s))  # one row without keys
    tails = tails.where(F.col("_at") >= F.col("_n") - (2 * window - 2)).select(*[F.col(f"t.{c}").alias(c) for c in keys], F.lit(1).alias("_kind"), "_at", "_v")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        kinds = [part[part["_kind"] == k].sort_values("_at")["_v"].to_numpy() for k in (0, 1)]
        found = recurrent_forecast(kinds[0].reshape(window, window), kinds[1], window, horizon)
        return pd.DataFrame({**_repeated(part, keys, horizon), "step": np.arange(1, horizon + 1, dtype=np.int32), "forecast": found})

    schema = ", ".join([*(f"`{c}` {values.schema[c].dataType.simpleString()}" for c in keys), "step int, forecast double"])
    both = products.unionByName(tails)
    return (both.groupBy(*keys) if keys else both.groupBy(F.lit("all"))).applyInPandas(run, schema)
