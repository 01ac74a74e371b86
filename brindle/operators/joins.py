"""Equi-joins on rendered keys, and the join kinds that Spark adds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import semantics as S

KINDS = ("inner", "left", "full", "left_semi", "left_anti", "right")
_EXACT = (T.IntegralType, T.DateType, T.BooleanType)


def join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, kind: str = "inner") -> DataFrame:
    """Join where the keys render alike; null and the empty text match each other.

    The right key is dropped, other right columns that clash get ``_2``, ``_3``, ...; a full join puts an unmatched right
    row's key in the left key column. Keys of one exact type are compared as they are (a null with ``<=>``), so no strings
    are built and statistics still choose the join; others are compared as text."""
    if kind not in KINDS:
        raise ValueError(f"Unknown join kind '{kind}'.")
    lf, rf = S.required(left, left_key), S.required(right, right_key)
    exact = isinstance(lf.dataType, _EXACT) and isinstance(rf.dataType, _EXACT) and isinstance(lf.dataType, T.BooleanType) == isinstance(rf.dataType, T.BooleanType) and isinstance(lf.dataType, T.DateType) == isinstance(rf.dataType, T.DateType)
    taken, renamed = list(left.columns), []
    for f in right.schema.fields:
        if f.name == rf.name:
            continue
        name = S.free_name(taken, f.name)
        taken.append(name)
        renamed.append((f, name))
    key_name = S.free_name(taken, "_right_key")
    shown = S.col(rf) if exact else S.render(rf)
    compared = S.free_name([*taken, key_name], "_right_match")
    r = right.select(shown.alias(key_name), (S.col(rf) if exact else S.key(rf)).alias(compared), *[S.col(f).alias(n, metadata=f.metadata or {}) for f, n in renamed])
    mine = S.col(lf) if exact else S.key(lf)
    both_never_null = not lf.nullable and not rf.nullable
    condition = mine == F.col(compared) if not exact or both_never_null else mine.eqNullSafe(F.col(compared))
    how = {"full": "full_outer"}.get(kind, kind)
    joined = left.join(r, condition, how)
    if kind in ("left_semi", "left_anti"):
        return joined
    key = F.coalesce(S.col(lf), F.col(key_name).cast(lf.dataType) if exact else _as_type(F.col(key_name), lf.dataType)) if kind in ("full", "right") else S.col(lf)
    return joined.select(*[key.alias(f.name, metadata=f.metadata or {}) if f.name == lf.name else S.col(f) for f in left.schema.fields], *[S.col(n) for _, n in renamed])


def _as_type(c, kind: T.DataType):
    return c if isinstance(kind, T.StringType) else c.try_cast(kind)


def as_of(left: DataFrame, right: DataFrame, by: list[str], time: str, keep: list[str], suffix: str = "_asof") -> DataFrame:
    """Each left row with the latest right row at or before its time, by a union and one window: no range join."""
    fields = [S.required(right, c) for c in keep]
    empty = lambda f: F.lit(None).cast(f.dataType)
    l = left.select(*[S.col(c) for c in left.columns], F.lit(1).alias("_side"), *[empty(f).alias(f"_r{i}") for i, f in enumerate(fields)], F.lit(None).cast("boolean").alias("_hit"))
    r = right.select(*[S.col(c) if c in (*by, time) else empty(left.schema[c]).alias(c) for c in left.columns], F.lit(0).alias("_side"), *[S.col(f).alias(f"_r{i}") for i, f in enumerate(fields)], F.lit(True).alias("_hit"))
    from pyspark.sql import Window

    before = Window.partitionBy(*by).orderBy(time, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_hit"), F.struct(*[F.col(f"_r{i}") for i in range(len(fields))])), ignorenulls=True).over(before)
    seen = l.unionByName(r).withColumn("_last", last).where("_side = 1")
    return seen.select(*left.columns, *[F.col(f"_last._r{i}").alias(f.name + suffix) for i, f in enumerate(fields)])
