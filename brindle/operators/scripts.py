"""Whole-table user functions, SQL and expression modules, and what is not offered."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from datetime import date, datetime
from decimal import Decimal
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def python_script(first: DataFrame, function: Callable, schema: str, second: DataFrame | None = None, by: list[str] | None = None, enabled: bool = True) -> DataFrame:
    """Apply ``function`` to pandas frames: per key with ``by`` (one frame or a cogroup of two), else batch by batch.

    A function of a whole table is one that needs its rows together: name the key that bounds a group. Without a key the
    function sees Arrow batches and must not look across them."""
    if not enabled:
        raise PermissionError("Python scripts are switched off for this workspace.")
    if by:
        if second is not None:
            return first.groupBy(*by).cogroup(second.groupBy(*by)).applyInPandas(function, schema)
        return first.groupBy(*by).applyInPandas(function, schema)
    if second is not None:
        raise ValueError("Two inputs need the key columns that join their groups.")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield function(part)

    return first.mapInPandas(run, schema)


#: One value of each kind, from which a script's output columns are told.
_EXAMPLES = {T.BooleanType: True, T.FloatType: 1.0, T.DoubleType: 1.0, T.DecimalType: Decimal(1), T.DateType: date(2000, 1, 1), T.TimestampType: datetime(2000, 1, 1), T.TimestampNTZType: datetime(2000, 1, 1), T.BinaryType: b"a", T.StringType: "a"}
_KINDS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), Decimal: T.DecimalType(38, 10), date: T.DateType(), datetime: T.TimestampType(), bytes: T.BinaryType(), str: T.StringType()}


def _example(kind: T.DataType):
    if isinstance(kind, T.ArrayType):
        return [_example(kind.elementType)]
    if isinstance(kind, T.StructType):
        return {f.name: _example(f.dataType) for f in kind.fields}
    return 1 if isinstance(kind, T.IntegralType) else _EXAMPLES.get(type(kind))


def _columns(make: Callable[[], Any], rows: T.StructType) -> T.StructType:
    """The columns of a script's rows: it is fed one example row, and columns it hands through keep their types."""
    script, row = make(), _example(rows)
    shown = [*script.feed(row), *(script.finish() if hasattr(script, "finish") else ())]
    if not shown:
        raise ValueError("The script gives no row for an example row; give it a method columns(rows) that returns its schema.")
    known = {f.name: f.dataType for f in rows.fields}
    out = T.StructType()
    for name, v in {k: v for r in shown for k, v in r.items()}.items():
        kept = name in known and (v is None or type(v) is type(row[name]))
        if not kept and type(v) not in _KINDS:
            raise ValueError(f"The kind of the script's column '{name}' can't be told from {v!r}; give the script a method columns(rows).")
        out.add(name, known[name] if kept else _KINDS[type(v)])
    return out


def streamed_script(first: DataFrame, make: Callable[[], Any], by: list[str], order: list[str | Column] = (), second: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """A script over whole groups of a table, fed row by row in order: a group may be larger than a worker's memory.

    ``make()`` gives a new script for each group: ``feed(row)`` takes a dictionary and yields dictionaries, and ``finish()``,
    if there is one, yields what is left when the group ends. No schema is asked for: the columns follow from an example row,
    or from ``columns(rows)`` if the script has that method. With ``second`` the rows of both come with a column ``source``, 2 before 1, and gaps
    for the columns that the other lacks. Null keys are one group; an empty table gives no rows; missing output columns are null."""
    if not enabled:
        raise PermissionError("Python scripts are switched off for this workspace.")

    class Script:
        def __init__(self, found: AnalyzeResult):
            self.names, self.script, self.fed = found.schema.names, make(), False

        @staticmethod
        def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
            own = getattr(make(), "columns", None)
            return AnalyzeResult(schema=own(rows.dataType) if own else _columns(make, rows.dataType))

        def _out(self, rows: Iterable[dict] | None):
            for r in rows or ():
                yield tuple(r.get(n) for n in self.names)

        def eval(self, row):
            self.fed = True
            yield from self._out(self.script.feed(row.asDict(True)))

        def terminate(self):
            if self.fed and hasattr(self.script, "finish"):
                yield from self._out(self.script.finish())

    rows, order = first, list(order)
    if second is not None:
        rows = first.withColumn("source", F.lit(1)).unionByName(second.withColumn("source", F.lit(2)), allowMissingColumns=True)
        order = [F.col("source").desc(), *order]
    table = rows.asTable().partitionBy(*by)
    return F.udtf(Script)(table.orderBy(*order) if order else table)


def sql_script(query: str, first: DataFrame, second: DataFrame | None = None, enabled: bool = True) -> DataFrame:
    """A SQL query over ``{dataset1}`` and ``{dataset2}``: the place of scripts in compiled or browser languages."""
    if not enabled:
        raise PermissionError("SQL scripts are switched off for this workspace.")
    frames = {"dataset1": first} | ({"dataset2": second} if second is not None else {})
    return first.sparkSession.sql(query, **frames)


def expression_script(df: DataFrame, columns: dict[str, str], enabled: bool = True) -> DataFrame:
    """New columns from SQL expressions, in generated code."""
    if not enabled:
        raise PermissionError("Expression scripts are switched off for this workspace.")
    return df.withColumns({name: F.expr(e) for name, e in columns.items()})


def r_script(*_, **__):
    raise RuntimeError("R is not installed here; write the step as SQL or Python.")
