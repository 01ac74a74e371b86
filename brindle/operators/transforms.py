"""Row and column transforms: select, rename and convert, fill gaps, drop duplicates, filter, split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import semantics as S
from brindle.operators.profile import upper_medians

FILTER_OPS = ("eq", "ne", "gt", "gte", "lt", "lte", "contains", "notEmpty")


def select_columns(df: DataFrame, columns: list[str], mode: str = "keep") -> DataFrame:
    """Keep or drop columns by name without case; an empty list passes all through, unknown names are ignored."""
    if not columns:
        return df
    named = {c.strip().lower() for c in columns}
    keep = [f for f in df.schema.fields if (f.name.lower() in named) == (mode != "drop")]
    return df.select(*[S.col(f) for f in keep])


def edit_metadata(df: DataFrame, column: str, new_name: str | None = None, data_type: str | None = None) -> DataFrame:
    """Rename a column and convert its values to a logical type."""
    f = S.required(df, column)
    name = new_name or f.name
    kind = data_type if data_type in S.LOGICAL else None
    value = S.coerce(f, kind) if kind else S.col(f)
    metadata = {"logical": kind} if kind else (f.metadata or {})
    return df.select(*[value.alias(name, metadata=metadata) if g.name == f.name else S.col(g) for g in df.schema.fields])


def _listed(df: DataFrame, columns: list[str] | None) -> list[T.StructField]:
    if not columns:
        return df.schema.fields
    return [f for c in columns if (f := S.field(df, c)) is not None]


def mode_value(df: DataFrame, f: T.StructField, order: str) -> DataFrame:
    """One row with the most frequent non-blank cell as ``value``; of equal counts the first seen."""
    seen = df.where(~S.blank(f)).groupBy(S.key(f).alias("key")).agg(F.count(F.lit(1)).alias("n"), F.min(F.col(order)).alias("first"), F.min_by(S.col(f), F.col(order)).alias("value"))
    return seen.orderBy(F.desc("n"), F.asc("first")).limit(1).select("value")


def fill_values(df: DataFrame, columns: list[T.StructField], strategy: str, order: str | list[str] | None = None) -> dict[str, object]:
    """What fills each column's gaps by mean, median or mode: one job for the numbers, one more per column that needs its mode."""
    names = {f.name: f"v{i}" for i, f in enumerate(columns)}
    found: dict[str, object] = {}
    if strategy == "median" and columns:
        cells = F.explode(F.array(*[F.struct(F.lit(f.name).alias("column"), S.to_number(f).alias("number")) for f in columns])).alias("c")
        numbers = df.select(cells).select("c.*").where("number is not null")
        found = {r["column"]: r["median"] for r in upper_medians(numbers).collect()}  # one row per column
    elif strategy == "mean" and columns:
        numbers = df.select(*[S.to_number(f).alias(names[f.name]) for f in columns])
        row = numbers.agg(*[F.avg(n).alias(n) for n in names.values()]).first()
        found = {f.name: row[names[f.name]] for f in columns if row[names[f.name]] is not None}
    rest = [f for f in columns if f.name not in found]
    if rest:
        ordered, row = S.row_order(df, order)
        for f in rest:
            value = mode_value(ordered, f, row).first()
            if value is not None:
                found[f.name] = value[0]
    return found


def clean_missing(df: DataFrame, columns: list[str] | None = None, strategy: str = "mean", constant: str = "", order: str | list[str] | None = None) -> DataFrame:
    """Treat blanks: ``dropRow``, ``dropColumn``, ``mean``, ``median``, ``mode`` or ``constant``.

    ``mean`` and ``median`` fall back to the mode where no cell is a number; ``median`` is the upper middle value."""
    fields = _listed(df, columns)
    if strategy == "dropRow":
        return df.where(~S.any_of([S.blank(f) for f in fields]))
    if strategy == "dropColumn":
        row = df.agg(*[F.max(S.blank(f)).alias(f"b{i}") for i, f in enumerate(fields)]).first() if fields else None
        gone = {f.name for i, f in enumerate(fields) if row[f"b{i}"]}
        return df.select(*[S.col(f) for f in df.schema.fields if f.name not in gone])
    values = {f.name: constant for f in fields} if strategy == "constant" else fill_values(df, fields, strategy, order)
    out = []
    for f in df.schema.fields:
        if f.name not in values:
            out.append(S.col(f))
            continue
        value = F.lit(values[f.name])
        value = value.try_cast(f.dataType) if not isinstance(f.dataType, T.StringType) else (F.lit(values[f.name]) if isinstance(values[f.name], str) else _rendered(values[f.name]))
        out.append(F.when(S.blank(f), value).otherwise(S.col(f)).alias(f.name, metadata=f.metadata or {}))
    return df.select(*out)


def _rendered(value: object) -> Column:
    return F.lit(str(int(value)) if isinstance(value, float) and value.is_integer() else str(value))


def remove_duplicates(df: DataFrame, key_columns: list[str] | None = None, keep: str = "first", order: str | list[str] | None = None) -> DataFrame:
    """One row per key, the first or last by ``order``; unknown key names are ignored, and with none left one row survives.

    Rows are picked by an aggregate that combines before the shuffle, so a frequent key costs one row per task."""
    fields = _listed(df, key_columns)
    ordered, row = S.row_order(df, order)
    whole = F.struct(*[S.col(f) for f in df.schema.fields])
    pick = F.max_by if keep == "last" else F.min_by
    keys = [S.exact_key(f).alias(f"_k{i}") for i, f in enumerate(fields)]
    if any(isinstance(f.dataType, T.VariantType) for f in df.schema.fields):
        raise ValueError("variant columns have no order")
    return ordered.groupBy(*keys).agg(pick(whole, F.col(row)).alias("_kept")).select("_kept.*")


def predicate(f: T.StructField, op: str, value: str) -> Column:
    """The filter's condition on one cell; never null.

    Numbers are compared when the cell and the value are numbers (equality within 1e-9, exactly for whole-number columns,
    so that it is pushed down); otherwise equality and ``contains`` compare text without case and orderings are false."""
    if op == "notEmpty":
        return ~S.blank(f)
    text = S.key(f)
    if op == "contains":
        return F.contains(F.lower(text), F.lit(str(value).lower()))
    from brindle.functions.scalars import parse_number

    wanted = parse_number(value)
    same_text = F.lower(text) == F.lit(str(value).lower())
    as_text = {"eq": same_text, "ne": ~same_text}.get(op, F.lit(False))
    if wanted is None:
        return as_text
    if isinstance(f.dataType, (T.IntegralType, T.DoubleType, T.FloatType)):
        c = S.col(f)
        whole = isinstance(f.dataType, T.IntegralType)
        near = (c == F.lit(wanted)) if whole else (F.abs(c - wanted) < 1e-9)
        found = {"eq": near, "ne": ~near, "gt": c > wanted, "gte": c >= wanted, "lt": c < wanted, "lte": c <= wanted}[op]
        if not whole:
            found = found & ~F.isnan(c) if op != "ne" else found | F.isnan(c)
        return found if op in ("gt", "gte", "lt", "lte", "eq") else F.coalesce(found, F.lit(True))
    n = S.to_number(f)
    near = F.abs(n - wanted) < 1e-9
    compared = {"eq": near, "ne": ~near, "gt": n > wanted, "gte": n >= wanted, "lt": n < wanted, "lte": n <= wanted}[op]
    return F.when(n.isNotNull(), compared).otherwise(as_text)


def filter_rows(df: DataFrame, column: str, op: str = "eq", value: str = "") -> DataFrame:
    if op not in FILTER_OPS:
        raise ValueError(f"Unknown filter operator '{op}'.")
    return df.where(predicate(S.required(df, column), op, value))


def split_data(df: DataFrame, fraction: float = 0.8, stratify: str | None = None, seed: int = 42, ids: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Two parts of exactly round-half-even(n * fraction) rows and the rest, of each stratum if asked.

    Rows are ordered by the md5 of the seed and ``ids`` (or all columns). The cut is found by counting the hash's
    first digits, then ranking only the rows of the one prefix it falls in, so no task sees a whole table or stratum."""
    fraction = min(max(fraction, 0.05), 0.95)
    fields = [S.required(df, c) for c in ids] if ids else df.schema.fields
    name = S.free_name(df.columns, "_draw")
    drawn = df.withColumn(name, F.md5(F.concat_ws("-", F.lit(str(seed)), *[S.key(f) for f in fields])))
    if stratify:
        f = S.required(df, stratify)
        sizes = drawn.groupBy(S.key(f).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        rows, groups = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
        if groups and rows / groups < 4:
            raise ValueError(f"'{stratify}' has {groups} distinct values for {rows} rows; stratify by a column with fewer.")
        k, edge, left = (S.free_name(drawn.columns, c) for c in ("_stratum", "_edge", "_left"))
        prefix = F.substring(name, 1, 4)
        counts = drawn.groupBy(S.key(f).alias(k), prefix.alias(edge)).agg(F.count(F.lit(1)).alias("n"))  # 65,536 rows a stratum at most
        before = F.coalesce(F.sum("n").over(Window.partitionBy(k).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = F.bround(F.sum("n").over(Window.partitionBy(k)) * F.lit(fraction))
        cuts = counts.select(k, edge, "n", (wanted - before).alias(left)).where((F.col(left) > 0) & (F.col(left) <= F.col("n"))).drop("n")
        placed = drawn.join(cuts, S.key(f) == F.col(k), "left")
        ranked = placed.where(prefix == F.col(edge)).withColumn("_place", F.row_number().over(Window.partitionBy(k).orderBy(name, *[S.col(g) for g in fields])))
        first = placed.where(prefix < F.col(edge)).select(*df.columns).unionByName(ranked.where(F.col("_place") <= F.col(left)).select(*df.columns))
        rest = placed.where(F.col(edge).isNull() | (prefix > F.col(edge))).select(*df.columns)
        return first, rest.unionByName(ranked.where(F.col("_place") > F.col(left)).select(*df.columns))
    digits = drawn.groupBy(F.substring(name, 1, 4).alias("p")).agg(F.count(F.lit(1)).alias("n")).orderBy("p").collect()  # 65,536 rows at most
    total = sum(r["n"] for r in digits)
    left = round(total * fraction)
    at = None
    for r in digits:
        if left <= r["n"]:
            at = r["p"]
            break
        left -= r["n"]
    if at is None:
        return df, df.limit(0)
    prefix = F.substring(name, 1, 4)
    edge = drawn.where(prefix == at)
    marked = edge.withColumn("_first", F.row_number().over(Window.orderBy(name, *[S.col(g) for g in fields])) <= left)
    first = drawn.where(prefix < at).select(*df.columns).unionByName(marked.where("_first").select(*df.columns))
    second = drawn.where(prefix > at).select(*df.columns).unionByName(marked.where("not _first").select(*df.columns))
    return first, second
