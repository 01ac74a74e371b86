"""Cell semantics shared by every operator: blanks, numbers, rendered text, keys, and logical types in field metadata."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOGICAL = ("Unknown", "Numeric", "DateTime", "Boolean", "Text", "Categorical")
_NUMBER = r"^[+-]?(\d[\d,]*\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_OLE_EPOCH_DAYS = 25569


def field(df: DataFrame, name: str) -> T.StructField | None:
    """The field called ``name``, compared without case; null if there is none."""
    wanted = name.strip().lower()
    return next((f for f in df.schema.fields if f.name.lower() == wanted), None)


def required(df: DataFrame, name: str) -> T.StructField:
    found = field(df, name)
    if found is None:
        raise ValueError(f"Column '{name}' is not in the incoming data.")
    return found


def col(f: T.StructField | str) -> Column:
    name = f if isinstance(f, str) else f.name
    return F.col("`" + name.replace("`", "``") + "`")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def blank(f: T.StructField) -> Column:
    """Null, or text of white space only."""
    c = col(f)
    return c.isNull() | c.rlike(r"^\s*$") if isinstance(f.dataType, T.StringType) else c.isNull()


def text_to_number(c: Column) -> Column:
    """Text as a double: a sign, thousands commas, a point, an exponent, or parentheses for a negative; null otherwise."""
    s = F.trim(c)
    inner = F.regexp_extract(s, r"^\((.*)\)$", 1)
    wrapped = s.rlike(r"^\(\s*[\d.,]+\s*\)$")
    body = F.when(wrapped, F.concat(F.lit("-"), F.trim(inner))).otherwise(s)
    return F.when(body.rlike(_NUMBER), F.regexp_replace(body, ",", "").try_cast("double"))


def to_number(f: T.StructField) -> Column:
    """The cell as a double, or null: false and true are 0 and 1, a time is days since 1899-12-30, NaN is null."""
    c, kind = col(f), f.dataType
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(c), c.cast("double"))
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return c.cast("double")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.unix_micros(c.cast("timestamp")) / F.lit(86400e6) + _OLE_EPOCH_DAYS
    if isinstance(kind, T.StringType):
        return text_to_number(c)
    return F.lit(None).cast("double")


def render(f: T.StructField) -> Column:
    """The cell as invariant text; whole doubles have no point. Null stays null."""
    c, kind = col(f), f.dataType
    if isinstance(kind, T.StringType):
        return c
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        plain = F.regexp_replace(c.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
        # Cast only what fits, as a decimal that overflows raises an error.
        size = F.abs(c)
        return F.when((c == 0) | ((size >= 1e-4) & (size < 1e15)), F.when(c == 0, F.lit("0")).otherwise(plain)).otherwise(c.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.when(c, F.lit("True")).when(~c, F.lit("False"))
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(c, "MM/dd/yyyy HH:mm:ss")
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def key(f: T.StructField) -> Column:
    """The cell's key for grouping, joining and duplicates: rendered text, null and the empty text alike."""
    return F.coalesce(render(f), F.lit(""))


def exact_key(f: T.StructField) -> Column:
    """A key that keeps the type where rendering tells no more apart: same groups, without strings to build."""
    return col(f) if isinstance(f.dataType, (T.IntegralType, T.DateType, T.BooleanType)) else key(f)


def row_order(df: DataFrame, order: str | list[str] | None, name: str = "_row") -> tuple[DataFrame, str]:
    """``df`` with a column that orders its rows: the given columns, or the order of the scan."""
    columns = [order] if isinstance(order, str) else list(order or [])
    if columns:
        return df.withColumn(name, F.struct(*[col(required(df, c)) for c in columns])), name
    return df.withColumn(name, F.monotonically_increasing_id()), name


def with_logical(df: DataFrame, name: str, logical: str) -> DataFrame:
    """Record a column's logical type in its field's metadata."""
    f = required(df, name)
    return df.withColumn(f.name, col(f).alias(f.name, metadata={**(f.metadata or {}), "logical": logical}))


def logical(f: T.StructField) -> str:
    """A column's logical type: as recorded, or as its Spark type says."""
    known = (f.metadata or {}).get("logical")
    if known:
        return known
    if isinstance(f.dataType, T.BooleanType):
        return "Boolean"
    if isinstance(f.dataType, T.NumericType):
        return "Numeric"
    if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "DateTime"
    return "Categorical"


def free_name(taken: list[str], name: str) -> str:
    """``name``, or ``name_2``, ``name_3``, ... if it is taken, compared without case."""
    used = {t.lower() for t in taken}
    found, n = name, 2
    while found.lower() in used:
        found, n = f"{name}_{n}", n + 1
    return found


def infer(df: DataFrame, rows: int = 500) -> dict[str, str]:
    """Each column's logical type from its first ``rows`` rows: 90 % must parse for a number, Boolean or time; text is long or varied."""
    head = df.limit(rows)
    asked = []
    for i, f in enumerate(df.schema.fields):
        text = F.trim(F.coalesce(render(f), F.lit("")))
        seen = text != ""
        count = lambda condition: F.count(F.when(condition, 1))
        number = to_number(f) if not isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)) else F.lit(None).cast("double")
        boolean = F.lower(text).isin("true", "false")
        moment = col(f).isNotNull() if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else text.try_cast("timestamp").isNotNull()
        plain = seen & number.isNull() & ~boolean
        asked += [count(seen).alias(f"seen{i}"), count(seen & number.isNotNull()).alias(f"number{i}"), count(seen & number.isNull() & boolean).alias(f"boolean{i}"), count(plain & moment).alias(f"time{i}"), F.max(F.when(seen, F.length(text))).alias(f"long{i}"), F.countDistinct(F.when(seen, F.lower(text))).alias(f"distinct{i}")]
    if not asked:
        return {}
    r = head.agg(*asked).first()
    out = {}
    for i, f in enumerate(df.schema.fields):
        seen = r[f"seen{i}"]
        if not seen:
            out[f.name] = "Unknown"
        elif r[f"number{i}"] >= 0.9 * seen:
            out[f.name] = "Numeric"
        elif r[f"boolean{i}"] >= 0.9 * seen:
            out[f.name] = "Boolean"
        elif r[f"time{i}"] >= 0.9 * seen:
            out[f.name] = "DateTime"
        elif r[f"long{i}"] > 60 or r[f"distinct{i}"] > 0.7 * seen:
            out[f.name] = "Text"
        else:
            out[f.name] = "Categorical"
    return out


def coerce(f: T.StructField, logical_type: str) -> Column:
    """The cell as a logical type; blanks are null."""
    text = F.trim(render(f))
    if logical_type == "Numeric":
        value = to_number(f)
    elif logical_type == "Boolean":
        c = col(f)
        value = c if isinstance(f.dataType, T.BooleanType) else (F.lower(text) == "true") | text.isin("1", "yes", "ya")
    elif logical_type == "DateTime":
        value = col(f).cast("timestamp") if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else text.try_cast("timestamp")
    else:
        value = render(f)
    return F.when(~blank(f), value)


def typed(df: DataFrame, kinds: dict[str, str] | None = None) -> DataFrame:
    """All columns as their inferred (or given) logical types, recorded in metadata. One small job when not given."""
    kinds = kinds or infer(df)
    out = []
    for f in df.schema.fields:
        kind = kinds.get(f.name, "Unknown")
        value = coerce(f, kind) if kind in ("Numeric", "Boolean", "DateTime") else col(f)
        out.append(value.alias(f.name, metadata={"logical": kind}))
    return df.select(*out)
