"""Scans: delimited text, JSON, Parquet, JDBC, HTTP, inline rows, images; formats guessed from names."""

from __future__ import annotations

import csv
import io
import json
import urllib.request
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import semantics as S
from brindle.sources import arrays, scratch

# Keys under which a JSON object may wrap its rows, and JDBC drivers by provider.
WRAPPERS = ("data", "items", "results", "rows", "value")
DRIVERS = {"sqlite": "org.sqlite.JDBC", "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver", "mysql": "com.mysql.cj.jdbc.Driver", "postgresql": "org.postgresql.Driver"}


FORMATS = {"tsv": "Tsv", "tab": "Tsv", "json": "Json", "jsonl": "Json", "ndjson": "Json", "parquet": "Parquet"}


def guess_format(name: str) -> str:
    """Tsv, Json or Parquet by suffix, else Csv."""
    return FORMATS.get(name.lower().rsplit(".", 1)[-1], "Csv")


def format_of(name: Column) -> Column:
    """``guess_format`` of a column of names."""
    known = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.substring_index(F.lower(name), ".", -1)), F.lit("Csv"))


def named_headers(names: Iterable[str | None]) -> list[str]:
    """Blank headers become ``column_N``, repeated ones get ``_2``, ``_3``, ..."""
    out: list[str] = []
    for i, n in enumerate(names, 1):
        out.append(S.free_name(out, (n or "").strip().lstrip("﻿") or f"column_{i}"))
    return out


def read_delimited(spark: SparkSession, path: str, separator: str = ",", limit: int = 0, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """A file with a header: fields trimmed, missing ones null, extra ones ignored; typed by the first 500 rows.

    ``multi_line`` lets quoted fields hold line breaks, at the price of one task per file; turn it off for large files."""
    options = {"sep": separator, "quote": '"', "escape": '"', "multiLine": multi_line, "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True, "mode": "PERMISSIVE", "encoding": "UTF-8"}
    raw = spark.read.options(**options).option("header", False).csv(path)
    first = raw.first()
    if first is None:
        return spark.createDataFrame([], T.StructType([]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in named_headers(first)])
    df = spark.read.options(**options).option("header", True).option("enforceSchema", True).schema(schema).csv(path)
    df = df.limit(limit) if limit > 0 else df
    return S.typed(df) if infer else df


def read_json(spark: SparkSession, path: str, limit: int = 0, infer: bool = True, lines: bool = False) -> DataFrame:
    """An array of objects, an object that wraps one, or one object per line (``lines``); rows may widen the schema.

    Nested values are kept as JSON text in inferred frames, as Spark types otherwise."""
    df = spark.read.option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    wrapper = next((c for w in WRAPPERS for c in df.columns if c.lower() == w and isinstance(df.schema[c].dataType, T.ArrayType) and isinstance(df.schema[c].dataType.elementType, T.StructType)), None)
    if wrapper and not lines:
        df = df.select(F.inline(S.col(wrapper)))
    df = df.limit(limit) if limit > 0 else df
    if not infer:
        return df
    flat = [F.to_json(S.col(f)).alias(f.name) if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)) else S.col(f) for f in df.schema.fields]
    return S.typed(df.select(*flat))


def read_json_array(spark: SparkSession, path: str, limit: int = 0, infer: bool = True) -> DataFrame:
    """A large array of objects, in one file or many: split between tasks, laid down as lines, and read as those."""
    lines = scratch.folder(spark)
    arrays.elements(spark, path).write.text(lines)
    return read_json(spark, lines, limit, infer, lines=True)


def read_parquet(spark: SparkSession, path: str, limit: int = 0, infer: bool = False) -> DataFrame:
    """Columns keep their stored types; ``infer`` types text columns anew."""
    df = spark.read.parquet(path)
    df = df.limit(limit) if limit > 0 else df
    return S.typed(df) if infer else df


def read(spark: SparkSession, path: str, format: str | None = None, limit: int = 0, infer: bool = True) -> DataFrame:
    kind = format or guess_format(path)
    if kind == "Parquet":
        return read_parquet(spark, path, limit)
    if kind == "Json":
        return read_json(spark, path, limit, infer, lines=path.lower().endswith(("jsonl", "ndjson")))
    return read_delimited(spark, path, "\t" if kind == "Tsv" else ",", limit, infer)


def read_sql(spark: SparkSession, query: str, provider: str = "Sqlite", connection: str | None = None, **options: str) -> DataFrame:
    """A query passed through over JDBC, or run on this session's views when there is no connection.

    ``options`` are the JDBC source's own; with ``partitionColumn``, bounds and ``numPartitions`` the read is split."""
    if not connection:
        return spark.sql(query)
    driver = DRIVERS.get(provider.lower())
    if driver is None:
        raise ValueError(f"Unknown database provider '{provider}'.")
    url = connection if connection.startswith("jdbc:") else f"jdbc:{provider.lower()}:{connection}"
    asked = {"dbtable": f"({query}) asked"} if "partitionColumn" in options else {"query": query}
    return spark.read.format("jdbc").options(url=url, driver=driver, **asked, **options).load()


def parse_headers(text: str | None) -> dict[str, str]:
    """One ``Name: value`` a line."""
    pairs = (line.split(":", 1) for line in (text or "").splitlines() if ":" in line)
    return {k.strip(): v.strip() for k, v in pairs}


def fetch(url: str, headers: dict[str, str]) -> str:
    request = urllib.request.Request(url, headers=headers)
    with urllib.request.urlopen(request, timeout=60) as reply:  # raises for statuses that are not 2xx
        return reply.read().decode("utf-8-sig")


def read_web(spark: SparkSession, url: str, format: str = "Csv", headers: str | None = None, get: Callable[[str, dict[str, str]], str] = fetch) -> DataFrame:
    """A document of bounded size over HTTP, fetched by the driver."""
    body = get(url, parse_headers(headers))
    return inline_csv(spark, body) if format.lower() == "csv" else from_json_text(spark, body)


def inline_csv(spark: SparkSession, text: str) -> DataFrame:
    """Rows typed into the pipeline; the first line is the header."""
    rows = [r for r in csv.reader(io.StringIO(text.lstrip("﻿").strip("\n"))) if r]
    if not rows:
        return spark.createDataFrame([], T.StructType([]))
    names = named_headers(rows[0])
    values = [tuple((r[i].strip() or None) if i < len(r) else None for i in range(len(names))) for r in rows[1:]]
    return S.typed(spark.createDataFrame(values, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def from_json_text(spark: SparkSession, text: str) -> DataFrame:
    """A bare array of objects or an object that wraps one; other things raise."""
    found = json.loads(text)
    if isinstance(found, dict):
        lowered = {k.lower(): v for k, v in found.items()}
        found = next((lowered[w] for w in WRAPPERS if isinstance(lowered.get(w), list)), None)
    if not isinstance(found, list):
        raise ValueError("The JSON is neither an array of objects nor an object that holds one.")
    return from_dictionaries(spark, [r for r in found if isinstance(r, dict)])


def from_dictionaries(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Rows whose keys may differ: columns are the union of keys in order of appearance."""
    names: list[str] = []
    for r in rows:
        names += [k for k in r if k.lower() not in {n.lower() for n in names}]
    if not names:
        return spark.createDataFrame([], T.StructType([]))
    shown = lambda v: None if v is None else (json.dumps(v) if isinstance(v, (dict, list)) else str(v))
    values = [tuple(shown({k.lower(): v for k, v in r.items()}.get(n.lower())) for n in names) for r in rows]
    return S.typed(spark.createDataFrame(values, T.StructType([T.StructField(n, T.StringType()) for n in names])))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as bytes; decoding needs an imaging library, so pixel frames are taken decoded."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.{jpg,jpeg,png}").load(path)


def preview(df: DataFrame, rows: int = 25) -> DataFrame:
    return df.limit(rows)
