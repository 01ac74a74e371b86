"""Sinks and the workspace catalogue: datasets with profiles, models with versions, in any storage that Spark can reach.

Locations are Hadoop file system URIs, so a local folder, ``s3a:``, ``abfs:`` or ``hdfs:`` differ by name only. The catalogue is
a folder of small JSON files read as one table; entries are appended, never rewritten.
"""

from __future__ import annotations

import json
import re
import uuid
from datetime import UTC, datetime

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.functions import semantics as S
from brindle.operators import profile as P
from brindle.sources import readers

_DATASETS = "id string, name string, format string, source string, path string, columns int, rows long, created timestamp, profile string"
_MODELS = "name string, version int, description string, path string, task string, label string, features array<string>, example map<string,string>, created timestamp"


def _delete(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def listing(spark: SparkSession, path: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().toString() for s in fs.listStatus(target)) if fs.exists(target) else []


def write(df: DataFrame, path: str, format: str = "Csv", mode: str = "errorifexists") -> None:
    """Write a frame: quoted CSV or TSV with a header, JSON lines, or Parquet."""
    out = df.write.mode(mode)
    if format == "Parquet":
        out.parquet(path)
    elif format == "Json":
        out.option("ignoreNullFields", False).json(path)
    else:
        flat = df.select(*[F.coalesce(S.render(f), F.lit("")).alias(f.name) for f in df.schema.fields])
        flat.write.mode(mode).options(header=True, sep="\t" if format == "Tsv" else ",", quote='"', escape='"', emptyValue="", quoteAll=False).csv(path)


def to_json_array(df: DataFrame) -> DataFrame:
    """A small frame as one JSON array of objects."""
    return df.agg(F.to_json(F.collect_list(F.struct(*[S.col(f) for f in df.schema.fields]))).alias("json"))


class Workspace:
    """Datasets and models under one root URI."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _append(self, table: str, entry: dict) -> None:
        schema = _DATASETS if table == "datasets" else _MODELS
        self.spark.createDataFrame([entry], schema).coalesce(1).write.mode("append").json(f"{self.root}/catalogue/{table}")

    def datasets(self) -> DataFrame:
        """All datasets, newest first."""
        path = f"{self.root}/catalogue/datasets"
        df = self.spark.read.schema(_DATASETS).json(path) if exists(self.spark, path) else self.spark.createDataFrame([], _DATASETS)
        return df.orderBy(F.desc("created"), "id")

    def models(self) -> DataFrame:
        path = f"{self.root}/catalogue/models"
        return self.spark.read.schema(_MODELS).json(path) if exists(self.spark, path) else self.spark.createDataFrame([], _MODELS)

    def save_dataset(self, df: DataFrame, name: str, format: str = "Parquet", source: str = "Generated") -> str:
        """Write, profile and register a frame; gives its id."""
        id = uuid.uuid4().hex
        safe = re.sub(r"[^A-Za-z0-9._-]+", "_", name).strip("_") or "dataset"
        path = f"{self.root}/datasets/{safe}-{id}"
        write(df, path, format)
        stored = self.read_path(path, format)
        profiled = [r.asDict() for r in P.profile(stored).collect()] if stored.columns else []
        self._append("datasets", {"id": id, "name": name, "format": format, "source": source, "path": path, "columns": len(stored.columns), "rows": stored.count(), "created": datetime.now(UTC), "profile": json.dumps(profiled, default=str)})
        return id

    def read_path(self, path: str, format: str, limit: int = 0) -> DataFrame:
        if format == "Json":
            return readers.read_json(self.spark, path, limit, lines=True)
        return readers.read(self.spark, path, format, limit)

    def import_file(self, path: str, name: str | None = None, format: str | None = None) -> str:
        """Parse a file, and keep it as a typed dataset."""
        return self.save_dataset(readers.read(self.spark, path, format), name or path.rsplit("/", 1)[-1], "Parquet", "Imported")

    def _entry(self, id_or_name: str):
        rows = self.datasets().where((F.col("id") == id_or_name) | (F.col("name") == id_or_name)).limit(1).collect()
        if not rows:
            raise ValueError(f"Dataset '{id_or_name}' is not in the workspace.")
        return rows[0]

    def dataset(self, id_or_name: str, limit: int = 0) -> DataFrame:
        """A registered dataset, lazily; no cap unless asked."""
        e = self._entry(id_or_name)
        return self.read_path(e["path"], e["format"], limit)

    def preview(self, id_or_name: str, rows: int = 25) -> DataFrame:
        return self.dataset(id_or_name, rows)

    def list_datasets(self, newest: int = 50) -> DataFrame:
        return self.datasets().select("id", "name", "format", "rows", "columns").limit(newest)

    def describe(self, id_or_name: str) -> list[dict]:
        """The stored profile, without touching the data."""
        return json.loads(self._entry(id_or_name)["profile"])

    def query(self, id_or_name: str, columns: list[str] | None = None, filter: str | None = None, limit: int = 20) -> tuple[int, DataFrame]:
        """Matching rows in number, and at most 100 of them with the asked columns."""
        return query_rows(self.dataset(id_or_name), columns, filter, limit)

    def delete_dataset(self, id: str) -> bool:
        return _delete(self.spark, self._entry(id)["path"])

    def register_model(self, model: PipelineModel, name: str, sample: DataFrame, features: list[str], label: str | None = None, task: str = "", description: str = "") -> int:
        """Save the next version of a model with its inputs and an example of each: the first non-blank of 50 rows."""
        version = (self.models().where(F.col("name") == name).agg(F.max("version")).first()[0] or 0) + 1
        path = f"{self.root}/models/{re.sub(r'[^A-Za-z0-9._-]+', '_', name)}/v{version}"
        model.write().save(path)
        rows = sample.select(*[F.when(~S.blank(f), S.render(f)).alias(f.name) for c in features if (f := S.field(sample, c))]).limit(50).collect()
        example = {c: next((r[c] for r in rows if r[c] is not None), None) for c in (rows[0].asDict() if rows else {})}
        self._append("models", {"name": name, "version": version, "description": description, "path": path, "task": task, "label": label, "features": features, "example": example, "created": datetime.now(UTC)})
        return version

    def model_versions(self, name: str) -> DataFrame:
        return self.models().where(F.col("name") == name).orderBy(F.desc("version"))

    def open_model(self, name: str, version: int | None = None) -> PipelineModel:
        found = self.model_versions(name)
        found = found.where(F.col("version") == version) if version else found
        row = found.limit(1).collect()
        if not row:
            raise ValueError(f"Model '{name}' has no such version.")
        return PipelineModel.load(row[0]["path"])


def query_rows(df: DataFrame, columns: list[str] | None = None, filter: str | None = None, limit: int = 20) -> tuple[int, DataFrame]:
    from brindle.functions.scalars import filter_condition
    from brindle.operators.transforms import select_columns

    found = df.where(filter_condition(df, filter)) if filter else df
    return found.count(), select_columns(found, columns or []).limit(min(max(limit, 1), 100))


def latest_runs(runs: DataFrame, newest: int = 20, by: str = "started") -> DataFrame:
    """The newest runs: a top-k, no full sort."""
    return runs.orderBy(F.desc(by)).limit(newest)


def run_trend(runs: DataFrame, metric: str, by: str = "started") -> DataFrame:
    """A metric over time, of the runs that have it."""
    value = F.from_json("metrics", "map<string,double>")[metric]
    return runs.withColumn("value", value).where("value is not null").orderBy(by).select(by, "value")


def recent_with_names(runs: DataFrame, experiments: DataFrame, newest: int = 8) -> DataFrame:
    """The last runs with their experiments' names; only experiments that occur are joined."""
    last = latest_runs(runs, newest)
    return last.join(experiments.select("experiment_id", "name"), "experiment_id", "left")


def restore_version(versions: DataFrame, experiment: str, version: int) -> DataFrame:
    """All versions with a copy of an old one appended as the newest."""
    mine = versions.where(F.col("experiment_id") == experiment)
    newest = mine.agg((F.max("version") + 1).alias("next"))
    copy = mine.where(F.col("version") == version).crossJoin(F.broadcast(newest)).withColumn("version", F.col("next").cast(versions.schema["version"].dataType)).drop("next")
    return versions.unionByName(copy.select(*versions.columns))


def gallery(items: DataFrame, category: str | None = None) -> DataFrame:
    found = items.where(F.col("category") == category) if category else items
    return found.orderBy("category", "name")


def best_rated(scenes: DataFrame, ratings: DataFrame, newest: int = 60, top: int = 1) -> DataFrame:
    """Of the newest public scenes, the best by average rating, then number of ratings, then points."""
    from brindle.operators.aggregates import average_rating

    recent = scenes.where("is_public").orderBy(F.desc("created"), "scene_id").limit(newest)
    rated = recent.join(average_rating(ratings, "scene_id", "stars"), "scene_id", "left").fillna({"avg_rating": 0.0, "ratings": 0})
    return rated.orderBy(F.desc("avg_rating"), F.desc("ratings"), F.desc("points"), "scene_id").limit(top)


def owned_by(scenes: DataFrame, user: str) -> DataFrame:
    return scenes.where(F.col("user_id") == user).orderBy(F.desc("created"), "scene_id")


def last_messages(messages: DataFrame, session: str, turn: str, turns: int) -> DataFrame:
    """The last ``2 * turns`` messages of each session, in order."""
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))
    return messages.withColumn("_rank", rank).where(F.col("_rank") <= 2 * turns).drop("_rank")
