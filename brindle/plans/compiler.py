"""From a graph to lazy DataFrame plans: one frame per output port, actions only at sinks, previews and fitting.

A node that fails is recorded; what depends on it is skipped and independent branches go on. A frame with two or more
consumers is persisted for the run, as Spark would compute it anew for each.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import semantics as S
from brindle.ml import custom, training
from brindle.ml.trainers import DEFAULTS, TASKS, TrainerSpec, spec
from brindle.operators import aggregates, completions, features, joins, scripts, transforms
from brindle.plans.graph import Graph, Node
from brindle.plans.modules import MODULES
from brindle.sources import catalogue, readers


@dataclass
class Metrics:
    """A node's figures: a table and a name-to-number map."""

    title: str
    table: list[dict]
    values: dict[str, float]


@dataclass
class NodeResult:
    node: str
    status: str  # succeeded, failed, skipped
    seconds: float = 0.0
    error: str | None = None


@dataclass
class Run:
    results: list[NodeResult]
    outputs: dict[tuple[str, int], Any]
    metrics: dict[str, float]

    @property
    def status(self) -> str:
        return "failed" if any(r.status == "failed" for r in self.results) else "succeeded"


@dataclass
class Context:
    """What nodes may need beyond their inputs."""

    spark: SparkSession
    workspace: catalogue.Workspace | None = None
    tables: Callable[[str], DataFrame] | None = None
    client: completions.Client | None = None
    scripts_enabled: bool = True
    web: Callable = readers.fetch
    persisted: list[DataFrame] = field(default_factory=list)


class Values:
    """A node's parameters: its own, else the module's defaults; blank counts as unset."""

    def __init__(self, node: Node):
        self.node = node
        self.defaults = {p.name: p.default for p in MODULES[node.module].parameters}

    def text(self, name: str) -> str | None:
        own = self.node.parameters.get(name)
        value = own if own is not None and own.strip() else self.defaults.get(name)
        return value if value is not None and value.strip() else None

    def need(self, name: str) -> str:
        value = self.text(name)
        if value is None:
            raise ValueError(f"'{self.node.label}' is missing a value for {name}.")
        return value

    def number(self, name: str, default: float) -> float:
        try:
            return float(self.text(name))
        except (TypeError, ValueError):
            return default

    def whole(self, name: str, default: int) -> int:
        return int(self.number(name, default))

    def flag(self, name: str, default: bool) -> bool:
        return {"true": True, "false": False}.get((self.text(name) or "").lower(), default)

    def list(self, name: str) -> list[str]:
        return [x.strip() for x in re.split(r"[,\n;]", self.text(name) or "") if x.strip()]


Build = Callable[[Context, Values, list], list]


def _source(c: Context, v: Values, _: list) -> list:
    id, limit = v.need("datasetId"), v.whole("sampleRows", 0)
    df = c.tables(id) if c.tables else c.workspace.dataset(id)
    return [df.limit(limit) if limit > 0 else df]


def _completion(ask: Callable[[Values], completions.Ask]) -> Build:
    def build(c: Context, v: Values, i: list) -> list:
        if c.client is None:
            raise ValueError("No language-model client is configured.")
        s = completions.Settings(v.text("provider") or "default", v.number("temperature", 0.2), v.whole("batchSize", 20), v.whole("maxRows", 0))
        return [completions.apply(i[0], ask(v), c.client, s)]

    return build


def _python(c: Context, v: Values, i: list) -> list:
    names: dict[str, Any] = {}
    exec(compile(v.need("code"), "script", "exec"), names)  # the user's own script, as the module is for
    return [scripts.python_script(i[0], names["run"], v.need("schema"), i[1] if len(i) > 1 else None, v.list("keyColumns") or None, c.scripts_enabled)]


def _train(c: Context, v: Values, i: list) -> list:
    s: TrainerSpec = i[0]
    if s.algorithm == "algo.anomaly.spike" or s.algorithm == "algo.forecast.ssa":
        return [_Series(s)]
    return [training.train(s, i[1], v.text("labelColumn"), v.list("featureColumns") or None)]


@dataclass
class _Series:
    """Spikes and forecasts have nothing to fit: the model is its parameters.

    ``groupBy`` names the columns that tell series apart, ``orderBy`` those that order one; unset, all rows are one series
    in the order of the scan, which is one task."""

    spec: TrainerSpec

    def apply(self, df: DataFrame, order: str | None = None) -> DataFrame:
        p = self.spec.parameters
        names = lambda key: [S.required(df, x.strip()).name for x in re.split(r"[,\n;]", str(p[key])) if x.strip()]
        by, listed = names("groupBy") or None, [order] if order else names("orderBy")
        df = df.withColumn("_row", F.struct(*listed) if listed else F.monotonically_increasing_id())
        if self.spec.algorithm == "algo.anomaly.spike":
            return custom.spikes(df, p["column"], "_row", float(p["confidence"]), int(p["pvalueHistoryLength"]), by).drop("_row")
        return custom.forecast(df, p["column"], "_row", int(p["horizon"]), int(p["windowSize"]), int(p["seriesLength"]), by)


def _score(c: Context, v: Values, i: list) -> list:
    return [i[0].apply(i[1]) if isinstance(i[0], _Series) else training.score(i[0], i[1], v.flag("appendOriginal", True))]


def _metrics(title: str, values: dict[str, float]) -> Metrics:
    return Metrics(title, [{"metric": k, "value": x} for k, x in values.items()], values)


def _cross(c: Context, v: Values, i: list) -> list:
    rows, best = training.cross_validate(i[0], i[1], v.need("labelColumn"), v.list("featureColumns") or None, v.whole("folds", 5))
    return [Metrics("Cross-validation", rows, {r["metric"]: r["mean"] for r in rows}), best]


def _sweep(c: Context, v: Values, i: list) -> list:
    rows, best = training.sweep(i[0], i[1], v.need("labelColumn"), v.need("sweep"), v.text("mode") or "random", v.whole("iterations", 12))
    return [best, Metrics("Sweep", rows, {"best": rows[0]["score"]})]


def _auto(c: Context, v: Values, i: list) -> list:
    rows, best = training.auto_ml(i[0], v.need("labelColumn"), v.text("task"), v.whole("maxSeconds", 60), v.number("validationFraction", 0.2), v.text("optimize"))
    return [best, Metrics("Leaderboard", rows, {"best": rows[0]["score"]})]


def _importance(c: Context, v: Values, i: list) -> list:
    rows = training.feature_importance(i[0], i[1], v.whole("permutations", 5))
    return [Metrics("Feature importance", rows, {r["feature"]: r["importance"] for r in rows})]


def _select(c: Context, v: Values, i: list) -> list:
    kept, scores = features.select_features(i[0], v.need("labelColumn"), v.text("method"), v.whole("topN", 10))
    rows = [r.asDict() for r in scores.collect()]
    return [kept, Metrics("Feature scores", rows, {r["feature"]: r["score"] for r in rows})]


def _save(c: Context, v: Values, i: list) -> list:
    c.workspace.save_dataset(i[0], v.text("name") or f"{v.node.label} output", v.text("format") or "Csv")
    return []


def _register(c: Context, v: Values, i: list) -> list:
    t = i[0]
    c.workspace.register_model(t.model, v.need("name"), t.data, t.features, t.label, t.spec.task, v.text("description") or "")
    return []


def _r(c: Context, v: Values, i: list) -> list:
    return scripts.r_script()


BUILD: dict[str, Build] = {
    "data.dataset": _source,
    "data.sql": lambda c, v, i: [readers.read_sql(c.spark, v.need("query"), v.text("provider") or "Sqlite", v.text("connectionString"))],
    "data.web": lambda c, v, i: [readers.read_web(c.spark, v.need("url"), v.text("format") or "Csv", v.text("headers"), c.web)],
    "data.manual": lambda c, v, i: [readers.inline_csv(c.spark, v.text("csv") or "")],
    "tf.selectColumns": lambda c, v, i: [transforms.select_columns(i[0], v.list("columns"), v.text("mode") or "keep")],
    "tf.editMetadata": lambda c, v, i: [transforms.edit_metadata(i[0], v.need("column"), v.text("newName"), v.text("dataType"))],
    "tf.cleanMissing": lambda c, v, i: [transforms.clean_missing(i[0], v.list("columns"), v.text("strategy") or "mean", v.text("constant") or "", v.list("orderBy"))],
    "tf.removeDuplicates": lambda c, v, i: [transforms.remove_duplicates(i[0], v.list("keyColumns"), v.text("keep") or "first", v.list("orderBy"))],
    "tf.filterRows": lambda c, v, i: [transforms.filter_rows(i[0], v.need("column"), v.text("op") or "eq", v.text("value") or "")],
    "tf.splitData": lambda c, v, i: list(transforms.split_data(i[0], v.number("fraction", 0.8), v.text("stratifyColumn"), v.whole("randomSeed", 42), v.list("idColumns") or None)),
    "tf.join": lambda c, v, i: [joins.join(i[0], i[1], v.need("leftKey"), v.need("rightKey"), v.text("kind") or "inner")],
    "tf.groupBy": lambda c, v, i: [aggregates.group_by(i[0], v.list("groupBy"), v.text("aggregateColumn"), v.text("aggregate") or "mean")],
    "tf.normalize": lambda c, v, i: [features.normalize(i[0], v.list("columns") or None, v.text("method") or "minmax", v.whole("bins", 10))],
    "tf.oneHot": lambda c, v, i: [features.one_hot(i[0], v.list("columns"), v.text("method") or "oneHot", v.whole("hashBits", 10))],
    "tf.featurizeText": lambda c, v, i: [features.featurize_text(i[0], v.need("column"), v.text("outputColumn"), v.whole("wordGramLength", 2), v.flag("removeStopWords", True), v.whole("charGramLength", 0))],
    "tf.featureSelection": _select,
    "llm.format": _completion(lambda v: completions.reformat(v.need("column"), v.text("outputColumn"), v.text("targetFormat") or "a consistent format")),
    "llm.cleanse": _completion(lambda v: completions.cleanse(v.need("column"), v.text("outputColumn"), v.text("rules") or "Correct spelling and remove outer white space.")),
    "llm.sentiment": _completion(lambda v: completions.sentiment(v.need("column"), v.text("outputColumn"), v.flag("includeScore", True), v.text("labels"))),
    "llm.classify": _completion(lambda v: completions.classify(v.need("column"), v.text("outputColumn"), v.need("categories"))),
    "llm.extract": _completion(lambda v: completions.extract(v.need("column"), v.need("fields"))),
    "llm.prompt": _completion(lambda v: completions.prompt(v.need("prompt"), v.text("outputColumn"), v.text("systemPrompt") or completions.prompt("").system)),
    "train.model": _train,
    "train.clustering": _train,
    "train.crossValidate": _cross,
    "train.sweep": _sweep,
    "train.autoML": _auto,
    "score.model": _score,
    "score.evaluate": lambda c, v, i: [_metrics("Evaluation", training.evaluate(i[0], v.text("task") or "auto", v.text("labelColumn"), v.text("positiveClass"), i[1] if len(i) > 1 else None))],
    "score.featureImportance": _importance,
    "script.python": _python,
    "script.r": _r,
    "script.csharp": lambda c, v, i: [scripts.sql_script(v.need("code"), i[0], i[1] if len(i) > 1 else None, c.scripts_enabled)],
    "script.js": lambda c, v, i: [scripts.expression_script(i[0], dict(x.split("=", 1) for x in v.need("code").splitlines() if "=" in x), c.scripts_enabled)],
    "out.saveDataset": _save,
    "out.registerModel": _register,
}


def build(c: Context, node: Node, inputs: list) -> list:
    """A node's outputs by port; frames are plans that nothing has run."""
    v = Values(node)
    if node.module in DEFAULTS:
        return [spec(node.module, **{p.name: v.text(p.name) for p in MODULES[node.module].parameters})]
    return BUILD[node.module](c, v, inputs)


def compile_graph(spark: SparkSession, graph: Graph, tables: Callable[[str], DataFrame] | None = None, **context) -> dict[tuple[str, int], Any]:
    """All outputs of a graph; the first failure raises."""
    c, outputs = Context(spark, tables=tables, **context), {}
    for node in graph.ordered():
        made = build(c, node, [outputs[e.source, e.source_port] for e in graph.inbound(node.id)])
        outputs |= {(node.id, port): x for port, x in enumerate(made)}
    return outputs


def run(spark: SparkSession, graph: Graph, tables: Callable[[str], DataFrame] | None = None, timeout: float = 1800, **context) -> Run:
    """Run a graph node by node: failures are recorded, their dependants skipped, figures gathered (the first of a name stays).

    A frame's node has succeeded when its plan is made: what rows make fail shows in the nodes that act on them (training,
    figures, sinks) or when the frame is used. Frames with several readers are kept while the graph runs, no longer."""
    c, outputs, results, figures = Context(spark, tables=tables, **context), {}, [], {}
    until, lost = time.monotonic() + timeout, set()
    try:
        for node in graph.ordered():
            began = time.monotonic()
            inbound = graph.inbound(node.id)
            if began > until or any(e.source in lost for e in inbound):
                lost.add(node.id)
                results.append(NodeResult(node.id, "skipped", error="The run took too long." if began > until else "Something before it failed."))
                continue
            try:
                made = build(c, node, [outputs[e.source, e.source_port] for e in inbound])
                for port, x in enumerate(made):
                    if isinstance(x, DataFrame) and sum(e.source_port == port for e in graph.outbound(node.id)) > 1:
                        c.persisted.append(x := x.persist())
                    outputs[node.id, port] = x
                    if isinstance(x, Metrics):
                        figures = {**x.values, **figures}
                results.append(NodeResult(node.id, "succeeded", time.monotonic() - began))
            except Exception as e:
                lost.add(node.id)
                results.append(NodeResult(node.id, "failed", time.monotonic() - began, str(e).splitlines()[0]))
    finally:
        for df in c.persisted:
            df.unpersist()
    return Run(results, outputs, figures)


__all__ = ["TASKS", "Context", "Metrics", "Run", "compile_graph", "run"]
