"""Fit, score, compare and explain models."""

from __future__ import annotations

import math
import random
import time
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from itertools import product

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import semantics as S
from brindle.ml.factorization import StratifiedFactorization
from brindle.ml.trainers import TrainerSpec, estimator, feature_stages, spec
from brindle.operators import evaluate as E

PREDICTIONS = ("PredictedLabel", "Score", "Probability", "PredictedClusterId", "alert", "p_value", "spike_score")


@dataclass
class Trained:
    """A fitted pipeline with what it was fitted on."""

    model: PipelineModel
    spec: TrainerSpec
    label: str | None
    features: list[str]
    positive: str = "1"
    notes: dict = field(default_factory=dict)
    data: DataFrame | None = field(default=None, repr=False, compare=False)


def train(s: TrainerSpec, df: DataFrame, label: str | None = None, features: list[str] | None = None, order: str | list[str] | None = None) -> Trained:
    """Fit an algorithm on a frame; features are all columns but the label unless named."""
    task = s.task
    if task == "Recommendation":
        return _recommend(s, df, label)
    features = features or [c for c in df.columns if c.lower() != (label or "").lower()]
    if task == "TextClassification":
        features = [s.parameters["textColumn"]]
        df = S.with_logical(df, features[0], "Text")
    ready, stages, used = feature_stages(df, features, scale=s.algorithm != "algo.multi.naiveBayes")
    positive = "1"
    if task in ("Binary", "Multiclass", "TextClassification"):
        text = S.key(S.required(df, label))
        ready = ready.where(text != "")
        if task == "Binary":
            positive = E.positive_class(df, label, order)
            ready = ready.withColumn("label", E.is_positive(text, positive).cast("double"))
        else:
            ready = ready.withColumn("_label", text)
            stages = [StringIndexer(inputCol="_label", outputCol="label", handleInvalid="skip"), *stages]
    elif task == "Regression":
        ready = ready.withColumn("label", S.to_number(S.required(df, label))).where("label is not null")
        if s.algorithm in ("algo.reg.poisson", "algo.reg.tweedie"):
            ready = ready.where("label >= 0")
    last = estimator(s, len(used))
    model = Pipeline(stages=[*stages, last]).fit(ready)
    notes = {}
    if s.algorithm == "algo.reg.ols":
        summary = model.stages[-1].summary
        notes["coefficients"] = [float(c) for c in model.stages[-1].coefficients]
        try:
            notes["p_values"] = [float(p) for p in summary.pValues]
        except Exception as e:  # singular designs have none
            notes["p_values_missing"] = str(e).splitlines()[0]
    return Trained(model, s, label, used, positive, notes, df)


def _recommend(s: TrainerSpec, df: DataFrame, label: str | None) -> Trained:
    p = s.parameters
    user, item = S.required(df, p["userColumn"]), S.required(df, p["itemColumn"])
    ready = df.withColumn("_user", S.key(user)).withColumn("_item", S.key(item)).withColumn("label", S.to_number(S.required(df, label)).cast("float"))
    learner = StratifiedFactorization(rank=int(p["approximationRank"]), passes=int(p["numberOfIterations"]), rate=float(p["learningRate"]))
    return Trained(Pipeline(stages=[learner]).fit(ready.where("label is not null")), s, label, [user.name, item.name], data=df)


def score(t: Trained, df: DataFrame, append_original: bool = True) -> DataFrame:
    """Add the task's prediction columns, skipping names that are there; labels need not be."""
    task = t.spec.task
    if task == "Recommendation":
        user, item = (S.required(df, c) for c in t.features)
        ready = df.withColumn("_user", S.key(user)).withColumn("_item", S.key(item))
        out = t.model.transform(ready).withColumn("Score", F.col("prediction"))
        added = ["Score"]
    else:
        base = S.with_logical(df, t.features[0], "Text") if task == "TextClassification" else df
        ready, _, _ = feature_stages(base, t.features, scale=t.spec.algorithm != "algo.multi.naiveBayes")
        stages = [x for x in t.model.stages if not (x.hasParam("outputCol") and x.isDefined("outputCol") and x.getOrDefault("outputCol") == "label")]
        out = PipelineModel(stages).transform(ready)
        if task == "Binary":
            out = out.withColumn("PredictedLabel", (F.col("prediction") > 0).cast("int"))
            added = ["PredictedLabel"]
            if "probability" in out.columns:
                out = out.withColumn("Probability", vector_to_array("probability")[1])
                added.append("Probability")
        elif task in ("Multiclass", "TextClassification"):
            labels = next(x.labels for x in t.model.stages if hasattr(x, "labels"))
            out = IndexToString(inputCol="prediction", outputCol="PredictedLabel", labels=list(labels)).transform(out)
            added = ["PredictedLabel"]
        elif task == "Clustering":
            out = out.withColumn("PredictedClusterId", (F.col("prediction") + 1).cast("int"))
            added = ["PredictedClusterId"]
        else:
            out = out.withColumn("Score", F.col("prediction"))
            added = ["Score"]
    fresh = [a for a in added if S.field(df, a) is None]
    return out.select(*(df.columns if append_original else []), *fresh) if append_original else out.select(*added)


def infer_task(df: DataFrame) -> str:
    """The task that a scored frame's columns say."""
    has = lambda c: S.field(df, c) is not None
    if has("PredictedClusterId"):
        return "Clustering"
    if has("PredictedLabel"):
        return "Binary" if has("Probability") else "Multiclass"
    if has("alert") or has("p_value"):
        return "AnomalyDetection"
    return "Regression"


def label_column(df: DataFrame) -> str:
    for name in ("Label", "label", "target", "Target", "y"):
        if name in df.columns:
            return name
    others = [c for c in df.columns if c not in PREDICTIONS]
    if not others:
        raise ValueError("The scored data has no label column.")
    return others[-1]


def evaluate(df: DataFrame, task: str = "auto", label: str | None = None, positive: str | None = None, second: DataFrame | None = None) -> dict[str, float]:
    """The metrics of a scored frame by name; those of a second model are prefixed."""
    task = infer_task(df) if task == "auto" else task
    label = label or (label_column(df) if task not in ("Clustering", "AnomalyDetection") else None)
    if task == "Binary":
        positive = positive or E.positive_class(df, label)
        frames = [E.binary_metrics(df, label, "PredictedLabel", positive)]
        if S.field(df, "Probability"):
            frames.append(E.auc(df, label, "Probability", positive))
    elif task in ("Multiclass", "TextClassification"):
        frames = [E.multiclass_metrics(df, label, "PredictedLabel")]
    elif task in ("Regression", "Recommendation"):
        frames = [E.regression_metrics(df, label, "Score")]
    elif task == "Clustering":
        frames = [E.clustering_metrics(df, "PredictedClusterId")]
    else:
        frames = [E.anomaly_metrics(df, "Score" if S.field(df, "Score") else "spike_score")]
    out: dict[str, float] = {}
    for f in frames:
        out |= {k: float(v) if v is not None else math.nan for k, v in f.first().asDict().items()}
    if second is not None:
        out |= {f"second_{k}": v for k, v in evaluate(second, task, label, positive).items()}
    return out


def headline(task: str, metrics: dict[str, float]) -> float:
    """One number to rank by."""
    names = {"Binary": ("auc", "accuracy"), "Multiclass": ("macro_accuracy",), "TextClassification": ("macro_accuracy",), "Regression": ("r2",), "Recommendation": ("r2",), "Clustering": ("balance",)}
    return next((metrics[n] for n in names.get(task, ()) if n in metrics and not math.isnan(metrics[n])), math.nan)


def _folded(df: DataFrame, folds: int, seed: int, ids: list[str] | None) -> DataFrame:
    """A fold number by a hash of the row: the same for a row however the frame is partitioned."""
    fields = [S.required(df, c) for c in ids] if ids else df.schema.fields
    return df.withColumn("_fold", F.pmod(F.xxhash64(F.lit(seed), *[S.key(f) for f in fields]), F.lit(folds)))


def cross_validate(s: TrainerSpec, df: DataFrame, label: str, features: list[str] | None = None, folds: int = 5, seed: int = 42, ids: list[str] | None = None) -> tuple[list[dict], Trained]:
    """Mean, deviation and extremes of each metric over the folds, and the best fold's model."""
    folds = min(max(folds, 2), 20)
    marked = _folded(df, folds, seed, ids).persist()
    features = features or [c for c in df.columns if c.lower() != label.lower()]
    runs, best = [], None
    try:
        for k in range(folds):
            t = train(s, marked.where(F.col("_fold") != k).drop("_fold"), label, features)
            m = evaluate(score(t, marked.where(F.col("_fold") == k).drop("_fold")), s.task, label, t.positive if s.task == "Binary" else None)
            runs.append(m)
            rank = headline(s.task, m)
            if best is None or rank > best[0] or math.isnan(best[0]):
                best = rank, t
    finally:
        marked.unpersist()
    rows = []
    for name in runs[0]:
        values = [r[name] for r in runs if not math.isnan(r.get(name, math.nan))]
        mean = sum(values) / len(values) if values else math.nan
        sd = math.sqrt(sum((v - mean) ** 2 for v in values) / (len(values) - 1)) if len(values) > 1 else 0.0
        rows.append({"metric": name, "mean": mean, "std_dev": sd, "min": min(values, default=math.nan), "max": max(values, default=math.nan)})
    return rows, best[1]


def parse_grid(text: str) -> dict[str, list]:
    """``name: a, b, c`` a line."""
    out: dict[str, list] = {}
    for line in text.splitlines():
        if ":" in line or "=" in line:
            name, values = line.split(":" if ":" in line else "=", 1)
            out[name.strip()] = [_value(v.strip()) for v in values.split(",") if v.strip()]
    return {k: v for k, v in out.items() if v}


def _value(text: str):
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def sweep(s: TrainerSpec, df: DataFrame, label: str, grid: dict[str, list] | str, mode: str = "grid", iterations: int = 12, seed: int = 42, features: list[str] | None = None, ids: list[str] | None = None) -> tuple[list[dict], Trained]:
    """Score parameter combinations on a held-out fifth; a combination that fails scores NaN, all failing raises."""
    grid = parse_grid(grid) if isinstance(grid, str) else grid
    combos = [dict(zip(grid, values)) for values in product(*grid.values())]
    if mode == "random":
        random.Random(seed).shuffle(combos)
        combos = combos[: max(1, iterations)]
    marked = _folded(df, 5, seed, ids).persist()
    rows, best = [], None
    features = features or [c for c in df.columns if c.lower() != label.lower()]
    try:
        for combo in combos:
            try:
                t = train(s.with_(**combo), marked.where("_fold != 0").drop("_fold"), label, features)
                rank = headline(s.task, evaluate(score(t, marked.where("_fold = 0").drop("_fold")), s.task, label, t.positive if s.task == "Binary" else None))
            except Exception as e:
                rows.append({**combo, "score": math.nan, "error": str(e).splitlines()[0][:200]})
                continue
            rows.append({**combo, "score": rank, "error": None})
            if best is None or rank > best[0]:
                best = rank, t
    finally:
        marked.unpersist()
    if best is None:
        raise RuntimeError("No combination of parameters could be trained.")
    return sorted(rows, key=lambda r: (math.isnan(r["score"]), -r["score"] if not math.isnan(r["score"]) else 0)), best[1]


CANDIDATES = {
    "Binary": ("algo.bin.logistic", "algo.bin.fastForest", "algo.bin.fastTree", "algo.bin.svm"),
    "Multiclass": ("algo.multi.lbfgs", "algo.multi.naiveBayes", "algo.multi.oneVsAll"),
    "Regression": ("algo.reg.ols", "algo.reg.fastForest", "algo.reg.fastTree"),
}


#: What the search draws a parameter's value from.
_DRAWS = {
    "numberOfLeaves": lambda r: r.choice((8, 16, 31, 63)),
    "numberOfTrees": lambda r: r.choice((10, 20, 40)),
    "minimumExampleCountPerLeaf": lambda r: r.choice((2, 5, 10, 20, 50)),
    "learningRate": lambda r: 10 ** r.uniform(-1.5, -0.3),
    "l1Regularization": lambda r: 10 ** r.uniform(-6, -1),
    "l2Regularization": lambda r: 10 ** r.uniform(-6, -1),
    "lambda": lambda r: 10 ** r.uniform(-5, -1),
}


def auto_ml(df: DataFrame, label: str, task: str, max_seconds: int = 60, validation_fraction: float = 0.2, optimize: str | None = None, ids: list[str] | None = None, trials: int = 9, parallel: int = 3, seed: int = 42) -> tuple[list[dict], Trained]:
    """Search algorithms and their parameters until the time is up; a leaderboard with parameters, and the best model.

    First the task's algorithms run as they are, the first always. Then ``trials`` drawn settings are halved by thirds: all
    learn from a ninth of the training rows, the best third from a third of them, and the best of those from all, ``parallel``
    at a time on one cached frame. Only fits on all training rows are listed, so a search never falls behind the plain
    algorithms; no fit begins after the time is up, and a setting that fails is dropped."""
    if task not in CANDIDATES:
        raise ValueError(f"Automatic search does not offer '{task}'.")
    until = time.monotonic() + min(max(max_seconds, 10), 7200)
    parts = max(2, round(1 / min(max(validation_fraction, 0.05), 0.5)))
    marked = _folded(df, parts, seed, ids)
    marked = _folded(marked.withColumnRenamed("_fold", "_part"), 9, seed + 1, ids).persist()
    learnt, checked = marked.where("_part != 0"), marked.where("_part = 0").drop("_part", "_fold")
    features = [c for c in df.columns if c.lower() != label.lower()]
    drawn = random.Random(seed)

    def tried(s: TrainerSpec, share: int) -> dict:
        began = time.monotonic()
        rows = learnt.where(F.col("_fold") % share == 0) if share > 1 else learnt
        t = train(s, rows.drop("_part", "_fold"), label, features)
        m = evaluate(score(t, checked), task, label, t.positive if task == "Binary" else None)
        return {"algorithm": s.algorithm, "parameters": dict(s.parameters), "score": m.get(optimize, math.nan) if optimize else headline(task, m), "seconds": time.monotonic() - began, "model": t, "spec": s}

    def trial(s: TrainerSpec, share: int) -> dict | None:
        if time.monotonic() > until:
            return None
        try:
            found = tried(s, share)
        except Exception:  # a drawn setting may be one that a learner refuses
            return None
        return None if math.isnan(found["score"]) else found

    found: list[dict] = []
    try:
        for algorithm in CANDIDATES[task]:
            if found and time.monotonic() > until:
                break
            s = spec(algorithm)
            found.append(tried(s.with_(numberOfTrees=20) if "numberOfTrees" in s.parameters else s, 1))
        able = [r["spec"] for r in found if any(k in _DRAWS for k in r["spec"].parameters)]
        settings = [s.with_(**{k: _DRAWS[k](drawn) for k in s.parameters if k in _DRAWS}) for s in (able[i % len(able)] for i in range(trials))] if able else []
        with ThreadPoolExecutor(max(1, parallel)) as pool:
            for share in (9, 3, 1):
                done = [r for r in pool.map(lambda s: trial(s, share), settings) if r]
                done.sort(key=lambda r: -r["score"])
                settings = [r["spec"] for r in done[: max(1, len(done) // 3)]]
                found += done if share == 1 else []
    finally:
        marked.unpersist()
    found.sort(key=lambda r: -(r["score"] if not math.isnan(r["score"]) else -math.inf))
    listed = [{"rank": i, **{k: r[k] for k in ("algorithm", "parameters", "score", "seconds")}} for i, r in enumerate(found, 1)]
    return listed, found[0]["model"]


#: Rows that a task deals anew in ``feature_importance``, about.
DEALT = 500_000


def feature_importance(t: Trained, df: DataFrame, permutations: int = 5, seed: int = 42) -> list[dict]:
    """Mean drop of the headline metric when one column's values are dealt anew, largest first.

    Rows are put in hash order within hash partitions, whose number follows the rows, and each takes the values of the next
    one, the last those of the first: one shuffle a permutation for all columns, and no join. A table of one row keeps its values."""
    from pyspark.sql import Window

    def measured(frame: DataFrame) -> float:
        scored = score(t, frame)
        if t.spec.task == "Binary" and S.field(scored, "Probability"):  # the headline alone: one pass over the rows
            area = E.auc(scored, t.label, "Probability", t.positive).first()[0]
            if not math.isnan(area):
                return area
        return headline(t.spec.task, evaluate(scored, t.spec.task, t.label, t.positive if t.spec.task == "Binary" else None))

    base, parts = measured(df), max(1, df.count() // DEALT)
    drops: dict[str, list[float]] = {name: [] for name in t.features}
    values = F.struct(*[F.col(name).alias(f"v{i}") for i, name in enumerate(t.features)])
    ring = Window.partitionBy("_fi_part").orderBy("_fi_place")
    for k in range(permutations):
        placed = df.withColumn("_fi_place", F.xxhash64(F.monotonically_increasing_id(), F.lit(seed + k))).withColumn("_fi_part", F.pmod(F.xxhash64("_fi_place"), F.lit(parts)))
        first = F.first(values).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        dealt = placed.select(*df.columns, F.coalesce(F.lead(values).over(ring), first).alias("_fi_next")).persist()
        try:
            for i, name in enumerate(t.features):
                mixed = dealt.withColumn(name, F.col(f"_fi_next.v{i}").alias(name, metadata=df.schema[name].metadata or {})).select(*df.columns)
                drops[name].append(base - measured(mixed))
        finally:
            dealt.unpersist()
    return sorted(({"feature": name, "importance": sum(d) / len(d)} for name, d in drops.items()), key=lambda r: -r["importance"])


def score_rows(t: Trained, spark, rows: list[dict]) -> list[dict]:
    """A request's rows scored by the model; an empty request is refused."""
    if not rows:
        raise ValueError("Send at least one row.")
    from brindle.sources.readers import from_dictionaries

    df = from_dictionaries(spark, rows)
    for name in t.features:
        if S.field(df, name) is None:
            df = df.withColumn(name, F.lit(None).cast("string"))
    return [r.asDict() for r in score(t, df).collect()]
