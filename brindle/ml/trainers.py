"""Algorithm modules as unfitted Spark estimators, and the features they are fed.

Parameters keep the modules' names. (l1, l2) become an elastic net, trees become iterations or trees, the rate the step size.
MLlib's own trees take the depth that holds so many leaves; those of ``boosting`` are grown leaf by leaf.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.ml import Estimator, Pipeline
from pyspark.ml import classification as C
from pyspark.ml import clustering as K
from pyspark.ml import feature as X
from pyspark.ml import regression as R
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from brindle.functions import semantics as S


@dataclass(frozen=True)
class TrainerSpec:
    """An algorithm with its parameters; ``with_`` copies."""

    algorithm: str
    parameters: dict = field(default_factory=dict)

    def with_(self, **parameters) -> TrainerSpec:
        return replace(self, parameters={**self.parameters, **parameters})

    @property
    def task(self) -> str:
        return TASKS[self.algorithm]


_TREE = {"numberOfLeaves": 20, "numberOfTrees": 100, "minimumExampleCountPerLeaf": 10, "learningRate": 0.2}
_LEAFY = {**_TREE, "numberOfLeaves": 31}
_LINEAR = {"l1Regularization": 0.01, "l2Regularization": 0.01, "maximumNumberOfIterations": 100}

#: Defaults of every algorithm, by id.
DEFAULTS: dict[str, dict] = {
    "algo.bin.logistic": _LINEAR,
    "algo.bin.sdca": _LINEAR,
    "algo.bin.fastTree": _TREE,
    "algo.bin.fastForest": _TREE,
    "algo.bin.lightGbm": _LEAFY,
    "algo.bin.perceptron": {"learningRate": 0.1, "numberOfIterations": 10},
    "algo.bin.svm": {"numberOfIterations": 10, "lambda": 0.001},
    "algo.multi.sdca": _LINEAR,
    "algo.multi.lbfgs": _LINEAR,
    "algo.multi.oneVsAll": _TREE,
    "algo.multi.lightGbm": _LEAFY,
    "algo.multi.naiveBayes": {},
    "algo.reg.sdca": _LINEAR,
    "algo.reg.ols": {"l2Regularization": 0.000001},
    "algo.reg.fastTree": _TREE,
    "algo.reg.fastForest": _TREE,
    "algo.reg.lightGbm": _LEAFY,
    "algo.reg.tweedie": _TREE,
    "algo.reg.poisson": _LINEAR,
    "algo.reg.sgd": {"learningRate": 0.1, "numberOfIterations": 20},
    "algo.cluster.kmeans": {"numberOfClusters": 3, "maximumNumberOfIterations": 100, "initialization": "kmeansPlusPlus"},
    "algo.anomaly.pca": {"rank": 5, "oversampling": 20},
    "algo.anomaly.spike": {"column": None, "confidence": 95, "pvalueHistoryLength": 30, "orderBy": "", "groupBy": ""},
    "algo.rec.matrixFactorization": {"userColumn": None, "itemColumn": None, "approximationRank": 32, "numberOfIterations": 20, "learningRate": 0.1},
    "algo.vision.imageClassification": {"imagePathColumn": None, "imageFolder": None, "epochs": 50, "batchSize": 10},
    "algo.nlp.textClassification": {"textColumn": None, "epochs": 3, "batchSize": 32},
    "algo.forecast.ssa": {"column": None, "horizon": 7, "windowSize": 14, "seriesLength": 60, "orderBy": "", "groupBy": ""},
}
_TASK_OF = {"bin": "Binary", "multi": "Multiclass", "reg": "Regression", "cluster": "Clustering", "anomaly": "AnomalyDetection", "rec": "Recommendation", "vision": "ImageClassification", "nlp": "TextClassification", "forecast": "Forecasting"}
TASKS = {a: _TASK_OF[a.split(".")[1]] for a in DEFAULTS}


def spec(algorithm: str, **parameters) -> TrainerSpec:
    if algorithm not in DEFAULTS:
        raise ValueError(f"Unknown algorithm '{algorithm}'.")
    return TrainerSpec(algorithm, {**DEFAULTS[algorithm], **{k: v for k, v in parameters.items() if v is not None}})


def depth_of(leaves: int) -> int:
    """The smallest depth whose tree holds so many leaves; MLlib allows 30."""
    if leaves < 2:
        raise ValueError("A tree needs at least 2 leaves.")
    return min(30, max(1, math.ceil(math.log2(leaves))))


def estimator(s: TrainerSpec, n_features: int, seed: int = 42) -> Estimator:
    """The estimator over ``features`` and ``label``."""
    p, a = s.parameters, s.algorithm
    l1, l2 = float(p.get("l1Regularization", 0)), float(p.get("l2Regularization", 0))
    net = {"regParam": l1 + l2, "elasticNetParam": l1 / (l1 + l2) if l1 + l2 else 0.0, "maxIter": int(p.get("maximumNumberOfIterations", 100))}
    boost = lambda: {"maxDepth": depth_of(int(p["numberOfLeaves"])), "maxIter": int(p["numberOfTrees"]), "minInstancesPerNode": int(p["minimumExampleCountPerLeaf"]), "stepSize": float(p["learningRate"]), "seed": seed}
    forest = lambda: {"maxDepth": depth_of(int(p["numberOfLeaves"])), "numTrees": int(p["numberOfTrees"]), "minInstancesPerNode": int(p["minimumExampleCountPerLeaf"]), "seed": seed}
    ascent = lambda loss: dual.DualAscent(loss=loss, l1=l1, l2=l2, rounds=net["maxIter"], tolerance=float(p.get("tolerance", 1e-4)), standardize=True)
    leafy = lambda loss: boosting.LeafwiseBoosting(loss=loss, trees=int(p["numberOfTrees"]), leaves=int(p["numberOfLeaves"]), leastRows=int(p["minimumExampleCountPerLeaf"]), rate=float(p["learningRate"]))
    from brindle.ml import boosting, custom, dual, orthant

    make = {
        "algo.bin.logistic": lambda: C.LogisticRegression(family="binomial", **net),
        "algo.bin.sdca": lambda: ascent("two"),
        "algo.bin.fastTree": lambda: C.GBTClassifier(**boost()),
        "algo.bin.fastForest": lambda: C.RandomForestClassifier(**forest()),
        "algo.bin.lightGbm": lambda: leafy("logistic"),
        "algo.bin.perceptron": lambda: custom.AveragedPerceptron(rate=float(p["learningRate"]), epochs=int(p["numberOfIterations"])),
        "algo.bin.svm": lambda: C.LinearSVC(maxIter=int(p["numberOfIterations"]), regParam=float(p["lambda"])),
        "algo.multi.sdca": lambda: ascent("many"),
        "algo.multi.lbfgs": lambda: C.LogisticRegression(family="multinomial", **net),
        "algo.multi.oneVsAll": lambda: C.OneVsRest(classifier=C.GBTClassifier(**boost())),
        "algo.multi.lightGbm": lambda: leafy("softmax"),
        "algo.multi.naiveBayes": lambda: Pipeline(stages=[X.Binarizer(threshold=0.0, inputCol="features", outputCol="binary"), C.NaiveBayes(modelType="bernoulli", featuresCol="binary")]),
        "algo.reg.sdca": lambda: ascent("squares"),
        "algo.reg.ols": lambda: R.LinearRegression(solver="normal", regParam=float(p["l2Regularization"])),
        "algo.reg.fastTree": lambda: R.GBTRegressor(**boost()),
        "algo.reg.fastForest": lambda: R.RandomForestRegressor(**forest()),
        "algo.reg.lightGbm": lambda: leafy("squared"),
        "algo.reg.tweedie": lambda: leafy("tweedie"),
        "algo.reg.poisson": lambda: orthant.PoissonRegression(l1=l1, l2=l2, iterations=net["maxIter"]),
        "algo.reg.sgd": lambda: custom.SgdRegression(rate=float(p["learningRate"]), epochs=int(p["numberOfIterations"])),
        "algo.cluster.kmeans": lambda: K.KMeans(k=int(p["numberOfClusters"]), maxIter=int(p["maximumNumberOfIterations"]), initMode="random" if p["initialization"] == "random" else "k-means||", seed=seed),
        "algo.anomaly.pca": lambda: custom.PcaAnomaly(rank=int(p["rank"]), oversampling=int(p["oversampling"])),
        "algo.nlp.textClassification": lambda: C.LogisticRegression(maxIter=20 * max(1, int(p["epochs"])), regParam=0.01),
    }
    if a == "algo.vision.imageClassification":
        raise RuntimeError("Image classification needs a deep-learning library, which is not installed here.")
    if a not in make:
        raise ValueError(f"'{a}' is fitted by its own operator, not by a feature pipeline.")
    return make[a]()


def feature_stages(df: DataFrame, features: list[str], scale: bool = True) -> tuple[DataFrame, list, list[str]]:
    """``df`` with clean inputs, the stages that build ``features``, and the names of the columns used.

    Numbers pass through, Booleans are 0 or 1, categories are one-hot, text is hashed words by frequency; times and columns
    of unknown type are left out. Gaps are filled by means, then all is scaled to 0..1."""
    numeric, stages, parts, used = [], [], [], []
    out = df
    for name in features:
        f = S.required(df, name)
        kind = S.logical(f)
        safe = f"_in_{len(used)}"
        if isinstance(f.dataType, T.ArrayType):
            from pyspark.ml.functions import array_to_vector

            out = out.withColumn(safe, array_to_vector(F.col(f.name).cast("array<double>")))
            first = out.select(F.size(F.col(f.name)).alias("n")).where("n >= 0").first()
            stages.append(X.VectorSizeHint(inputCol=safe, size=first["n"] if first else 0, handleInvalid="skip"))
            parts.append(safe)
        elif kind in ("Numeric", "Boolean"):
            out = out.withColumn(safe, S.to_number(f))
            numeric.append(safe)
        elif kind == "Categorical":
            out = out.withColumn(safe, F.lower(S.key(f)))
            stages += [X.StringIndexer(inputCol=safe, outputCol=f"{safe}_i", handleInvalid="keep"), X.OneHotEncoder(inputCol=f"{safe}_i", outputCol=f"{safe}_v", handleInvalid="keep", dropLast=False)]
            parts.append(f"{safe}_v")
        elif kind == "Text":
            out = out.withColumn(safe, S.key(f))
            stages += [X.RegexTokenizer(inputCol=safe, outputCol=f"{safe}_w", pattern=r"[^\p{L}\p{N}]+"), X.HashingTF(inputCol=f"{safe}_w", outputCol=f"{safe}_t", numFeatures=1 << 12), X.IDF(inputCol=f"{safe}_t", outputCol=f"{safe}_v")]
            parts.append(f"{safe}_v")
        else:
            continue
        used.append(f.name)
    if not used:
        raise ValueError("None of the chosen columns can be used as a feature.")
    if numeric:
        stages.append(X.Imputer(inputCols=numeric, outputCols=[f"{n}_f" for n in numeric], strategy="mean"))
        parts = [f"{n}_f" for n in numeric] + parts
    stages.append(X.VectorAssembler(inputCols=parts, outputCol="_raw" if scale else "features", handleInvalid="keep"))
    if scale:
        stages.append(X.MinMaxScaler(inputCol="_raw", outputCol="features"))
    return out, stages, used
