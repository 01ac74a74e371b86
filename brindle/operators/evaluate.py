"""Evaluation as exact aggregates over a scored table: no sampling, no binning, no collected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions import semantics as S
from brindle.sources import scratch

# What counts as a label that is not the positive class, and as true.
NEGATIVE = ("0", "false", "False", "no")
TRUE = ("1", "true", "yes", "ya")


def positive_class(df: DataFrame, label: str, order: str | list[str] | None = None) -> str:
    """The first label by ``order`` that is not one of the negative spellings, ``"1"`` if there is none."""
    ordered, row = S.row_order(df, order)
    text = S.key(S.required(df, label))
    found = ordered.where(~text.isin(*NEGATIVE) & (text != "")).agg(F.min_by(text, F.col(row))).first()[0]
    return found if found is not None else "1"


def is_positive(c: Column, positive: str) -> Column:
    """Whether rendered text is the positive class; the spellings of true are one class."""
    same = F.lower(c) == positive.lower()
    return same | F.lower(c).isin(*TRUE) if positive.lower() in TRUE else same


def confusion(df: DataFrame, label: str, predicted: str, positive: str = "1") -> DataFrame:
    """One row: ``tp, fp, tn, fn``."""
    y, p = (is_positive(S.key(S.required(df, c)), positive) for c in (label, predicted))
    return df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, label: str, predicted: str, positive: str = "1") -> DataFrame:
    """Accuracy, precision, recall, F1 and specificity in one row."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    precision, recall = _ratio(tp, tp + fp), _ratio(tp, tp + fn)
    return confusion(df, label, predicted, positive).select("tp", "fp", "tn", "fn", _ratio(tp + tn, tp + fp + tn + fn).alias("accuracy"), precision.alias("precision"), recall.alias("recall"), _ratio(2 * precision * recall, precision + recall).alias("f1"), _ratio(tn, tn + fp).alias("specificity"))


def auc(df: DataFrame, label: str, probability: str, positive: str = "1") -> DataFrame:
    """Area under the ROC curve by Mann-Whitney with average tied ranks; NaN when one class is absent.

    Rows are first counted by distinct score, and the counts stored, so that rows are scored once. Ranks are running sums over
    those counts: inside ranges of the score, then over the ranges' totals, so no task sorts all rows."""
    y = is_positive(S.key(S.required(df, label)), positive)
    score = S.to_number(S.required(df, probability))
    counts, _ = scratch.stored(df.select(score.alias("p"), y.cast("long").alias("y")).where("p is not null").groupBy("p").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n")))
    ranked = running_sums(counts, "p", ["n"])
    mean_rank = F.col("before_n") + (F.col("n") + 1) / F.lit(2.0)
    total = ranked.agg(F.sum(F.col("pos") * mean_rank).alias("ranks"), F.coalesce(F.sum("pos"), F.lit(0)).cast("double").alias("pos"), F.coalesce(F.sum(F.col("n") - F.col("pos")), F.lit(0)).cast("double").alias("neg"))
    value = F.try_divide(F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / 2, F.col("pos") * F.col("neg"))
    return total.select(F.coalesce(value, F.lit(float("nan"))).alias("auc"))


def running_sums(df: DataFrame, by: str, columns: list[str], descending: bool = False, ranges: int = 64) -> DataFrame:
    """``before_<c>``: the sum of ``c`` over all rows that come before by the numeric column ``by`` (distinct values).

    Sums run inside ranges cut at approximate quantiles; the ranges' own totals are ``ranges`` rows."""
    cuts = df.agg(F.percentile_approx(by, [i / ranges for i in range(1, ranges)], 50 * ranges)).first()[0] or []
    cuts = sorted(set(cuts))
    part = F.lit(0)
    for i, c in enumerate(cuts):
        part = F.when(F.col(by) > c, i + 1).otherwise(part)
    order = F.col(by).desc() if descending else F.col(by).asc()
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    placed = df.withColumn("_range", part)
    sums = placed.groupBy("_range").agg(*[F.sum(c).alias(f"_all_{c}") for c in columns])
    over = Window.orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_range", *[F.coalesce(F.sum(f"_all_{c}").over(over), F.lit(0)).alias(f"_base_{c}") for c in columns])
    joined = placed.join(F.broadcast(sums), "_range")  # at most ``ranges`` rows
    return joined.select(*df.columns, *[(F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_base_{c}")).alias(f"before_{c}") for c in columns])


def roc_points(df: DataFrame, label: str, probability: str, positive: str = "1", order: str | list[str] | None = None, points: int = 100) -> DataFrame:
    """ROC points by falling score (ties by ``order``): every ``n / points``-th row and the last, with both corners.

    Rows are dealt in ranges of score and order, so a score that most rows share is split; the ranges' sums are one row a
    partition."""
    y = is_positive(S.key(S.required(df, label)), positive)
    ordered, row = S.row_order(df, order)
    rows = ordered.select(S.to_number(S.required(df, probability)).alias("p"), y.cast("long").alias("y"), F.col(row).alias("_order")).where("p is not null")
    path = scratch.folder(df.sparkSession)
    rows.repartitionByRange(F.desc("p"), "_order").withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = df.sparkSession.read.parquet(path)
    sums = dealt.groupBy("_range").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("n"))
    ahead = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    based = sums.select("_range", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(f"before_{c}") for c in ("n", "pos")], F.sum("n").over(total).alias("all"), F.sum("pos").over(total).alias("all_pos"))
    inside = Window.partitionBy("_range").orderBy(F.desc("p"), "_order").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.join(F.broadcast(based), "_range")
    seen = seen.select("p", (F.col("before_n") + F.count(F.lit(1)).over(inside)).alias("k"), (F.col("before_pos") + F.sum("y").over(inside)).alias("tp"), "all", "all_pos")
    stride = F.greatest(F.lit(1), F.floor(F.col("all") / points))
    kept = seen.where((F.pmod(F.col("k") - 1, stride) == 0) | (F.col("k") == F.col("all")))
    shown = kept.select(_ratio(F.col("k") - F.col("tp"), F.col("all") - F.col("all_pos")).alias("fpr"), _ratio(F.col("tp"), F.col("all_pos")).alias("tpr"), F.col("p").alias("threshold"))
    corners = df.sparkSession.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 0.0)], "fpr double, tpr double, threshold double")
    return shown.unionByName(corners)


def class_confusion(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Counts of each actual and predicted class, compared without case."""
    a, p = (F.lower(S.key(S.required(df, c))) for c in (label, predicted))
    return df.groupBy(a.alias("actual"), p.alias("predicted")).agg(F.count(F.lit(1)).alias("count"))


def multiclass_metrics(df: DataFrame, label: str, predicted: str) -> DataFrame:
    """Micro accuracy over all rows, macro accuracy as the mean recall of the classes present, and the number of classes."""
    cells = class_confusion(df, label, predicted)
    right = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("count")).otherwise(0))
    by_class = cells.groupBy("actual").agg(_ratio(right, F.sum("count")).alias("recall"), right.alias("right"), F.sum("count").alias("rows"))
    found = by_class.agg(_ratio(F.sum("right"), F.sum("rows")).alias("micro_accuracy"), F.coalesce(F.avg("recall"), F.lit(0.0)).alias("macro_accuracy"))
    classes = cells.select("actual").union(cells.select("predicted")).distinct().agg(F.count(F.lit(1)).alias("classes"))
    return found.crossJoin(F.broadcast(classes))  # one row each


def regression_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """MAE, MSE, RMSE and R2 (0 for a constant label); pairs with a side that is no number are left out."""
    pairs = df.select(S.to_number(S.required(df, label)).alias("y"), S.to_number(S.required(df, score)).alias("p")).where("y is not null and p is not null")
    gap = F.col("y") - F.col("p")
    found = pairs.agg(F.avg(F.abs(gap)).alias("mae"), F.avg(gap * gap).alias("mse"), F.sum(gap * gap).alias("left"), (F.var_pop("y") * F.count(F.lit(1))).alias("whole"))
    r2 = F.when(F.col("whole") < 1e-12, 0.0).otherwise(1 - F.try_divide(F.col("left"), F.col("whole")))
    return found.select("mae", "mse", F.sqrt("mse").alias("rmse"), F.coalesce(r2, F.lit(0.0)).alias("r2"))


def clustering_metrics(df: DataFrame, cluster: str) -> DataFrame:
    """Number of clusters, largest, smallest and their ratio."""
    sizes = df.groupBy(S.key(S.required(df, cluster)).alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.min("n").alias("smallest")).withColumn("balance", _ratio(F.col("smallest"), F.col("largest")))


def cluster_sizes(df: DataFrame, cluster: str) -> DataFrame:
    return df.groupBy(S.key(S.required(df, cluster)).alias("cluster")).agg(F.count(F.lit(1)).alias("count"))


def anomaly_metrics(df: DataFrame, score: str) -> DataFrame:
    """Mean, maximum, the value at place ``floor(0.95 n)`` of the sorted scores, and how many reach it."""
    v = S.to_number(S.required(df, score))
    counts = df.select(v.alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    placed = running_sums(counts, "v", ["n"])
    total = counts.agg(F.sum("n").alias("all"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean"), F.max("v").alias("max"))
    at = F.floor(F.col("all") * 0.95)
    here = placed.crossJoin(F.broadcast(total)).where((F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n")))
    return here.select("mean", "max", F.col("v").alias("p95"), (F.col("all") - F.col("before_n")).alias("above_p95"))


def residual_sample(df: DataFrame, label: str, score: str, order: str | list[str], points: int = 500) -> DataFrame:
    """Every ``n / points``-th pair by ``order`` for a scatter chart: the chart's limit, not the metrics'.

    Rows are dealt in ranges of the order once and stored: dealt again, ranges may be others than those counted."""
    names = [order] if isinstance(order, str) else order
    rows = df.select(S.to_number(S.required(df, label)).alias("actual"), S.to_number(S.required(df, score)).alias("predicted"), *[S.col(c).alias(f"_o{i}") for i, c in enumerate(names)]).where("actual is not null and predicted is not null")
    names = [f"_o{i}" for i in range(len(names))]
    ranged, _ = scratch.stored(rows.repartitionByRange(*names).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    base = sizes.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"), F.greatest(F.lit(1), F.floor(total / points)).alias("_stride"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*names))
    return ranged.withColumn("_k", inside).join(F.broadcast(base), "_part").where(F.pmod(F.col("_base") + F.col("_k") - 1, F.col("_stride")) == 0).select("actual", "predicted")
