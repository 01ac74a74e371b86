"""Leaf-wise boosting against a plain single-machine version that sums every node anew, one split at a time."""

import heapq
import json
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from brindle.ml import boosting as B
from brindle.ml import training
from brindle.ml.trainers import spec


def plain_trees(codes, y, loss, start, rounds, leaves, least_rows, rate):
    """Split lists ``[(node, feature, bin), ...]`` and leaf values, by brute force over rows."""
    score = np.repeat(np.array(start)[:, None], len(y), axis=1)
    out = []
    for _ in range(rounds):
        g, h = loss.steps(score, y)
        grown, moves = [], np.zeros_like(score)
        for k in range(loss.outputs):

            def best(rows, k=k):
                found = (0.0, None)
                whole = g[k, rows].sum() ** 2 / h[k, rows].sum()
                for f in range(len(codes)):
                    for b in np.unique(codes[f, rows]):
                        left = codes[f, rows] <= b
                        if min(left.sum(), (~left).sum()) < least_rows:
                            continue
                        sums = [(g[k, rows[m]].sum(), h[k, rows[m]].sum()) for m in (left, ~left)]
                        if min(s[1] for s in sums) < B.LEAST_HESSIAN:
                            continue
                        gain = sum(a * a / c for a, c in sums) - whole
                        if gain > found[0] + 1e-9 * max(1, abs(gain)):
                            found = gain, (f, int(b))
                return found

            rows = np.arange(len(y))
            gain, split = best(rows)
            heap, splits, count, made = [(-gain, 0, 0, rows, split)], [], 1, 1
            while count < leaves and heap and heap[0][4]:
                _, _, node, rows, (f, b) = heapq.heappop(heap)
                splits.append((node, f, b))
                left = codes[f, rows] <= b
                for child, mine in ((made, rows[left]), (made + 1, rows[~left])):
                    gain, split = best(mine)
                    heapq.heappush(heap, (-gain, child, child, mine, split))
                made += 2
                count += 1
            values = {}
            for _, _, node, rows, _ in heap:
                values[node] = rate * loss.value(g[k, rows].sum(), h[k, rows].sum())
                moves[k, rows] = values[node]
            grown.append((splits, values))
        score = score + moves
        out.append(grown)
    return out, score


def _frame(spark, sf_dir, label):
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return li.select(array_to_vector(F.array(*[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax", "l_linenumber")])).alias("features"), F.expr(label).cast("double").alias("label"))


@pytest.mark.parametrize(
    ("loss", "label"),
    [
        ("squared", "l_extendedprice * (1 + l_discount * l_linenumber)"),
        ("logistic", "case when l_quantity * (1 - l_tax) + 3 * l_linenumber > 40 then 1 else 0 end"),
        ("softmax", "(l_linenumber + cast(l_quantity / 20 as int)) % 3"),
        ("tweedie", "case when l_linenumber > 4 then 0 else l_quantity * exp(5 * l_discount) end"),
    ],
)
def test_trees_equal_the_plain_version(spark, sf_dir, loss, label):
    df = _frame(spark, sf_dir, label).repartition(5).limit(1_500).persist()
    model = B.LeafwiseBoosting(loss=loss, trees=3, leaves=9, leastRows=20, rate=0.3).fit(df)
    kind, start, edges, trees = model.read_out()
    rows = df.collect()
    x, y = np.array([r["features"].toArray() for r in rows]), np.array([r["label"] for r in rows])
    codes = B.codes_of(x, edges)
    wanted, score = plain_trees(codes, y, kind, start, 3, 9, 20, 0.3)
    assert len(trees) == 3
    for got, plain in zip(trees, wanted):
        for tree, (splits, values) in zip(got, plain):
            assert tree.leaves == len(splits) + 1
            # Nodes may be numbered otherwise only if splits came in another order, which they must not.
            assert {n: (tree.feature[n], tree.bin[n]) for n, f in enumerate(tree.feature) if f >= 0} == {n: (f, b) for n, f, b in splits}
            for node, value in values.items():
                assert math.isclose(tree.value[node], value, rel_tol=1e-7, abs_tol=1e-9)
    wide = model.transform(df).select("prediction", *(["probability"] if loss in ("logistic", "softmax") else [])).collect()
    answer = kind.answer(score).T
    for r, a in zip(wide, answer):
        assert np.allclose(r["probability"].toArray() if len(a) > 1 else [r["prediction"]], a, rtol=1e-7)
    df.unpersist()


def test_trees_have_exactly_the_asked_leaves_and_models_are_kept(spark, sf_dir, tmp_path):
    df = _frame(spark, sf_dir, "l_extendedprice")
    model = B.LeafwiseBoosting(trees=12, leaves=31, rate=0.1).fit(df)
    assert [t.leaves for (t,) in model.read_out()[3]] == [31] * 12
    model.write().overwrite().save(str(tmp_path / "m"))
    again = B.LeafwiseModel.load(str(tmp_path / "m"))
    a, b = (m.transform(df).agg(F.sum("prediction")).first()[0] for m in (model, again))
    assert a == b


def test_partitioning_changes_no_split(spark, sf_dir):
    df = _frame(spark, sf_dir, "l_extendedprice").persist()
    one, many = (B.LeafwiseBoosting(trees=2, leaves=16).fit(df.repartition(n)).read_out()[3] for n in (1, 40))
    shape = lambda trees: [[(t.feature, t.bin) for t in r] for r in trees]
    assert shape(one) == shape(many)
    df.unpersist()


def test_degenerate_tables(spark):
    rows = lambda pairs: spark.createDataFrame(pairs, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label")
    same = rows([([1.0], 3.0)] * 50)
    model = B.LeafwiseBoosting(trees=3).fit(same)
    assert model.transform(same).first()["prediction"] == 3.0
    few = rows([([float(i)], float(i)) for i in range(6)])
    model = B.LeafwiseBoosting(trees=1, leaves=31, leastRows=2, rate=1.0).fit(few)
    assert [t.leaves for (t,) in model.read_out()[3]] == [2]
    assert [r["prediction"] for r in model.transform(few).collect()] == [1.0, 1.0, 1.0, 4.0, 4.0, 4.0]
    with pytest.raises(ValueError):
        B.LeafwiseBoosting(leaves=1).fit(few)
    assert json.loads(B.LeafwiseBoosting(trees=1).fit(few.where("label < 0")).getOrDefault("model"))["trees"] in ([], [[vars(B.Tree())]])


def test_boosted_tweedie_beats_the_linear_one_and_minds_all_parameters(spark, sf_dir):
    from pyspark.ml.regression import GeneralizedLinearRegression

    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_quantity", "l_discount", "l_linenumber", F.expr("case when l_linenumber = 3 then 0.0 else 5 + l_quantity * (case when l_discount > 0.05 then 4 else 1 end) end").alias("Label"))
    held = F.pmod("l_orderkey", F.lit(5)) == 0
    fit_on, test_on = li.where(~held), li.where(held)
    names = ["l_quantity", "l_discount", "l_linenumber"]

    def deviance(scored):
        m, y = F.col("Score"), F.col("Label")
        return scored.agg(F.avg(2 * (F.pow(y, 0.5) / -0.25 - y * F.pow(m, -0.5) / -0.5 + F.pow(m, 0.5) / 0.5))).first()[0]

    base = {"numberOfTrees": 20, "numberOfLeaves": 8, "minimumExampleCountPerLeaf": 10, "learningRate": 0.3}
    found = {}
    for change in ({}, {"numberOfTrees": 2}, {"numberOfLeaves": 2}, {"minimumExampleCountPerLeaf": 1500}, {"learningRate": 0.05}):
        t = training.train(spec("algo.reg.tweedie", **{**base, **change}), fit_on, "Label", names)
        found[str(change)] = deviance(training.score(t, test_on))
    assert len(set(found.values())) == 5 and min(found.values()) == found["{}"]
    _, stages, _ = training.feature_stages(fit_on, names)
    from pyspark.ml import Pipeline

    ready, stages, _ = training.feature_stages(fit_on.withColumn("label_", F.col("Label")), names)
    glm = Pipeline(stages=[*stages, GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="label_")]).fit(ready)
    other, _, _ = training.feature_stages(test_on, names)
    assert found["{}"] < 0.5 * deviance(glm.transform(other).withColumn("Score", F.col("prediction")))


def test_refreshed_blocks_lie_in_bounded_files(spark, sf_dir, monkeypatch):
    kept, stored = [], B.scratch.stored
    monkeypatch.setattr(B.scratch, "stored", lambda df, rows=0: kept.append(rows) or stored(df, rows))
    df = _frame(spark, sf_dir, "l_extendedprice").limit(300)
    B.LeafwiseBoosting(trees=3, leaves=3).fit(df)
    assert kept and all(0 < rows * B.BLOCK_ROWS * 17 <= B.FILE_BYTES for rows in kept)
