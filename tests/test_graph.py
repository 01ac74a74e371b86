"""Graphs: edits, validation, ordering, running, and models fitted on planted signals."""

import random

import pytest

from brindle import catalogue, ship
from brindle.ml import training
from brindle.ml.trainers import DEFAULTS, spec
from brindle.plans.compiler import compile_graph, run
from brindle.plans.graph import Edge, Graph, GraphError, Node
from brindle.plans.modules import MODULES, listing


def small():
    g = Graph()
    a = g.add("data.manual", csv="kota,nilai\nBandung,10\nBandung,20\nJakarta,40\n")
    b = g.add("tf.groupBy", groupBy="kota", aggregateColumn="nilai", aggregate="mean")
    g.connect(a, b)
    return g, a, b


def test_catalogue_has_all_modules():
    assert len(MODULES) == 63 and set(DEFAULTS) <= set(MODULES)
    assert len(listing("Transform")) == 12


def test_runs_and_round_trips(spark):
    g, _, b = small()
    again = Graph.from_json(g.to_json())
    assert again == g and Graph.from_json("{nonsense") == Graph()
    out = run(spark, again)
    assert out.status == "succeeded"
    assert dict(map(tuple, out.outputs[b, 0].collect())) == {"Bandung": 15.0, "Jakarta": 40.0}


def test_edit_rules():
    g, a, b = small()
    with pytest.raises(GraphError, match="connected already"):
        g.connect(a, b)
    c = g.add("tf.selectColumns")
    g.connect(b, c)
    with pytest.raises(GraphError, match="cycle|connected"):
        g.connect(c, b)
    d = g.add("train.model", labelColumn="nilai")
    with pytest.raises(GraphError, match="takes a UntrainedModel"):
        g.connect(c, d)
    g.set_parameter(c, "columns", "kota")
    with pytest.raises(GraphError):
        g.set_parameter(c, "nothing", "1")
    g.remove(c)
    assert len(g.nodes) == 3 and len(g.edges) == 1


def test_validation():
    assert Graph().validate()[0].severity == "warning"
    g = Graph([Node("a", "tf.filterRows", "F"), Node("b", "gone", "G")])
    said = [i.message for i in g.validate()]
    assert any("nothing connected" in m for m in said) and any("no longer exists" in m for m in said) and any("still needs a value for column" in m for m in said)
    g = Graph([Node("a", "tf.selectColumns"), Node("b", "tf.selectColumns")], [Edge("a", 0, "b", 0), Edge("b", 0, "a", 0)])
    assert any("cycle" in i.message for i in g.validate())
    g = Graph()
    algorithm, model = g.add("algo.cluster.kmeans"), g.add("train.model", labelColumn="y")
    g.connect(algorithm, model)
    assert any("train.clustering" in i.message for i in g.validate())


def test_failure_skips_dependants_only(spark):
    g, a, _ = small()
    bad = g.add("tf.filterRows", column="missing")
    after = g.add("tf.selectColumns")
    g.connect(a, bad)
    g.connect(bad, after)
    r = {x.node: x.status for x in run(spark, g).results}
    assert r[bad] == "failed" and r[after] == "skipped" and sum(s == "succeeded" for s in r.values()) == 2


def test_flagship_pushes_down(spark, sf_dir):
    plan = catalogue.flagship(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThan(l_quantity,20.0)" in plan
    assert "l_comment" not in plan and "o_totalprice" not in plan


def planted(spark, kind):
    rnd = random.Random(31)
    rows = []
    for _ in range(240):
        income, age, city = rnd.uniform(0, 100), rnd.uniform(18, 70), rnd.choice(["a", "b"])
        area = rnd.uniform(20, 200)
        rows.append((income, age, city, area, str(int((income > 55) ^ (rnd.random() < 0.06))), ["kecil", "sedang", "besar"][min(2, int(income // 34))], 3 * area + 12 * age + rnd.uniform(-10, 10)))
    df = spark.createDataFrame(rows, "pendapatan double, usia double, kota string, luas double, beli string, kelas string, harga double")
    return df.select(*{"bin": ["pendapatan", "usia", "kota", "beli"], "multi": ["pendapatan", "usia", "kelas"], "reg": ["luas", "usia", "harga"]}[kind])


@pytest.mark.parametrize("algorithm", ["algo.bin.logistic", "algo.bin.fastTree", "algo.bin.perceptron", "algo.bin.svm", "algo.multi.lbfgs", "algo.reg.ols", "algo.reg.fastForest", "algo.reg.sgd"])
def test_planted_signals_are_learned(spark, algorithm):
    ship(spark)
    kind = algorithm.split(".")[1]
    df = planted(spark, kind)
    label = df.columns[-1]
    small = {"numberOfTrees": 10} if "fast" in algorithm else {}
    gentle = {"l1Regularization": 0.0, "l2Regularization": 0.001} if "logistic" in algorithm or "lbfgs" in algorithm else {}
    t = training.train(spec(algorithm, **small, **gentle), df, label)
    m = training.evaluate(training.score(t, df), t.spec.task, label, "1" if kind == "bin" else None)
    assert {"bin": m.get("accuracy"), "multi": m.get("macro_accuracy"), "reg": m.get("r2")}[kind] > 0.75


def test_model_registry_and_rows(spark, tmp_path):
    from brindle.sources.catalogue import Workspace

    df = planted(spark, "reg")
    t = training.train(spec("algo.reg.ols"), df, "harga")
    w = Workspace(spark, tmp_path.as_uri())
    assert w.register_model(t.model, "rumah", df, t.features, "harga", "Regression") == 1
    assert w.register_model(t.model, "rumah", df, t.features, "harga", "Regression") == 2
    assert [r.version for r in w.model_versions("rumah").collect()] == [2, 1]
    assert w.open_model("rumah").stages
    assert "p_values" in t.notes or "p_values_missing" in t.notes
    got = training.score_rows(t, spark, [{"luas": 100, "usia": 30}])
    assert abs(got[0]["Score"] - (300 + 360)) < 30
    with pytest.raises(ValueError):
        training.score_rows(t, spark, [])


def test_sweep_survives_a_bad_combination(spark):
    df = planted(spark, "reg")
    rows, best = training.sweep(spec("algo.reg.fastTree", numberOfTrees=2), df, "harga", "numberOfLeaves: 8, -1\nlearningRate: 0.1, 0.3")
    assert len(rows) == 4 and sum(r["error"] is not None for r in rows) == 2 and best is not None
    with pytest.raises(RuntimeError):
        training.sweep(spec("algo.reg.fastTree"), df, "harga", {"numberOfLeaves": [-1]})


def test_graph_trains_scores_and_evaluates(spark):
    df = planted(spark, "bin")
    g = Graph()
    data, algorithm, fit, score, judge = g.add("data.dataset", datasetId="x"), g.add("algo.bin.logistic", l1Regularization="0", l2Regularization="0.001"), g.add("train.model", labelColumn="beli"), g.add("score.model"), g.add("score.evaluate", labelColumn="beli")
    g.connect(algorithm, fit, 0, 0)
    g.connect(data, fit, 0, 1)
    g.connect(fit, score, 0, 0)
    g.connect(data, score, 0, 1)
    g.connect(score, judge)
    out = run(spark, g, tables=lambda _: df)
    assert out.status == "succeeded" and out.metrics["auc"] > 0.85
    assert compile_graph(spark, g, tables=lambda _: df)


def test_streaming(spark, tmp_path):
    import time

    from pyspark.sql import functions as F

    from brindle.streaming import events as E

    src = tmp_path / "in"
    spark.range(200).select((F.col("id") % 2).alias("k"), F.timestamp_seconds(F.col("id") * 60).alias("ts"), F.when(F.col("id") == 150, 900.0).otherwise(F.col("id") % 5 + 0.0).alias("v")).write.json(str(src))
    stream = spark.readStream.schema("k long, ts timestamp, v double").json(str(src))
    q = E.windowed(stream, "ts", "1 hour", by=["k"], value="v").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("select sum(count) from w").first()[0] == 200
    q = E.stream_spikes(stream, "k", "v", "ts").writeStream.format("memory").queryName("s").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [tuple(r) for r in spark.sql("select value, alert from s where alert").collect()] == [(900.0, True)]
    seen = []
    q = E.file_queue(spark, str(src), "k long, ts timestamp, v double", lambda df, n: seen.append(df.count()), (tmp_path / "cp").as_uri())
    q.awaitTermination(120)
    assert sum(seen) == 200 and time.time() > 0


def test_registered_model_has_an_example(spark, tmp_path):
    from brindle.sources.catalogue import Workspace

    g = Graph()
    rows = g.add("data.manual", csv="x,y\n1,2\n2,4\n3,6\n4,8")
    algorithm, model = g.add("algo.reg.ols"), g.add("train.model", labelColumn="y")
    out = g.add("out.registerModel", name="line")
    g.connect(algorithm, model)
    g.connect(rows, model, 0, 1)
    g.connect(model, out)
    w = Workspace(spark, str(tmp_path))
    assert run(spark, g, workspace=w).status == "succeeded"
    kept = w.model_versions("line").first()
    assert kept.version == 1 and kept.example == {"x": "1"}


def test_series_of_a_graph_are_told_apart(spark):
    lines = "\n".join(f"{s},{i},{900 if (s, i) == ('a', 25) else (i % 3) + (500 if s == 'b' else 0)}" for i in reversed(range(40)) for s in "ab")
    g = Graph()
    rows = g.add("data.manual", csv=f"s,i,v\n{lines}")
    spikes = g.add("algo.anomaly.spike", column="v", groupBy="s", orderBy="i", confidence="99")
    model, scored = g.add("train.model", labelColumn="v"), g.add("score.model")
    g.connect(spikes, model)
    g.connect(rows, model, 0, 1)
    g.connect(model, scored)
    g.connect(rows, scored, 0, 1)
    r = run(spark, g)
    assert r.status == "succeeded", r.results
    out = r.outputs[scored, 0]
    assert out.columns == ["s", "i", "v", "spike_score", "p_value", "alert"]
    assert [(x.s, int(x.i)) for x in out.where("alert = 1 and i > 5").collect()] == [("a", 25)]


def test_importance_ranks_the_planted_column(spark, monkeypatch):
    rows = [(float(i % 2), float(i % 7), i % 2) for i in range(400)]
    df = spark.createDataFrame(rows, "signal double, noise double, Label int")
    t = training.train(spec("algo.bin.logistic", l1Regularization=0.0), df, "Label")
    monkeypatch.setattr(training, "DEALT", 100)  # several partitions
    found = training.feature_importance(t, df, 2)
    assert [r["feature"] for r in found] == ["signal", "noise"]
    assert found[0]["importance"] > 0.3 and abs(found[1]["importance"]) < 0.1
    assert df.columns == ["signal", "noise", "Label"]
