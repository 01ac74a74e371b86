"""Single operators on literal tables: the rules that the driver's tables cannot show."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.functions import semantics as S
from brindle.ml import custom
from brindle.operators import aggregates, completions, evaluate, features, imaging, joins, profile, scripts, transforms
from brindle.sources import catalogue, readers


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_numbers_in_text(spark):
    given = ["42", " 1,234.5 ", "(5)", "-.5", "1e3", "12d", "", None, "x", "1.2.3", "+7"]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, v string")
    got = [r[0] for r in df.orderBy("i").select(S.to_number(df.schema["v"])).collect()]
    assert got == [42.0, 1234.5, -5.0, -0.5, 1000.0, None, None, None, None, None, 7.0]
    assert [scalars.parse_number(g) for g in given] == got


def test_rendering(spark):
    df = spark.createDataFrame([(1.0, True), (123456789.5, False), (0.1, None), (None, True), (-3.0, True), (0.0, True)], "v double, b boolean")
    got = df.select(S.render(df.schema["v"]).alias("v"), S.render(df.schema["b"]).alias("b")).collect()
    assert [r.v for r in got] == ["1", "123456789.5", "0.1", None, "-3", "0"]
    assert [r.b for r in got][:3] == ["True", "False", None]


def test_type_inference(spark):
    data = [(str(i), ["a", "b"][i % 2], f"text number {i} that is long enough to be told from a category by length", "true", ["ya", "tidak"][i % 2], f"2024-01-{i + 1:02d}", None) for i in range(20)]
    df = spark.createDataFrame(data, "n string, c string, t string, b string, y string, d string, u string")
    assert S.infer(df) == {"n": "Numeric", "c": "Categorical", "t": "Text", "b": "Boolean", "y": "Categorical", "d": "DateTime", "u": "Unknown"}


def test_mean_and_mode_fill(spark):
    df = spark.createDataFrame([(10.0, "Bandung"), (None, "Bandung"), (20.0, None)], "nilai double, kota string")
    assert sorted(r.nilai for r in transforms.clean_missing(df, ["nilai"], "mean").collect()) == [10, 15, 20]
    assert [r.kota for r in transforms.clean_missing(df, ["kota"], "mean").collect()].count("Bandung") == 3


def test_upper_median_and_mode_ties(spark):
    df = spark.createDataFrame([(i, v, w) for i, (v, w) in enumerate([(1.0, "b"), (2.0, "a"), (3.0, "a"), (4.0, "b"), (None, None)])], "i int, v double, w string")
    assert transforms.clean_missing(df, ["v"], "median").where("i = 4").first().v == 3.0
    assert transforms.clean_missing(df, ["w"], "mode", order="i").where("i = 4").first().w == "b"


def test_drop_rows_and_columns(spark):
    df = spark.createDataFrame([(1, 2), (3, None), (5, 6)], "a int, b int")
    assert transforms.clean_missing(df, None, "dropRow").count() == 2
    assert transforms.clean_missing(df, None, "dropColumn").columns == ["a"]


def test_select_is_case_insensitive_and_empty_passes(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert transforms.select_columns(df, ["C", "a"]).columns == ["a", "c"]
    assert transforms.select_columns(df, ["a", "c"], "drop").columns == ["b"]
    assert transforms.select_columns(df, []).columns == ["a", "b", "c"]


def test_filters(spark):
    df = spark.createDataFrame([(1, "Ten"), (2, None), (3, "30"), (4, "")], "i int, v string")
    ids = lambda op, value="": {r.i for r in transforms.filter_rows(df, "v", op, value).collect()}
    assert ids("ne", "ten") == {2, 3, 4}
    assert ids("eq", "30.0") == {3}
    assert ids("gt", "5") == {3}
    assert ids("contains", "E") == {1}
    assert ids("notEmpty") == {1, 3}
    assert ids("lt", "zzz") == set()


def test_duplicates_keep_first_and_last(spark):
    df = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("y", 3.0), (None, 4.0), ("", 5.0)], "id string, v double")
    assert rows(transforms.remove_duplicates(df, ["id"], "first", "v").select("v"), "v") == [(1.0,), (3.0,), (4.0,)]
    assert rows(transforms.remove_duplicates(df, ["id"], "last", "v").select("v"), "v") == [(2.0,), (3.0,), (5.0,)]
    assert transforms.remove_duplicates(df, ["nothing"], order="v").count() == 1


def test_split(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(50)], "fitur int, kelas string")
    a, b = transforms.split_data(df, 0.8)
    assert (a.count(), b.count()) == (40, 10) and not a.intersect(b).count()
    a, b = transforms.split_data(df, 0.8, "kelas")
    assert sorted(r["count"] for r in a.groupBy("kelas").count().collect()) == [20, 20]
    assert transforms.split_data(df, 0.8)[0].exceptAll(transforms.split_data(df, 0.8)[0]).count() == 0
    with pytest.raises(ValueError):
        transforms.split_data(df, 0.8, "fitur")


def test_join_kinds(spark):
    left = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "n")], "id string, nama string")
    right = spark.createDataFrame([(1, "x", 7), (3, "z", 8)], "id_pel int, kota string, nama int")
    assert rows(joins.join(left, right, "id", "id_pel").select("id", "nama", "kota", "nama_2")) == [("1", "a", "x", 7)]
    assert joins.join(left, right, "id", "id_pel", "left").count() == 3
    assert {r.id for r in joins.join(left, right, "id", "id_pel", "full").collect()} == {"1", "2", None, "3"}
    twice = left.union(left)
    assert joins.join(twice, twice, "id", "id").count() == 12


def test_group_by(spark):
    df = spark.createDataFrame([("Bandung", "10"), ("Bandung", "20"), ("Jakarta", "40"), (None, "x"), ("", None)], "kota string, nilai string")
    got = dict(rows(aggregates.group_by(df, ["kota"], "nilai", "mean")))
    assert got == {"Bandung": 15.0, "Jakarta": 40.0, "": None}
    assert dict(rows(aggregates.group_by(df, ["kota"], "nilai", "sum")))[""] == 0.0
    assert dict(rows(aggregates.group_by(df, ["kota"], None, "count")))[""] == 2
    with pytest.raises(ValueError):
        aggregates.group_by(df, ["nothing"], "nilai", "sum")


def test_profile_and_histogram(spark):
    df = spark.createDataFrame([("10",), ("20",), (None,), ("30",), ("",)], "nilai string")
    p = profile.profile(S.typed(df)).first()
    assert (p.missing, p.distinct, p.min, p.max, p.mean, p.median) == (2, 3, 10, 30, 20, 20)
    h = profile.histogram(spark.createDataFrame([(5.0,)] * 3, "v double"), "v").collect()
    assert [(r.bin, r["count"]) for r in h] == [(0, 3)]
    assert profile.histogram(spark.createDataFrame([], "v double"), "v").count() == 0


def test_scaling(spark):
    df = spark.createDataFrame([(10.0, 5.0), (20.0, 5.0), (30.0, 5.0)], "nilai double, tetap double")
    assert rows(features.normalize(df, None, "minmax"), "nilai") == [(0.0, 0.0), (0.5, 0.0), (1.0, 0.0)]
    assert rows(features.normalize(df, ["nilai"], "binning", 2).select("nilai"), "nilai") == [(0.0,), (1.0,), (1.0,)]
    text = spark.createDataFrame([("1",), ("x",), ("3",)], "v string")
    assert {r.v for r in features.normalize(text, ["v"]).collect()} == {"0", "x", "1"}


def test_one_hot(spark):
    df = spark.createDataFrame([("merah",), ("biru",), ("Merah",), (None,)], "warna string")
    out = features.one_hot(df, ["warna"])
    assert out.columns == ["warna_", "warna_biru", "warna_Merah"]
    assert [r[0] for r in features.one_hot(df, ["warna"], "ordinal").orderBy("warna").collect()] == [0, 1, 2, 2]
    with pytest.raises(ValueError):
        features.one_hot(spark.range(250).select(F.col("id").cast("string")), ["id"])


def test_text_features(spark):
    df = spark.createDataFrame([("The cat sat. The cat ran!",), ("A cat; a dog",), (None,)], "t string")
    out = [r.f.split() for r in features.featurize_text(df, "t", "f").collect()]
    assert len({len(x) for x in out}) == 1 and out[0] == ["2"] and out[2] == ["0"]


def test_feature_selection_ranks_the_signal_first(spark):
    df = spark.createDataFrame([(float(i), float(i * 37 % 11), float(i > 50)) for i in range(100)], "sinyal double, derau double, kelas double")
    for method in ("correlation", "mutualInformation"):
        scores = {r.feature: r.score for r in features.feature_scores(df, "kelas", method).collect()}
        assert scores["sinyal"] > scores["derau"] >= 0
    assert features.select_features(df, "kelas", top=1)[0].columns == ["sinyal", "kelas"]


def test_binary_metrics_and_auc(spark):
    data = [("1", "1", 0.9), ("1", "1", 0.8), ("1", "0", 0.3), ("0", "0", 0.2), ("0", "0", 0.1), ("0", "0", 0.4), ("0", "1", 0.7)]
    df = spark.createDataFrame(data, "Label string, PredictedLabel string, Probability double")
    m = evaluate.binary_metrics(df, "Label", "PredictedLabel").first()
    assert (m.tn, m.fp, m.fn, m.tp) == (3, 1, 1, 2)
    assert m.accuracy == pytest.approx(5 / 7) and m.precision == m.recall == pytest.approx(2 / 3)
    assert evaluate.auc(df, "Label", "Probability").first()[0] == pytest.approx(10 / 12)
    assert math.isnan(evaluate.auc(df.where("Label = '1'"), "Label", "Probability").first()[0])
    same = df.withColumn("Probability", F.lit(0.5))
    assert evaluate.auc(same, "Label", "Probability").first()[0] == 0.5
    assert evaluate.positive_class(spark.createDataFrame([("no", 1), ("ya", 2)], "l string, i int"), "l", "i") == "ya"


def test_multiclass_and_clusters(spark):
    df = spark.createDataFrame([("besar", "besar")] * 10 + [("kecil", "besar")], "Label string, PredictedLabel string")
    m = evaluate.multiclass_metrics(df, "Label", "PredictedLabel").first()
    assert m.micro_accuracy == pytest.approx(10 / 11) and m.macro_accuracy == 0.5 and m.classes == 2
    c = evaluate.clustering_metrics(df, "Label").first()
    assert (c.clusters, c.largest, c.smallest, c.balance) == (2, 10, 1, 0.1)


def test_regression_on_a_constant(spark):
    df = spark.createDataFrame([("5", "4"), ("5", "6"), ("x", "1")], "y string, p string")
    m = evaluate.regression_metrics(df, "y", "p").first()
    assert (m.mae, m.rmse, m.r2) == (1.0, 1.0, 0.0)


def batch_client():
    """A client made here, so that it is sent to workers by value."""

    def ask(system, user, provider, temperature):
        import json
        import re

        found = re.findall(r"^\d+\. (.*)$", user, re.M)
        if not found:
            return json.dumps({"out": user.split("\n")[0].upper()})
        if "bad" in user:
            return "no json at all"
        return "```json\n" + json.dumps([{"out": x.upper()} for x in found]) + "\n```"

    return ask


def test_completions_fall_back_row_by_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "bad"), (3, None)], "i int, t string").coalesce(1)
    out = completions.apply(df, completions.reformat("t", "out"), batch_client(), completions.Settings(batch_size=2))
    assert rows(out.select("i", "out"), "i") == [(1, "A"), (2, "BAD"), (3, "")]
    part = completions.apply(df, completions.reformat("t", "out"), batch_client(), completions.Settings(max_rows=1), order="i")
    assert rows(part.select("i", "out"), "i") == [(1, "A"), (2, None), (3, None)]


def test_replies():
    assert completions.parse_reply('```json\n[{"a": 1}, "x"]\n```', ("a",)) == [{"a": "1"}, {"a": "x"}]
    assert completions.parse_reply("sorry", ("a",)) == []


def test_scripts(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "k string, v long")
    out = scripts.python_script(df, lambda p: p.assign(v=p.v.sum()).head(1), "k string, v long", by=["k"])
    assert rows(out, "k") == [("a", 3), ("b", 3)]
    with pytest.raises(PermissionError):
        scripts.sql_script("select 1", df, enabled=False)
    with pytest.raises(RuntimeError):
        scripts.r_script()


def test_scalar_functions(spark):
    df = spark.createDataFrame([("<html><script>x()</script><p>Hello &amp; bye</p>\n<nav>menu</nav>\n<b>a</b></html>", '{"a": {"b": [1, {"c": "z"}]}}')], "h string, j string")
    r = df.select(scalars.visible_text(F.col("h")).alias("t"), scalars.json_path(F.col("j"), "a.b.1.c").alias("c"), scalars.truncated(F.lit("abcdef"), 3).alias("cut")).first()
    assert r.t == "Hello & bye" and r.c == "z" and r.cut.startswith("abc\n")
    with pytest.raises(ValueError):
        scalars.arithmetic("__import__('os')")
    assert scalars.parse_filter("a >= 5") == ("a", ">=", "5") and scalars.parse_filter("nothing") is None


def test_filter_language(spark):
    df = spark.createDataFrame([(1, "x"), (2, None), (3, "Xy")], "i int, t string")
    ids = lambda f: {r.i for r in df.where(scalars.filter_condition(df, f)).collect()}
    assert ids("i > 1") == {2, 3}
    assert ids("t contains X") == {1, 3}
    assert ids("t != x") == {2, 3}
    assert ids("missing = 1") == set()
    assert ids("t > x") == {1}  # orderings of text are equality


def test_readers(spark, tmp_path):
    f = tmp_path / "in.csv"
    f.write_text('﻿name, ,age\n"a, ""b""",1,30\nc,2\n', encoding="utf-8")
    df = readers.read(spark, str(f))
    assert df.columns == ["name", "column_2", "age"]
    assert rows(df, "name") == [('a, "b"', 1.0, 30.0), ("c", 2.0, None)]
    j = tmp_path / "in.json"
    j.write_text('{"results": [{"a": 1, "n": {"x": 1}}, {"a": 2, "b": "y"}]}')
    assert set(readers.read(spark, str(j)).columns) == {"a", "b", "n"}
    assert readers.guess_format("x.TSV") == "Tsv" and readers.guess_format("x") == "Csv"
    with pytest.raises(ValueError):
        readers.from_json_text(spark, "5")


def test_workspace(spark, tmp_path):
    w = catalogue.Workspace(spark, tmp_path.as_uri())
    id = w.save_dataset(spark.createDataFrame([(1, "a"), (2, None)], "i int, t string"), "My data/1", "Csv")
    assert rows(w.dataset(id), "i") == [(1.0, "a"), (2.0, None)]
    n, page = w.query(id, ["t"], "i >= 1", 500)
    assert n == 2 and page.columns == ["t"]
    assert {r["column"] for r in w.describe(id)} == {"i", "t"}
    assert w.delete_dataset(id)


def test_splats_and_meshes(spark):
    pixels = spark.range(64).selectExpr("0 image", "cast(id % 8 as int) x", "cast(id div 8 as int) y", "200 r", "100 g", "50 b", "case when id % 2 = 0 then 255 else 0 end a")
    cloud = imaging.points(pixels)
    data = imaging.splat_rows(cloud).collect()
    assert len(data) == 32 and all(len(r.bytes) == imaging.POINT_BYTES for r in data)
    vertices, triangles = imaging.tube_mesh(spark, 12, 6)
    assert (vertices.count(), triangles.count()) == (72, 144)
    v = [tuple(r) for r in imaging.grid_mesh(spark, 3, 3)[0].orderBy("id").select("x", "y", "z").collect()]
    blob = imaging.glb(v, [(0, 1, 3)])
    assert imaging.is_glb(blob) and len(blob) % 4 == 0 and not imaging.is_glb(b"nope")
    assert imaging.resolve_engine("GPU") == "gpu" and imaging.resolve_engine(None) == "local"


def test_forecast_continues_a_season():
    t = np.arange(120)
    series = 50 + 0.2 * t + 10 * np.sin(2 * np.pi * t / 7)
    ahead = np.arange(120, 127)
    got = custom.ssa_forecast(series, 28, 7)
    assert np.abs(got - (50 + 0.2 * ahead + 10 * np.sin(2 * np.pi * ahead / 7))).max() < 5


def test_spike_is_found(spark):
    df = spark.createDataFrame([(i, 500.0 if i == 75 else 10.0 + i % 3) for i in range(100)], "i int, nilai double")
    found = {r.i for r in custom.spikes(df, "nilai", "i", 99.9, 30).where("alert = 1").collect()}
    assert found == {75}
    with pytest.raises(Exception, match="window"):
        custom.forecast(df.limit(10), "nilai", "i", 7, 14).collect()


def test_kernel_p_values_of_batches_and_streams_agree(spark):
    import random

    rnd = random.Random(9)
    values = [rnd.gauss(0, 1) if rnd.random() < 0.9 else None for _ in range(120)] + [3.0] * 12 + [3.5, 40.0]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double")
    past = []
    for r in custom.spikes(df, "v", "i", 95, 10).orderBy("i").collect():
        # The batch's window counts rows, so gaps use up places in it.
        past = [x for x in values[max(0, r.i - 10) : r.i] if x is not None]
        wanted = 1.0 if r.v is None else custom.kernel_p(past, r.v)
        assert abs(r.p_value - wanted) < 1e-6 and r.alert == (wanted < 0.05)
    assert custom.kernel_p([3.0] * 5, 3.0) == 1.0 and custom.kernel_p([3.0] * 5, 3.1) == 0.0 and custom.kernel_p([1.0, 2.0], 99.0) == 1.0


def test_upper_medians_of_many_ties_and_few_rows(spark):
    import random

    rnd = random.Random(3)
    groups = {"one": [5.0], "two": [1.0, 2.0], "ties": [1.0] * 400 + [2.0] * 401, "even": [float(i) for i in range(100)], "any": [rnd.gauss(0, 1) for _ in range(5001)]}
    rows = [(k, v) for k, vs in groups.items() for v in rnd.sample(vs, len(vs))]
    found = {r["column"]: r["median"] for r in profile.upper_medians(spark.createDataFrame(rows, "column string, number double")).collect()}
    assert found == {k: sorted(vs)[len(vs) // 2] for k, vs in groups.items()}


def test_split_keeps_shares_of_small_hot_and_null_strata(spark):
    rows = [(i, "hot") for i in range(1000)] + [(i, None) for i in range(1000, 1007)] + [(i, "few") for i in range(2000, 2004)]
    df = spark.createDataFrame(rows, "i int, s string")
    a, b = transforms.split_data(df, 0.75, "s", ids=["i"])
    assert {r.s: r["count"] for r in a.groupBy("s").count().collect()} == {"hot": 750, None: 5, "few": 3}
    assert a.union(b).exceptAll(df).count() == 0 and a.count() + b.count() == 1011


def test_roc_of_one_score_follows_the_order(spark):
    rows = [(i, int(i % 3 == 0), 0.5) for i in range(1000)]
    found = evaluate.roc_points(spark.createDataFrame(rows, "i int, y int, p double"), "y", "p", order="i", points=10)
    got = sorted((round(r.fpr, 6), round(r.tpr, 6)) for r in found.where("threshold = 0.5").collect())
    places = [k for k in range(1, 1001) if (k - 1) % 100 == 0 or k == 1000]
    hits = lambda k: sum(i % 3 == 0 for i in range(k))
    assert got == sorted((round((k - hits(k)) / 666, 6), round(hits(k) / 334, 6)) for k in places)


def test_sql_source_over_jdbc(spark, monkeypatch):
    monkeypatch.setitem(readers.DRIVERS, "derby", "org.apache.derby.iapi.jdbc.AutoloadedDriver")
    url = "jdbc:derby:memory:brindle;create=true"
    spark.range(20).selectExpr("id", "id % 3 as k").write.jdbc(url, "numbers", "overwrite", {"driver": readers.DRIVERS["derby"]})
    whole = readers.read_sql(spark, "select \"id\" from numbers where \"k\" = 1", "derby", url)
    assert sorted(r.id for r in whole.collect()) == [i for i in range(20) if i % 3 == 1]
    parts = readers.read_sql(spark, "select \"id\" from numbers", "derby", url, partitionColumn="id", lowerBound="0", upperBound="20", numPartitions="4")
    assert parts.rdd.getNumPartitions() == 4 and parts.count() == 20


def test_mesh_container_and_engine_names():
    data = imaging.glb([(0, 0, 0), (1, 0, 0), (0, 1, 0)], [(0, 1, 2)])
    assert imaging.is_glb(data) and len(data) % 4 == 0 and not imaging.is_glb(data[:-1])
    assert imaging.resolve_engine(" GPU ") == "gpu" and imaging.resolve_engine("nothing") == "local"


def test_perceptron_leaps_equal_single_steps():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(300, 5))
    y = (x @ rnd.normal(size=5) + rnd.normal(size=300) > 0).astype(float)
    w, b, sums, sum_bias = np.zeros(5), 0.0, np.zeros(5), 0.0
    for row, wanted in zip(x, y):
        sign = 1.0 if wanted > 0 else -1.0
        if sign * (w @ row + b) <= 0:
            w, b = w + 0.1 * sign * row, b + 0.1 * sign
        sums, sum_bias = sums + w, sum_bias + b
    got = custom.AveragedPerceptron._step(np.zeros(5), 0.0, x, y, 0.1, 0)
    assert all(np.allclose(g, e) for g, e in zip(got, (w, b, sums, sum_bias)))


def test_residuals_are_every_nth_pair_where_ranges_are_merged(spark):
    n = 400_000
    df = spark.range(n, numPartitions=8).select("id", (F.col("id") + F.rand(1) / 2).alias("y"), F.rand(2).alias("p"))
    found = evaluate.residual_sample(df, "y", "p", "id").collect()
    assert sorted(int(r["actual"]) for r in found) == list(range(0, n, n // 500))


def test_sgd_lanes_are_passes_of_their_own():
    r = np.random.default_rng(2)
    x, y = r.uniform(size=(3_000, 4)), r.normal(size=3_000)
    learner, start = custom.SgdRegression(rate=0.1), np.array([0.1, 0.2, 0.3, 0.4])
    w, b, plain = start.copy(), 0.5, np.zeros(6)
    for at in range(0, 3_000, 5):
        part, gap = x[at : at + 5], y[at : at + 5] - (x[at : at + 5] @ w + b)
        move = 0.1 / 1.2 / (1 + (part * part).sum(axis=1)) * 2 * gap
        w, b = w + move @ part, b + move.sum()
        plain += [*(5 * w), 5 * b, 5]
    assert np.allclose(learner._pass(start, 0.5, iter([(x[:1_000], y[:1_000]), (x[1_000:], y[1_000:])]), 2, 1), plain)
    apart = sum(learner._pass(start, 0.5, iter([(x[i : i + 1_000], y[i : i + 1_000])]), 2, 1) for i in (0, 1_000, 2_000))
    assert np.allclose(learner._pass(start, 0.5, iter([(x, y)]), 2, 3), apart)
    ragged = learner._pass(start, 0.5, iter([(x[:1_234], y[:1_234]), (x[1_234:1_236], y[1_234:1_236])]), 2, 7)
    assert ragged[-1] == 1_236 and np.isfinite(ragged).all()
