"""The sketched components against exact ones."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from brindle.ml.custom import PcaAnomaly


def _frame(spark, x):
    return spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").select(array_to_vector("x").alias("features")).repartition(3)


def _exact(x, rank):
    c = x - x.mean(axis=0)
    return np.linalg.eigh(c.T @ c)[1][:, ::-1][:, :rank]


def test_a_sketch_finds_the_leading_subspace(spark):
    r = np.random.default_rng(7)
    x = r.normal(size=(800, 4)) * [9, 7, 5, 4] @ np.linalg.qr(r.normal(size=(50, 4)))[0].T + 0.3 * r.normal(size=(800, 50)) + 3
    model = PcaAnomaly(rank=4, oversampling=3, powers=3).fit(_frame(spark, x))
    found, exact = np.array(model.getOrDefault("components")), _exact(x, 4)
    assert np.allclose(found @ found.T, np.eye(4), atol=1e-9)
    assert np.linalg.svd(found @ exact)[1].min() > 1 - 1e-6  # the cosine of the largest angle
    c = x - x.mean(axis=0)
    wanted = np.sort(np.sqrt(np.maximum((c**2).sum(axis=1) - ((c @ exact) ** 2).sum(axis=1), 0)))
    got = np.sort([row["prediction"] for row in model.transform(_frame(spark, x)).collect()])
    assert np.allclose(got, wanted, atol=1e-3)


def test_oversampling_matters_and_all_directions_are_exact(spark):
    r = np.random.default_rng(8)
    x = r.normal(size=(500, 30)) * np.linspace(2, 1, 30)
    df, exact = _frame(spark, x), _exact(x, 3)
    held = lambda over, powers: (np.linalg.svd(np.array(PcaAnomaly(rank=3, oversampling=over, powers=powers).fit(df).getOrDefault("components")) @ exact)[1] ** 2).sum()
    few, more, all_ = held(0, 1), held(15, 1), held(27, 1)
    assert few < more < all_ and np.isclose(all_, 3)


def test_embeddings_and_no_rows(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    x = np.array([row["features"].toArray() for row in df.collect()])
    model = PcaAnomaly(rank=5, oversampling=20).fit(df)
    c = x - x.mean(axis=0)
    kept = lambda basis: ((c @ basis) ** 2).sum()
    assert kept(np.array(model.getOrDefault("components")).T) > 0.97 * kept(_exact(x, 5))
    assert PcaAnomaly().fit(df.limit(0)).getOrDefault("components") == []
