"""Series in pieces against the forecast of a whole series."""

import numpy as np
import pytest

from brindle.ml import custom, series


@pytest.fixture(scope="module")
def frame(spark):
    r = np.random.default_rng(6)
    rows = []
    for name, n, period in (("a", 700, 12), ("b", 333, 7), (None, 120, 9)):
        wave = 10 + 3 * np.sin(np.arange(n) * 2 * np.pi / period) + 0.01 * np.arange(n) + 0.2 * r.normal(size=n)
        rows += [(name, i, float(v)) for i, v in enumerate(wave)] + [(name, n + 5, None)]
    return spark.createDataFrame(rows, "name string, day int, v double").repartition(6).persist()


def _whole(frame, name, length, window, horizon):
    values = np.array([r.v for r in frame.where("v is not null").orderBy("day").collect() if r.name == name])[-length:]
    return custom.ssa_forecast(values, window, horizon)


@pytest.mark.parametrize(("length", "piece"), [(10_000, 50), (100, 16), (64, 1_000)])
def test_pieces_give_the_whole_series_forecast(frame, length, piece):
    found = series.forecast(frame, "v", "day", 9, 16, length, ["name"], piece).collect()
    for name in ("a", "b", None):
        got = [r.forecast for r in sorted((r for r in found if r.name == name), key=lambda r: r.step)]
        assert np.allclose(got, _whole(frame, name, length, 16, 9), rtol=1e-6)


def test_one_series_without_keys_and_the_switch_for_long_ones(frame, monkeypatch):
    one = frame.where("name = 'a'")
    wanted = _whole(one, "a", 650, 20, 5)
    assert np.allclose([r.forecast for r in custom.forecast(one, "v", "day", 5, 20, 650).orderBy("step").collect()], wanted, rtol=1e-6)
    monkeypatch.setattr(custom, "LONG", 100)
    assert np.allclose([r.forecast for r in custom.forecast(one, "v", "day", 5, 20, 650).orderBy("step").collect()], wanted, rtol=1e-6)


def test_places_are_gapless_and_short_series_are_refused(frame):
    at = [r["_at"] for r in series.placed(frame.where("name = 'b'"), "v", "day", ["name"]).collect()]
    assert sorted(at) == list(range(333))
    with pytest.raises(ValueError, match="window"):
        series.forecast(frame.where("name = 'b'"), "v", "day", 5, 200, 10_000, ["name"])
    with pytest.raises(ValueError):
        series.lag_products(series.placed(frame, "v", "day", ["name"]), 30, ["name"], 10)
