"""Maps in two dimensions: neighbours stay together, seeds repeat, new rows find their places."""

import numpy as np
import pytest

from polisgraph.operators import layout, projection
from polisgraph.plans.cleanq import drift


def groups(seed=1, n=240, dims=12):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (6, dims))
    return np.concatenate([centres[k % 6] + r.normal(0, 0.15, dims) for k in range(n)]).reshape(n, dims)


def frame(spark, points, base=0):
    return spark.createDataFrame([(base + k, [float(x) for x in p]) for k, p in enumerate(points)], "id long, v array<double>")


def trustworthiness(points, places, k=10):
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    high = np.argsort(np.argsort(1 - unit @ unit.T, 1), 1)  # rank of each row, itself 0
    far = np.square(places[:, None] - places[None]).sum(-1)
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, 1)[:, :k]
    n = len(points)
    lost = sum(max(0, high[i, j] - k) for i in range(n) for j in near[i])
    return 1 - 2 * lost / (n * k * (2 * n - 3 * k - 1))


@pytest.fixture(scope="module")
def mapped(spark):
    points = groups()
    rows = projection.project(frame(spark, points), neighbours=15, rounds=3).collect()
    at = {r["id"]: (r["x"], r["y"]) for r in rows}
    return points, np.array([at[k] for k in range(len(points))])


def test_neighbours_stay_together(mapped):
    points, places = mapped
    assert np.isfinite(places).all()
    chance = trustworthiness(points, np.random.default_rng(0).normal(size=places.shape))
    assert trustworthiness(points, places) > 0.93 > 0.6 > chance


def test_one_seed_one_map_and_fits(spark, mapped):
    points, places = mapped
    again = projection.project(frame(spark, points), neighbours=15, rounds=3).collect()
    assert sorted((r["id"], r["x"], r["y"]) for r in again) == [(k, *p) for k, p in enumerate(places.tolist())]
    frames = [spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(x)], "id long, x double, y double") for x in (places, places @ np.array([[0.0, 2.0], [-2.0, 0.0]]) + 5)]
    fit = layout.similarity_fit(*frames)
    moved = layout.similarity_apply(frames[1], fit)
    assert drift(frames[0], moved).first()["largest"] < 1e-6


def test_new_rows_find_their_group(spark, mapped):
    points, places = mapped
    fresh = groups(n=30) + 0.01
    known = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "id long, x double, y double")
    found = {r["id"]: (r["x"], r["y"]) for r in projection.place_new(frame(spark, points), known, frame(spark, fresh, 9000), neighbours=15).collect()}
    for k in range(30):
        gap = np.linalg.norm(places - np.array(found[9000 + k]), axis=1)
        assert (np.argsort(gap)[:5] % 6 == k % 6).sum() >= 4


def test_rows_without_direction_and_copies(spark):
    rows = [(k, [float(k % 5), 1.0]) for k in range(40)] + [(90, None), (91, []), (92, [0.0, 0.0]), (93, [float("nan"), 1.0])]
    found = {r["id"]: (r["x"], r["y"]) for r in projection.project(spark.createDataFrame(rows, "id long, v array<double>"), rounds=1, epochs=5).collect()}
    assert sorted(found) == list(range(40)) and found[0] == found[5] != found[1]
    assert projection.project(spark.createDataFrame([], "id long, v array<double>"), rounds=1).collect() == []


def test_fall_off():
    a, b = projection.falloff(0.1)
    assert (a, b) == (pytest.approx(1.577, abs=0.01), pytest.approx(0.895, abs=0.01))
