"""Spatial joins against the even-odd rule over all edges."""

import math
import random

import numpy as np
import pytest

from lodestone.operators import spatial


def odd(x, y, rings):
    inside = False
    for ring in rings or []:
        if len(ring) > 2:
            for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1]):
                if (y0 > y) != (y1 > y) and x < (x1 - x0) * (y - y0) / (y1 - y0) + x0:
                    inside = not inside
    return inside


def blob(rng, x, y, size, n):
    return [[x + size * (0.4 + rng.random()) * math.cos(2 * math.pi * i / n), y + size * (0.4 + rng.random()) * math.sin(2 * math.pi * i / n)] for i in range(n)]


@pytest.fixture(scope="module")
def areas():
    rng = random.Random(5)
    rows = [(k, [blob(rng, rng.uniform(-10, 10), rng.uniform(-10, 10), rng.choice([0.05, 1, 4]), rng.choice([3, 7, 60])) for _ in range(rng.choice([1, 1, 2, 3]))]) for k in range(25)]
    rows += [(50, [[[0.0, 0.0], [4.0, 0.0], [4.0, 4.0], [0.0, 4.0]], [[1.0, 1.0], [2.0, 1.0], [2.0, 2.0], [1.0, 2.0]]])]  # on the grid, with a hole
    return rows + [(51, None), (52, []), (53, [[[1.0, 1.0], [2.0, 2.0]]])]


@pytest.fixture(scope="module")
def points():
    rng = random.Random(6)
    rows = [(i, rng.uniform(-14, 14), rng.uniform(-14, 14)) for i in range(1500)] + [(2000 + 12 * i + j, i / 2 - 1, j / 2 - 1) for i in range(12) for j in range(12)]
    return rows + [(9000 + i, 0.5, 0.5) for i in range(300)] + [(9999, None, 1.0)]


@pytest.mark.parametrize("size", [0.25, 1.0, 7.0])
def test_points_in_areas_equal_the_rule(spark, areas, points, size):
    a = spark.createDataFrame(areas, "area int, rings array<array<array<double>>>")
    p = spark.createDataFrame(points, "id long, x double, y double")
    got = {(r["id"], r["place"]) for r in spatial.join_areas(p, "x", "y", a, "area", "rings", size, "place").collect()}
    want = {(i, k) for i, x, y in points if x is not None for k, rings in areas if odd(x, y, rings)}
    assert got == want and want
    left = spatial.join_areas(p, "x", "y", a, "area", "rings", size, "place", how="left").where("place IS NULL").collect()
    assert {r["id"] for r in left} == {i for i, *_ in points} - {i for i, _ in want}


def test_cells_inside_need_no_edges(spark, areas):
    cells = spatial.cover(spark.createDataFrame([areas[25]], "area int, rings array<array<array<double>>>"), "area", "rings", 0.25)
    assert cells.where("edges IS NULL AND inside").count() > 100 and cells.where("edges IS NULL AND NOT inside").isEmpty()
    assert cells.selectExpr("max(size(edges)) AS n").first()["n"] <= 8
    with pytest.raises(ValueError):
        list(spatial.cover_of(spatial.edges_of(areas[25][1]), 1e-4))


@pytest.mark.parametrize("per_pass", [7, 1 << 20])
def test_nearest_vertex(spark, areas, points, per_pass):
    a = spark.createDataFrame(areas, "area int, rings array<array<array<double>>>")
    p = spark.createDataFrame(points[:200] + points[-1:], "id long, x double, y double")
    got = {r["id"]: (r["area"], r["distance"]) for r in spatial.nearest_area(p, "id", "x", "y", a, "area", "rings", per_pass).collect()}
    assert set(got) == {i for i, x, _ in points[:200]}
    for i, x, y in points[:200]:
        d, k = min(((x - vx) ** 2 + (y - vy) ** 2, k) for k, rings in areas for ring in rings or [] for vx, vy in ring)
        assert got[i][0] == k and got[i][1] == pytest.approx(math.sqrt(d))


def test_votes_and_their_fallback(spark, areas):
    inner = [(1, [[[0.1, 0.1], [0.9, 0.1], [0.9, 0.9], [0.1, 0.9]]]), (2, [[[3.5, 3.5], [4.5, 3.5], [4.5, 4.5], [3.5, 4.5]]]), (3, [[[100.0, 100.0], [101.0, 100.0], [101.0, 101.0]]])]
    outer = [areas[25], (60, [[[4.0, 4.0], [9.0, 4.0], [9.0, 9.0], [4.0, 9.0]]])]
    frames = [spark.createDataFrame(r, "area int, rings array<array<array<double>>>") for r in (inner, outer)]
    got = {r["area"]: (r["other"], r["n"]) for r in spatial.match_areas(*frames, "area", "rings", 0.5).collect()}
    assert got[1] == (50, 81) and got[2][0] == 60 and got[3] == (60, 0)
    assert {r["area"] for r in spatial.probes(frames[0], "area", "rings", 3).collect()} == {1, 2, 3}
    assert np.isclose(sum(n for _, n in got.values() if n), 81 + got[2][1])
