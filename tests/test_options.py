"""Options of support fusion and the fitted score, by brute force."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from understory.operators import crowns, kernels, masks, revision, scorer

from conftest import rows


def inside(corners, x, y):
    """Whether a point is no farther out than any side of the convex hull."""
    n = len(corners)
    return n > 2 and all((corners[(i + 1) % n][0] - a) * (y - b) - (corners[(i + 1) % n][1] - b) * (x - a) >= -1e-9 for i, (a, b) in enumerate(corners))


def test_offers_inside_hulls_and_near_votes(spark):
    rng = np.random.default_rng(3)
    own = [(int(k), float(x), float(y), float(x) + 0.3, float(y)) for k in (1, 2) for x, y in rng.integers(0, 12, (9, 2)) / 2 + 3 * k]
    own += [(3, float(i), float(i), 0.0, 0.0) for i in range(5)]  # on one line
    own += [(4, 2.0, 2.0, 2.0, 2.0)]
    asked = [(i, int(k), float(x), float(y), float(x), float(y)) for i, (k, x, y) in enumerate(zip(rng.integers(1, 5, 300), rng.integers(0, 24, 300) / 2, rng.integers(0, 24, 300) / 2, strict=True))]
    anchors = spark.createDataFrame(own, "label long, x double, y double, vx double, vy double")
    offered = spark.createDataFrame(asked, "pid long, label long, x double, y double, vx double, vy double")
    hulls = {k: kernels.hull(np.array([[x, y] for label, x, y, *_ in own if label == k])) for k in (1, 2, 3, 4)}
    want = sorted((p,) for p, k, x, y, *_ in asked if inside(hulls[k].tolist(), x, y))
    assert rows(masks.inside_hull(offered, anchors), "pid") == sorted(want, key=str) and want
    middle = {k: np.median([[vx, vy] for label, _, _, vx, vy in own if label == k], axis=0) for k in (1, 2, 3, 4)}
    want = sorted(((p,) for p, k, _, _, vx, vy in asked if (vx - middle[k][0]) ** 2 + (vy - middle[k][1]) ** 2 <= 4), key=str)
    assert rows(masks.voting_near(offered, anchors, 2.0), "pid") == want and want
    with pytest.raises(ValueError):
        masks.voting_near(offered, anchors, 0.0)
    assert masks.inside_hull(offered.limit(0), anchors).count() == masks.inside_hull(offered, anchors.limit(0)).count() == 0


def model_of(f, t):
    """Weights and bias of the discriminant as plain arrays."""
    m, s = f.mean(0), np.maximum(f.std(0), 1e-6)
    z = np.clip((f - m) / s, -5, 5)
    a, b = z[t == 1], z[t == 0]
    w = (a.mean(0) - b.mean(0)) / np.maximum((len(a) * a.var(0) + len(b) * b.var(0)) / len(z), 1e-6)
    return m, s, w, np.log((len(a) + 1) / (len(b) + 1)) - (w * (a.mean(0) + b.mean(0)) / 2).sum()


def test_fitted_score_by_brute_force(spark):
    rng = np.random.default_rng(5)
    t = rng.integers(0, 2, 400)
    f = np.column_stack([rng.normal(0, 1, 400) + 2 * t, rng.normal(0, 3, 400), np.full(400, 7.0), rng.normal(0, 1, 400) - t])
    names = ["a", "b", "c", "d"]
    data = spark.createDataFrame([(*map(float, r), int(k)) for r, k in zip(f, t, strict=True)] + [(99.0, 99.0, 99.0, 99.0, -1)], "a double, b double, c double, d double, target int")
    fit = scorer.fitted(data, names)
    m, s, w, bias = model_of(f, t)
    got = fit.first()
    assert [got[f"_w_{n}"] for n in names] == pytest.approx(w.tolist(), abs=1e-9) and got["_w_c"] == pytest.approx(0, abs=1e-6)
    scores = np.array([r[0] for r in scorer.scored(data.where("target >= 0"), fit, names).orderBy("a", "b").select("score").collect()])
    order = np.lexsort((f[:, 1], f[:, 0]))
    assert scores == pytest.approx((1 / (1 + np.exp(-(bias + (np.clip((f - m) / s, -5, 5) * w).sum(1)))))[order], abs=1e-9)
    assert ((scores >= 0.5) == (t[order] == 1)).mean() > 0.85


def test_fit_without_examples_of_a_class(spark):
    data = spark.createDataFrame([(1.0, 1), (2.0, 1), (None, -1)], "a double, target int")
    fit = scorer.fitted(data, ["a"])
    assert fit.first()["_w_a"] == 0.0
    assert [r[0] for r in scorer.scored(data.where("a IS NOT NULL"), fit, ["a"]).select("score").collect()] == pytest.approx([0.75, 0.75])
    assert scorer.fitted(data.limit(0), ["a"]).count() == 1 and scorer.scored(data.where(F.lit(False)), fit, ["a"]).count() == 0


def cut_by(ring, side):
    """What is left of a convex ring on the inner side of an upright or level line (axis, place, sign)."""
    axis, at, sign = side
    out = []
    for p, q in zip(ring, ring[1:] + ring[:1], strict=True):
        a, b = sign * (p[axis] - at), sign * (q[axis] - at)
        if a >= 0:
            out.append(p)
        if a * b < 0:
            out.append(tuple(p[i] + (q[i] - p[i]) * a / (a - b) for i in (0, 1)))
    return out


def area(ring):
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:] + ring[:1], strict=True)) / 2 if len(ring) > 2 else 0.0


def test_crown_modes_cell_by_cell(spark):
    rng = np.random.default_rng(11)
    size = 0.5
    support = [(0, k, float(x), float(y)) for k in (1, 2, 3) for x, y in rng.uniform(0, 6, (14, 2)) + 5 * k] + [(0, 5, 1.0, 1.0)]
    at = {k: {(int(r), int(c)) for r, c in rng.integers(10 * k + 4, 10 * k + 16, (70, 2))} for k in (1, 2)} | {3: {(0, 0), (0, 1)}, 4: {(7, 7)}}
    cells = [(0, k, r, c) for k, of in at.items() for r, c in of] + [(0, 4, 7, 7)]
    points = spark.createDataFrame(support, "dataset_id int, label long, x double, y double")
    grid = spark.createDataFrame(cells, "dataset_id int, label long, row long, col long")
    got = {r["label"]: r for r in crowns.crown_areas(points, grid, "label", size).collect()}
    cleaned = kernels.cleaned_footprints(grid.distinct(), "label").collect()
    assert sorted(got) == [1, 2, 3, 4]  # 5 has one point and no cell
    for k in (1, 2, 3):
        ring = [tuple(p) for p in kernels.hull(np.array([[x, y] for _, label, x, y in support if label == k])).tolist()]
        own = [(r["row"] * size, r["col"] * size) for r in cleaned if r["label"] == k]
        shared = 0.0
        for bottom, left in own:
            part = ring
            for side in ((0, left, 1), (0, left + size, -1), (1, bottom, 1), (1, bottom + size, -1)):
                part = cut_by(part, side)
            shared += area(part)
        hull, head = area(ring), len(own) * size * size
        union = hull + head - shared if shared else max(hull, head)
        assert [got[k][n] for n in ("support_hull", "head", "head_union_support")] == pytest.approx([hull, head, union], abs=1e-9)
    assert [got[4][n] for n in ("support_hull", "head", "head_union_support")] == [0.25, 0.25, 0.25]
    assert crowns.crown_areas(points.limit(0), grid.limit(0), "label", size).count() == 0


def test_small_additions_in_order(spark):
    rng = np.random.default_rng(2)
    data, spots, sure = [], {}, {}
    for k in range(1, 25):
        x, y = rng.integers(0, 7, 2)
        spots[k] = {(int(x + i), int(y + j)) for i in range(3) for j in range(2 + k % 2)}
        sure[k] = round(0.3 + 0.02 * (k % 5), 2)  # ties
        data += [(len(data) + i, 0, c * 0.5 + 0.1, r * 0.5 + 0.1, 3.0, 0, k, sure[k]) for i, (r, c) in enumerate(sorted(spots[k]) * 2)]
    points = spark.createDataFrame(data, "pid long, dataset_id int, x double, y double, z double, anchor long, proposal long, p double")
    kept: list = []
    for k in sorted(spots, key=lambda k: (-sure[k], k)):
        if all(len(spots[k] & spots[a]) / len(spots[k]) <= 0.3 for a in kept):
            kept.append(k)
    got = {r["proposal"] for r in revision.small_additions(points).select("proposal").distinct().collect()}
    assert got == set(kept) and 1 < len(kept) < 24
    assert revision.small_additions(points.limit(0)).count() == 0
