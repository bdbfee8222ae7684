"""Overlaps of many footprints: pairs are counted inside groups and never shuffled."""

from __future__ import annotations

import random
from collections import Counter

import pytest

from understory.operators import kernels, spatial

from conftest import rows

KINDS = "dataset_id int, id long, row long, col long"


def footprints(seed: int, n: int) -> set[tuple]:
    """Cells of footprints that run over the edges of tiles, some of one id in two plots."""
    r = random.Random(seed)
    cells = set()
    for i in range(n):
        y, x = r.choice([(-3, 120), (0, 0), (126, 126), (125, -4)])
        cells |= {(plot, i, y + r.randint(0, 7), x + r.randint(0, 9)) for plot in ([0, 1] if i % 7 == 0 else [i % 2]) for _ in range(40)}
    return cells


@pytest.mark.parametrize("crowd", [(3, 10**6), (10**6, 100), (2048, 10**6)])
@pytest.mark.parametrize("whole", [False, True])
def test_footprints_meet_in_crowds(spark, crowd, whole):
    a, b = footprints(1, 30), footprints(2, 25)
    size = lambda cells: Counter(c[1] if whole else c[:2] for c in cells)
    na, nb = size(a), size(b)
    shared = Counter((c[0], c[1], e[1]) for c in a for e in b if c[0] == e[0] and c[2:] == e[2:])
    of = lambda n, plot, i: n[i if whole else (plot, i)]
    iou = {k: n / (of(na, k[0], k[1]) + of(nb, k[0], k[2]) - n) for k, n in shared.items()}
    ta, tb = (spark.createDataFrame(sorted(c), KINDS) for c in (a, b))
    found = spatial.cell_overlap(ta, tb, 0.25, whole=whole, crowd=crowd)
    assert {k[:3]: k[3:] for k in rows(found)} == {k: (n / 4, iou[k], n / min(of(na, *k[:2]), of(nb, k[0], k[2]))) for k, n in shared.items()}
    few = spatial.cell_overlap(ta, tb, 0.25, whole=whole, least=0.4, crowd=crowd)
    assert rows(few, "dataset_id", "a", "b") == sorted((k for k, v in iou.items() if v >= 0.4), key=str)


def test_pairs_of_footprints_are_not_shuffled(spark):
    """Nothing is exchanged by pairs, and pairs below the asked IoU do not leave their group."""
    ta, tb = (spark.createDataFrame(sorted(footprints(k, 20)), KINDS) for k in (1, 2))
    plan = spatial.cell_overlap(ta, tb, 1.0, whole=True)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroups" in plan and "Aggregate" not in plan.split("FlatMapGroups")[0] and "Join" not in plan.split("FlatMapGroups")[0]


def test_few_footprints_of_a_place_are_paired(spark):
    """Products of matrices and pairs of places count the same."""
    import numpy as np

    r = np.random.default_rng(3)
    at = np.unique(r.integers(0, [400, 2, 300], (3000, 3)), axis=0), np.unique(r.integers(0, [300, 2, 300], (2500, 3)), axis=0)
    a, b = ((t[:, 0], np.stack([t[:, 1], t[:, 1]], axis=1), t[:, 2]) for t in at)
    want = np.zeros((400, 300))
    for i, t, p in at[0]:
        for j in at[1][(at[1][:, 1] == t) & (at[1][:, 2] == p)][:, 0]:
            want[i, j] += 1
    assert (kernels.shared_cells(a, b, (400, 300), 300) == want).all()


def test_shapes_are_sent_as_few_bytes(spark, monkeypatch):
    """A shape of many corners takes a few bytes a corner where it is sent to each crowd it meets, and its areas are those of its sides."""
    import numpy as np

    from understory.operators import polygons

    r = random.Random(4)
    cells = spark.createDataFrame([(1, k, y, x) for k in range(1, 5) for y in range(40) for x in range(60) if r.random() < 0.2], "dataset_id int, label long, row long, col long")
    shapes = polygons.shapes(polygons.rings(cells, "label"), "label")
    held = {x.id: x.rings for x in shapes.collect()}
    sent = polygons.drawn(shapes).toArrow()
    assert set(sent.column("id").to_pylist()) == set(held)
    p = polygons.Drawn(sent)
    for i, (name, packed) in enumerate(zip(sent.column("id").to_pylist(), sent.column("sides").to_pylist(), strict=True)):
        assert len(packed) < 5 * sum(map(len, held[name]))
        assert (p.shape(i) == polygons.edges([[c.asDict() for c in g] for g in held[name]])).all()
    whole = polygons.upright_areas(p, p)
    monkeypatch.setattr(polygons, "WIDE", 7)
    assert np.allclose(polygons.upright_areas(p, p), whole) and np.allclose(np.diag(whole), sent.column("area").to_numpy())
    assert len(polygons.Drawn(sent.slice(0, 0)).left) == 0
