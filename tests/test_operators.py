"""Operators on small literal cases."""

from __future__ import annotations

import itertools

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from understory.operators import consensus, flooding, governance, graph, greedy, grid, kernels, labels, masks, metrics, raster, revision, spatial, votes


def labelled(spark, truth, pred):
    return spark.createDataFrame([(0, t, p) for t, p in zip(truth, pred, strict=True)], "dataset_id int, truth long, pred long")


@pytest.mark.parametrize(
    ("truth", "pred", "want"),
    [
        ([0, 1, 1, 2, 2], [0, 4, 4, 9, 9], (2, 0, 0, 2.0)),
        ([0, 1, 1, 2, 2], [0, 0, 0, 0, 0], (0, 0, 2, 0.0)),
        ([-1, -1, 0, 1, 1], [7, 7, 0, 9, 9], (1, 0, 0, 1.0)),
        ([-1, -1, 0, 1, 1], [7, 7, 8, 9, 9], (1, 1, 0, 1.0)),
        ([1, 1, 1, 1], [5, 5, 6, 6], (1, 1, 0, 0.5)),
    ],
)
def test_instance_metrics(spark, truth, pred, want):
    r = metrics.instance_metrics(labelled(spark, truth, pred)).first()
    assert (r.tp, r.fp, r.fn, r.iou_sum) == want


def test_metrics_do_not_depend_on_ids(spark):
    rng = np.random.default_rng(0)
    truth, pred = rng.integers(-1, 6, 300), rng.integers(0, 6, 300)
    moved = rng.permutation(6) * 10 + 1
    a = metrics.instance_metrics(labelled(spark, truth.tolist(), pred.tolist())).first()
    b = metrics.instance_metrics(labelled(spark, truth.tolist(), [int(moved[p]) if p else 0 for p in pred])).first()
    assert (a.tp, a.fp, a.fn) == (b.tp, b.fp, b.fn) and abs(a.iou_sum - b.iou_sum) < 1e-9


def test_totals_of_nothing_are_zero(spark):
    df = spark.createDataFrame([(0, 0, 0, 0.0)], "tp long, fp long, fn long, iou_sum double")
    r = metrics.totals(df).first()
    assert (r.precision, r.recall, r.f1, r.pq, r.sq) == (0, 0, 0, 0, 0)


def test_duplicate_prediction(spark):
    df = spark.createDataFrame([(2, 1, 0, 2.0)], "tp long, fp long, fn long, iou_sum double")
    assert metrics.totals(df).first().f1 == pytest.approx(0.8)


def test_components_by_brute_force(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 80, (60, 2))] + [(5, 5)]
    root = list(range(80))
    for _ in range(80):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(rows(graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b")))
    assert all(got.get(i, i) == root[i] for i in range(80))
    assert graph.components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)], "a long, b long")
    assert {r for _, r in rows(graph.components(chain, "a", "b"))} == {0}


def points(spark, xyz, **more):
    names = ["dataset_id", "pid", "x", "y", "z", *more]
    kinds = "dataset_id int, pid long, x double, y double, z double" + "".join(f", {n} long" for n in more)
    return spark.createDataFrame([(0, i, *map(float, p), *(more[n][i] for n in more)) for i, p in enumerate(xyz)], kinds).select(*names)


def test_voxels_prefer_labelled_points(spark):
    p = points(spark, [(0.01, 0.01, 0.01), (0.02, 0.02, 0.02), (0.3, 0, 0)], tree=[0, 17, 0])
    assert sorted(r[0] for r in rows(grid.voxel_dedup(p, 0.25, first=F.col("tree") > 0, snapped=True), "tree")) == [0, 17]
    assert sorted(r[0] for r in rows(grid.voxel_dedup(p, 0.25, snapped=True), "pid")) == [0, 2]


def test_windows_own_every_point_once(spark):
    for low, high in ((0.0, 40.0), (0.0, 7.0), (1.5, 33.3)):
        p = spark.createDataFrame([(x,) for x in np.linspace(low, high, 57).tolist()], "x double")
        w = grid.windows(p, "x", 20.0, 12.0, low, high)
        assert w.where("owner").count() == 57
    assert grid.starts(0, 40, 20, 8) == [0, 12, 20]
    assert grid.owners([0, 12, 20], 20, 0, 40) == [(0, 16.0), (16.0, 26.0), (26.0, 40)]


def test_tiles_have_one_owner(spark):
    p = points(spark, np.random.default_rng(3).uniform(-30, 30, (50, 3)))
    assert grid.tiles(p, 10.0, 4.0).where("owner").count() == 50


def test_annotation_targets(spark):
    df = spark.createDataFrame([(0, 3), (0, 2), (1, 5), (2, 0), (0, 0), (0, 4)], "id long, c int")
    i, s = labels.annotation_targets(F.col("id"), F.col("c"), bush_ids=(2,))
    got = [tuple(r) for r in df.select(i, s).collect()]
    assert got == [(-1, -1), (0, 0), (1, 1), (0, 0), (-1, -1), (-1, 1)]


def test_boundary_instances_become_unknown(spark):
    p = points(spark, [(0.1, 5, 0), (1, 5, 0), (4, 4, 0), (5, 5, 0)], truth=[1, 1, 2, 2])
    assert [r.truth for r in labels.without_cut_instances(p, "truth", (0, 0, 10, 10), 0.75).orderBy("pid").collect()] == [-1, -1, 2, 2]


def test_majority_ignores_unknown(spark):
    df = spark.createDataFrame([(0, -1), (0, -1), (0, 3), (1, 2), (1, 1), (2, -1)], "g int, truth long")
    assert rows(labels.majority(df, "g")) == [(0, 3), (1, 1), (2, 0)]


def test_nearest_and_margin(spark):
    a = points(spark, [(0, 0, 0), (5, 0, 0), (50, 0, 0)])
    b = spark.createDataFrame([(0, 7, 1.0, 0.0), (0, 8, -1.0, 0.0), (0, 9, 5.5, 0.0)], "dataset_id int, t long, x double, y double")
    assert rows(spatial.nearest(a, b, 2.0, "pid", "t")) == [(0, 7, 1.0), (1, 9, 0.25)]
    assert rows(spatial.nearest_with_margin(a, b, 2.0, 0.5, "pid", "t")) == [(1, 9)]


def test_neighbour_edges_by_brute_force(spark):
    xyz = np.random.default_rng(5).uniform(0, 3, (60, 3))
    want = set()
    for i, p in enumerate(xyz):
        d = np.sqrt(((xyz - p) ** 2).sum(1))
        want |= {(min(i, int(j)), max(i, int(j))) for j in np.lexsort((np.arange(60), d)) if j != i and d[j] <= 1.0 and (d < d[j]).sum() <= 4}
    got = {(r.src, r.dst) for r in spatial.neighbour_edges(points(spark, xyz), 1.0, 5).collect()}
    assert got == want


def test_rings(spark):
    ring = "array(struct(0D as x, 0D as y), struct(4D as x, 0D as y), struct(4D as x, 3D as y), struct(0D as x, 3D as y))"
    r = spark.range(1).select(spatial.ring_area(F.expr(ring)).alias("a"), spatial.in_ring(F.lit(1.0), F.lit(1.0), F.expr(ring)).alias("i"), spatial.in_ring(F.lit(5.0), F.lit(1.0), F.expr(ring)).alias("o"), F.size(spatial.boundary_points(F.expr(ring), 1.0)).alias("n")).first()
    assert tuple(r) == (12.0, True, False, 14)


def test_fill_nearest(spark):
    known = spark.createDataFrame([(0, 0, 0, 1.0), (0, 40, 40, 2.0)], "dataset_id int, row long, col long, dtm double")
    holes = spark.createDataFrame([(0, 1, 1), (0, 30, 33), (0, 20, 20), (1, 0, 0)], "dataset_id int, row long, col long")
    assert rows(raster.fill_nearest(holes, known, "dtm")) == [(0, 1, 1, 1.0), (0, 20, 20, 1.0), (0, 30, 33, 2.0)]


def test_treetops_by_brute_force(spark):
    rng = np.random.default_rng(9)
    chm = rng.integers(2, 6, (12, 12)).astype(float)
    window = lambda h: 2.0 if h < 3 else 0.1 * h + 2
    taken = []
    for r, c in itertools.product(range(12), range(12)):
        near = [(a, b) for a, b in itertools.product(range(12), range(12)) if (a - r) ** 2 + (b - c) ** 2 <= (window(chm[r, c]) / 2) ** 2 + 1e-9]
        if not any(chm[q] > chm[r, c] for q in near) and not any(q in taken and chm[q] == chm[r, c] for q in near):
            taken.append((r, c))
    df = spark.createDataFrame([(0, r, c, float(chm[r, c])) for r, c in itertools.product(range(12), range(12))], "dataset_id int, row long, col long, chm double")
    got = rows(raster.treetops(df, 1.0, 2.0, raster.window_size(F.col("h")), 3.0), "row", "col")
    assert got == sorted(taken, key=str)


def mask_table(spark, members, scores, z=3.0):
    data = [(0, m, p, float(p % 12) * 0.5, float(p // 12) * 0.5, z, s, -1) for m, (pids, s) in enumerate(zip(members, scores, strict=True)) for p in pids]
    return spark.createDataFrame(data, "dataset_id int, mask_id long, pid long, x double, y double, z double, score double, truth long")


def test_reconcile(spark):
    mp = mask_table(spark, [range(8), range(6)], [0.9, 0.8])
    m = spark.createDataFrame([(0, 0.9), (1, 0.8)], "mask_id long, object_score double")
    fused, members = masks.reconcile(mp, m, least=4)
    assert members.select("group").distinct().count() == 1 and fused.count() == 8
    fused, members = masks.reconcile(mp, m, least=4, size_ratio=0.9)
    assert members.select("group").distinct().count() == 2 and fused.count() == 14


def ranked(spark, *scores):
    return spark.createDataFrame([(i, s, s) for i, s in enumerate(scores)], "mask_id long, ranking double, object_score double")


def test_greedy_claims(spark):
    mp = mask_table(spark, [range(16), range(16)], [1.0, 1.0])
    got = rows(greedy.claims(mp, ranked(spark, 0.9, 0.8), least=4), "label")
    assert got == [(0,)] * 16
    mp = mask_table(spark, [range(10), range(5, 15)], [1.0, 1.0])
    assert {r[0] for r in rows(greedy.claims(mp, ranked(spark, 0.9, 0.8), limit=0.2, least=4), "label")} == {0}


def test_support_fusion_is_not_transitive(spark):
    lattice = {p: (float(p // 4) * 0.5, float(p % 4) * 0.5) for p in range(48)}

    def cloud(*members):
        rows_ = [(0, m, p, *lattice[p], 3.0, 0.9) for m, ids in enumerate(members) for p in ids]
        return spark.createDataFrame(rows_, "dataset_id int, mask_id long, pid long, x double, y double, z double, score double")

    def fused(*members, anchor):
        mp = cloud(*members)
        a = mp.where("mask_id = 0").where(F.col("pid") < anchor).select("pid", F.lit(1).cast("long").alias("label"), "x", "y", "z")
        r = spark.createDataFrame([(m, len(ids), 0.8, 0.7 - m * 0.1) for m, ids in enumerate(members)], "mask_id long, n long, object_score double, ranking double")
        return {x[0] for x in rows(masks.fuse_support(a, r, mp, lambda q: spatial.near_own_group(q, a, 1.5, "label")), "pid")}

    assert fused(range(12), range(20), anchor=12) == set(range(12, 20))
    assert fused(range(12), range(20), range(8, 28), anchor=12) == set(range(12, 20))


def test_consensus_codes(spark):
    data = []
    for p in range(96):
        x, y = p // 4 * 0.5, p % 4 * 0.5
        anchor = 1 if x < 3 else 0
        other = 11 if x < 5 else 12 if x >= 8 else 0
        data.append((p, 0, x, y, 5.0, 2.5 if x < 5 else 10.0, 1.0, 0.9, anchor, other))
    df = spark.createDataFrame(data, "pid long, dataset_id int, x double, y double, z double, vx double, vy double, p double, anchor long, other long")
    got = {r.pid: (r.label, r.source) for r in consensus.fuse(df).collect()}
    assert all(got[p] == (1, 1) for p in range(24))
    assert got[24] == (1, 2) and got[95] == (13, 3) and got[50] == (0, 0)
    narrow = consensus.fuse(df, consensus.Consensus(new_area=1000.0))
    assert narrow.where("source = 3").isEmpty()
    with pytest.raises(ValueError):
        consensus.Consensus(dominance=0.4)


def test_assign_masks(spark):
    def run(p, objects, least):
        mp = spark.createDataFrame([(0, q, i, float(v)) for q, row in enumerate(p) for i, v in enumerate(row) if v >= 0.5], "dataset_id int, mask_id long, pid long, score double")
        return dict(rows(greedy.competing(mp, ranked(spark, *objects), least=least), "pid", "label"))

    assert run([[0.95, 0.95, 0.7, 0.1, 0.1, 0.1], [0.1, 0.1, 0.75, 0.95, 0.95, 0.1]], (1.0, 1.0), 2) == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1}
    assert run([[0.9, 0.9, 0.1], [0.8, 0.8, 0.1]], (1.0, 1.0), 2) == {0: 0, 1: 0}


def test_suppression_by_brute_force(spark):
    rng = np.random.default_rng(2)
    conf = {i: float(c) for i, c in enumerate(rng.permutation(40))}
    pairs = [(i, j, float(rng.random())) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.1]
    bad = {(a, b) for a, b, v in pairs if v >= 0.4}
    kept = []
    for i in sorted(conf, key=lambda k: -conf[k]):
        if not any((min(i, k), max(i, k)) in bad for k in kept):
            kept.append(i)
    got = greedy.suppressed(spark.createDataFrame(pairs, "a long, b long, iou double"), spark.createDataFrame(list(conf.items()), "id long, confidence double"), 0.4)
    assert sorted(r.id for r in got.collect()) == sorted(kept)


def test_bounded_groups(spark):
    p = points(spark, [(0, 0, 0), (0.2, 0, 0), (1.2, 0, 0), (1.4, 0, 0)])
    e = spark.createDataFrame([(0, 1, 0.99), (1, 2, 0.99), (2, 3, 0.99)], "src long, dst long, probability double")
    got = dict(rows(greedy.bounded_groups(p, e, 0.5, extent=0.6)))
    assert got[0] == got[1] != got[2] == got[3]


def test_assignment_by_brute_force():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (2, 3), (4, 4), (5, 3)):
        for _ in range(20):
            c = rng.random((n, m))
            best = min(sum(c[i, j] for i, j in zip(range(n), q)) for q in itertools.permutations(range(m), n)) if n <= m else min(sum(c[i, j] for j, i in zip(range(m), q)) for q in itertools.permutations(range(n), m))
            assert sum(c[i, j] for i, j in kernels.assignment(c)) == pytest.approx(best)


def test_overlapping_shapes_are_matched_one_to_one(spark):
    pairs = spark.createDataFrame([(0, 1, 1, 0.6), (0, 1, 2, 0.9), (0, 2, 2, 0.55)], "dataset_id int, a long, b long, iou double")
    assert rows(kernels.assigned(pairs, "dataset_id", "a", "b"), "a", "b") == [(1, 1), (2, 2)]


def test_hulls(spark):
    square = points(spark, [(0, 0, 0), (2, 0, 0), (2, 2, 0), (0, 2, 0), (1, 1, 0)], t=[1] * 5)
    r = kernels.hulls(square, "t").first()
    assert (r.area, r.corners) == (4.0, 4)
    assert kernels.hull_area(np.array([[0.0, 0.0]]), 1.0) == pytest.approx(np.pi)


def test_footprints(spark):
    ring = [(r, c) for r in range(5) for c in range(5) if not (1 <= r <= 3 and 1 <= c <= 3)] + [(20, 20)]
    df = spark.createDataFrame([(0, 1, r, c) for r, c in ring], "dataset_id int, t long, row long, col long")
    assert kernels.cleaned_footprints(df, "t").count() == 25
    assert kernels.cleaned_footprints(df, "t", parts="all").count() == 26


def test_watershed_divides_two_hills(spark):
    chm = spark.createDataFrame([(0, 0, c, float(h)) for c, h in enumerate([5, 4, 3, 4, 6, 5])], "dataset_id int, row long, col long, chm double")
    tops = spark.createDataFrame([(0, 0, 0, 1), (0, 0, 4, 2)], "dataset_id int, row long, col long, tree_id long")
    got = dict(rows(flooding.watershed(chm, tops, 2.0), "col", "tree_id"))
    assert got == {0: 1, 1: 1, 2: 1, 3: 2, 4: 2, 5: 2}


def test_farthest_points(spark):
    p = points(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0), (5, 0, 0)], g=[1] * 4)
    assert [r.pid for r in kernels.farthest(p, 3, "g").orderBy("place").collect()] == [2, 0, 3]


def test_revision_splits_and_merges(spark):
    line = [(i * 0.5, 0, 5) for i in range(32)]

    def run(label, mask, p=0.9):
        df = points(spark, line, label=label, mask=mask).withColumn("p", F.lit(p))
        return {(r.label, r.code) for r in revision.revised(df).collect()}

    assert run([1] * 32, [1] * 16 + [2] * 16) == {(64, 6), (65, 6)}
    close = [1] * 16 + [2] * 16
    df = points(spark, [(i * 0.1, 0, 5) for i in range(32)], label=close, mask=[1] * 32).withColumn("p", F.lit(0.9))
    assert {(r.label, r.code) for r in revision.revised(df).collect()} == {(64, 7)}
    assert run([1] * 32, [1] * 16 + [2] * 16, 0.1) == {(64, 0)}


def test_shared_queries(spark):
    def run(*members):
        data = [(m, p, p * 0.2, 0.0, z, 0.9, 0.8, 0.7 - m * 0.01) for m, ids in enumerate(members) for p in ids]
        df = spark.createDataFrame(data, "mask_id long, pid long, x double, y double, z double, score double, weight double, ranking double")
        return revision.shared_queries(df, how).select("label").distinct().count()

    z, how = 5.0, revision.Shared()
    assert run(range(24), range(24)) == 1
    assert run(range(24), range(18, 48)) == 2
    assert run(range(24), range(18, 48), range(0, 24), range(17, 48)) == 2
    assert run(range(24), range(14, 40)) == 2
    how = revision.Shared(area=1.1)
    assert run(range(24), range(14, 40)) == 1
    z, how = 1.0, revision.Shared()
    assert run(range(24)) == 0


def test_beam_returns_highest_first(spark):
    p = points(spark, [(0.1, 0.1, 5.0), (0.1, 0.1, 10.0)])
    got = revision.beam_returns(p, opacity=1000.0, transmission=0.999999).orderBy("place").collect()
    assert [r.pid for r in got] in ([1, 0], [1]) and got[0].pid == 1


def test_small_additions_and_splits(spark):
    xyz = [(i % 5 * 0.4, i // 5 * 0.4, 4.0) for i in range(25)] + [(20 + i % 5 * 0.4, i // 5 * 0.4, 3.0) for i in range(25)]
    df = points(spark, xyz, anchor=[1] * 25 + [0] * 25, proposal=[5] * 10 + [0] * 15 + [6] * 25).withColumn("p", F.lit(0.8))
    assert {r.proposal for r in revision.small_additions(df).collect()} == {6}
    lower = points(spark, [(i * 0.5, 0, 8.0 if i == 0 else 6.0 if i < 40 else 5.0) for i in range(50)], anchor=[1] * 50, proposal=[0] * 40 + [9] * 10).withColumn("p", F.lit(0.8))
    assert rows(revision.internal_splits(lower)) == [(9, 1)]


def test_sampling_weights(spark):
    df = spark.createDataFrame([(1, True, "A", None), (2, True, "B", None), (3, True, "B", None), (4, False, None, "p"), (5, False, None, "p"), (6, False, None, "p"), (7, False, None, "q")], "id int, real boolean, g string, parent string")
    w = {r.id: r.weight for r in governance.sampling_weights(df, F.col("real"), ["g"], "parent").collect()}
    assert sum(w.values()) == pytest.approx(1) and w[1] == pytest.approx(w[2] + w[3]) and w[7] == pytest.approx(w[4] + w[5] + w[6]) and w[1] + w[2] + w[3] == pytest.approx(0.75)


def test_bootstrap_covers_the_mean(spark):
    rng = np.random.default_rng(0)
    v = rng.normal(5, 1, 80)
    df = spark.createDataFrame([(i % 2, float(x)) for i, x in enumerate(v)], "s int, v double")
    r = governance.bootstrap(df, "s", "v", 500).first()
    assert r.low < v.mean() < r.high and r.mean == pytest.approx(v.mean(), abs=0.05) and 0.2 < r.high - r.low < 0.8


def test_pairing_and_latest(spark):
    a, b = (spark.createDataFrame([(k,) for k in ks], "k int") for ks in ((1, 2), (2, 3)))
    assert rows(governance.paired(a, b, "k")) == [(1, "left"), (2, "both"), (3, "right")]
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 0)], "id int, v string, t int")
    assert rows(governance.latest(df, "id", "t")) == [(1, "b", 2), (2, "c", 0)]


def test_votes_give_two_trees(spark):
    rng = np.random.default_rng(0)
    xyz = [(*(rng.normal(c, 0.6, 2)), rng.uniform(1, 8)) for c in (5.0, 15.0) for _ in range(60)]
    df = points(spark, xyz).withColumn("p", F.lit(0.9)).withColumn("vx", F.when(F.col("x") < 10, 5.05).otherwise(15.05)).withColumn("vy", F.col("vx"))
    got = votes.instances(df, votes.Voting(separation=2.0)).join(df, "pid")
    assert got.count() == 120 and got.select("label").distinct().count() == 2
    assert got.groupBy("label").agg(F.countDistinct(F.col("x") < 10).alias("n")).where("n > 1").count() == 0
    assert votes.instances(df, votes.Voting(points=61)).count() == 0
    with pytest.raises(ValueError):
        votes.Voting(radius=0)


def test_core_tiles_and_crops(spark):
    p = points(spark, [(1, 1, 1), (1, 2, 5), (9, 9, 3), (0.5, 0.5, 0)], label=[4, 4, 9, 0])
    assert rows(votes.in_core_tiles(p, (0, 0, 5, 5)), "pid", "label") == [(0, 1), (1, 1), (2, 0), (3, 0)]
    anchors = spark.createDataFrame([(0, 7, 1.0, 1.0)], "dataset_id int, anchor long, ax double, ay double")
    assert rows(votes.crop(p, anchors, 2.0, 10, 0.25), "pid", "x") == [(0, 0.0), (3, -0.5)]
    assert votes.crop(p, anchors, 2.0, 1, 0.25).count() == 1


def test_ignored_footprints_are_forgiven_once(spark):
    box = lambda i, a, b: [(0, i, r, c) for r in range(a, b) for c in range(4)]
    kinds = "dataset_id int, id long, row long, col long"
    truth = spark.createDataFrame(box(1, 0, 4), kinds)
    pred = spark.createDataFrame(box(1, 0, 4) + box(2, 0, 4) + box(3, 10, 14), kinds)
    ignore = spark.createDataFrame(box(0, 0, 4) + box(0, 10, 14), kinds)
    pairs = spatial.cell_overlap(truth, pred, 1.0).select("dataset_id", "a", "b", "iou")
    r = metrics.footprint_metrics(truth, pred, pairs, kernels.assigned(pairs, "dataset_id", "a", "b"), ignore).first()
    assert (r.tp, r.fp, r.fn, r.ignored) == (1, 1, 0, 1)


def test_boundary_distances(spark):
    ring = lambda k: f"array(struct({-k}D as x, {-k}D as y), struct({k}D as x, {-k}D as y), struct({k}D as x, {k}D as y), struct({-k}D as x, {k}D as y))"
    df = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("b"), F.expr(ring(2)).alias("ring_a"), F.expr(ring(3)).alias("ring_b"))
    r = spatial.boundary_distances(df, 0.25).first()
    assert 1.0 <= r["mean"] < 1.1 and 1.0 <= r.p95 <= 2**0.5
    assert spatial.boundary_distances(df.withColumn("ring_b", F.col("ring_a"))).first()["mean"] == 0


def test_hash_split_keeps_shares(spark):
    g = spark.createDataFrame([(f"g{i}", "a" if i < 20 else "b" if i < 22 else "c") for i in range(23)], "group_id string, s string")
    n = {(r.s, r.model_split): r["count"] for r in governance.hash_split(g, "s", 1).groupBy("s", "model_split").count().collect()}
    assert n == {("a", "test"): 3, ("a", "val"): 3, ("a", "train"): 14, ("b", "test"): 1, ("b", "train"): 1, ("c", "train"): 1}


def grouped_in_order(masks_, how):
    """Grouping of proposals one after the other: (mask, label) of those that found or join a group."""
    groups, out = [], []
    for m, (rank, pids, xy) in sorted(masks_.items(), key=lambda t: (-t[1][0], t[0])):
        mid, own = np.median(xy, axis=0), set(pids)
        around = [g for g in groups if ((g["mid"] - mid) ** 2).sum() <= how.around**2]
        like = [g for g in around if ((g["mid"] - mid) ** 2).sum() <= how.distance**2 and (len(own & g["own"]) / len(own | g["own"]) >= how.iou or len(own & g["own"]) / min(len(own), len(g["own"])) >= how.containment)]
        if like:
            like[0]["own"] |= own
            out.append((m, like[0]["id"]))
            continue
        free = own - set().union(*(g["own"] for g in around))
        if len(free) >= how.points and len(free) / len(own) >= how.unique:
            groups.append({"id": m, "mid": mid, "own": own})
            out.append((m, m))
    return sorted(out)


def test_grouped_queries_by_brute_force(spark):
    rng, how = np.random.default_rng(3), revision.Shared(points=4, area=0.0, distance=1.5, around=4.0)
    cloud = rng.random((160, 2)) * 12
    masks_ = {}
    for m in range(40):
        c = cloud[rng.integers(160)]
        pids = np.flatnonzero(((cloud - c) ** 2).sum(1) <= rng.uniform(1.0, 2.2) ** 2)
        masks_[m] = (float(rng.integers(12)), pids.tolist(), cloud[pids])
    data = [(0, m, int(p), *map(float, cloud[p]), rank) for m, (rank, pids, _) in masks_.items() for p in pids]
    df = spark.createDataFrame(data, "dataset_id int, mask_id long, pid long, x double, y double, ranking double")
    got = rows(revision.grouped_queries(df, how))
    assert sorted(got) == grouped_in_order(masks_, how) and len({g for _, g in got}) < len(got)


def test_bounded_groups_by_brute_force(spark):
    rng = np.random.default_rng(5)
    xyz = rng.random((60, 3)) * 3
    pairs = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(60, size=(260, 2)) if a != b})
    edges = [(a, b, float(rng.integers(40, 100)) / 100) for a, b in pairs]
    at = {i: {i} for i in range(60)}
    for a, b, p in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        if p >= 0.5 and at[a] is not at[b]:
            both = at[a] | at[b]
            if len(both) <= 6 and np.linalg.norm(np.ptp(xyz[sorted(both)], axis=0)) <= 2.5:
                for i in both:
                    at[i] = both
    got = dict(rows(greedy.bounded_groups(points(spark, xyz.tolist()), spark.createDataFrame(edges, "src long, dst long, probability double"), 0.5, extent=2.5, most=6)))
    assert got == {i: min(g) for i, g in at.items()} and len(set(got.values())) < 60


def test_windows_write_each_point_once(spark):
    from understory.operators.predict import by_windows

    p = points(spark, [(float(i), float(i % 5), 0.0) for i in range(50)])
    got = rows(by_windows(p, 7.0, 2.0, lambda pdf: pdf["x"] + len(pdf) * 0, ("x",)), "pid", "score")
    assert got == sorted([(i, float(i)) for i in range(50)], key=str)
    with pytest.raises(ValueError, match="once"):
        by_windows(p.union(p), 7.0, 2.0, lambda pdf: pdf["x"], ("x",))


def test_terrain_without_ground(spark):
    def run(z, kind, **how):
        p = points(spark, [(x + 0.5, y + 0.5, z + (4 if (x, y) == (2, 2) else 0)) for x in range(6) for y in range(6)], classification=[kind] * 36)
        return {(round(r.dtm, 6), r.method) for r in raster.ground(p, 1.0, **how).collect()}

    assert run(1.0, 5) == {(0.0, "zero")} and run(9.0, 5) == {(9.0, "envelope")}
    assert run(1.0, 2, zero_first=True) == {(0.0, "zero")} and run(1.0, 2) == {(1.0, "class2"), (5.0, "class2")}
