"""Commits, ledgers and locks under crashes; merge trees and bracket searches against separate runs."""

from __future__ import annotations

import math
import random
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from understory.functions.checkpoint import mounted
from understory.operators import greedy, search
from understory.sources import ledger, readers, sinks


def table(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v long")


def seen(spark, folder):
    return {n: [r.v for r in t.orderBy("v").collect()] for n, t in ledger.committed(spark, folder).items()}


def test_a_commit_is_whole_or_not_there(spark, tmp_path, monkeypatch):
    folder, four = str(tmp_path), ("chm", "labels", "crowns", "visible")
    assert seen(spark, folder) == {} and ledger.commit(spark, folder, {n: table(spark, 1) for n in four}) == 0
    old = {n: [1] for n in four}
    assert seen(spark, folder) == old

    # a writer that dies after each step leaves the old set
    written, real = [], ledger.aside
    for step in range(1, 5):
        class Crash(Exception):
            pass

        def digest(names, step=step):
            written.append(names)
            if len(written) == 2 * step:
                raise Crash
            return sinks._digest(names)

        written.clear()
        monkeypatch.setattr(ledger, "_digest", digest)
        with pytest.raises(Crash):
            ledger.commit(spark, folder, {n: table(spark, 2) for n in four})
        assert seen(spark, folder) == old
    monkeypatch.setattr(ledger, "_digest", sinks._digest)
    monkeypatch.setattr(ledger, "create_once", lambda *a: (_ for _ in ()).throw(Crash()))
    with pytest.raises(Crash):
        ledger.commit(spark, folder, {n: table(spark, 2) for n in four})
    monkeypatch.undo()
    assert seen(spark, folder) == old and real is ledger.aside
    (tmp_path / "_commits" / "1.json").write_text('{"tables": {"chm": "no')  # died while it wrote the commit file
    assert seen(spark, folder) == old
    assert ledger.commit(spark, folder, {"chm": table(spark, 3)}, base=0) == 2
    assert seen(spark, folder) == old | {"chm": [3]}
    with pytest.raises(RuntimeError, match="is at commit 2"):
        ledger.commit(spark, folder, {"chm": table(spark, 4)}, base=0)


def test_a_frozen_choice_is_tested_once(spark, tmp_path):
    folder, data = str(tmp_path), table(spark, 1, 2, 3)
    key = ledger.signature({"a": 1}, data=data)
    assert key == ledger.signature({"a": 1}, data=data.orderBy(F.desc("v")).repartition(3))
    assert len({key, ledger.signature({"a": 2}, data=data), ledger.signature({"a": 1}, data=data.union(data)), ledger.signature({"a": 1}, data=data.select(F.col("v").cast("int")))}) == 4
    with pytest.raises(RuntimeError, match="nothing is frozen"):
        ledger.test_once(spark, folder, key, lambda c: data)
    ledger.freeze(spark, folder, {"signature": key, "model": "m"})
    with pytest.raises(RuntimeError, match="frozen already"):
        ledger.freeze(spark, folder, {"signature": key, "model": "n"})
    with pytest.raises(RuntimeError, match="have changed"):
        ledger.test_once(spark, folder, ledger.signature({"a": 1}, data=table(spark, 9)), lambda c: data)
    got = ledger.test_once(spark, folder, key, lambda c: data.withColumn("model", F.lit(c["model"])))
    assert rows(got) == [(1, "m"), (2, "m"), (3, "m")]
    with pytest.raises(RuntimeError, match="has been run"):
        ledger.test_once(spark, folder, key, lambda c: data)


def test_a_failed_test_run_is_no_second_chance(spark, tmp_path):
    ledger.freeze(spark, str(tmp_path), {"signature": "k"})
    with pytest.raises(ZeroDivisionError):
        ledger.test_once(spark, str(tmp_path), "k", lambda c: 1 / 0)
    with pytest.raises(RuntimeError, match="has been run"):
        ledger.test_once(spark, str(tmp_path), "k", lambda c: table(spark, 1))


def test_a_cache_goes_by_signature(spark, tmp_path):
    made = []

    def make(v):
        made.append(v)
        return table(spark, v)

    for key, v, hit in (("x", 1, False), ("x", 2, True), ("y", 2, False)):
        got, was = ledger.cached(spark, str(tmp_path), key, lambda v=v: make(v))
        assert was == hit and rows(got) == [(1 if key == "x" else 2,)]
    assert made == [1, 2]


def test_the_best_candidate_exceeds_the_baseline_in_all(spark):
    s = lambda *r: spark.createDataFrame(r, "model string, pq double, f1 double")
    assert ledger.best(s(("base", 0.5, 0.5), ("a", 0.9, 0.5), ("b", 0.6, 0.6), ("c", 0.6, 0.7)), "base") == {"model": "c", "pq": 0.6, "f1": 0.7}
    assert ledger.best(s(("base", 0.5, 0.5), ("a", 0.9, 0.4)), "base") is None


def test_a_lock_left_by_a_crash_is_taken_down(spark, tmp_path):
    path = str(tmp_path / "t")
    (tmp_path / "t.lock").write_text("")
    with pytest.raises(TimeoutError), sinks.locked(spark, path, wait=0.3, lease=60):
        pass
    time.sleep(1.2)
    with sinks.locked(spark, path, wait=5, lease=1):
        assert (tmp_path / "t.lock").exists()
    assert not (tmp_path / "t.lock").exists()


def test_other_file_systems_are_refused(spark):
    assert mounted("file:///a/b") == mounted("file:/a/b") == mounted("/a/b") == "/a/b"
    for path in ("hdfs://host/a", "s3a://bucket/a", "viewfs://store/a"):
        with pytest.raises(ValueError, match="mount"):
            sinks.binary_files(table(spark, 1), path, lambda t: b"", ".bin")
        with pytest.raises(ValueError, match="mount"):
            readers.LasReader({"path": path})


def test_one_tree_gives_the_groups_of_every_threshold(spark):
    r = random.Random(6)
    xyz = [(r.uniform(0, 4), r.uniform(0, 4), 0.0) for _ in range(120)]
    p = spark.createDataFrame([(i, 1, *c) for i, c in enumerate(xyz)], "pid long, dataset_id int, x double, y double, z double")
    edges = [(i, j, r.randint(1, 20) / 20) for i in range(120) for j in range(i + 1, 120) if math.dist(xyz[i], xyz[j]) < 0.7]
    e = spark.createDataFrame(edges, "src long, dst long, probability double")
    limits = [0.2, 0.5, 0.8, 1.0]
    tree = greedy.merge_tree(p, e, 0.2, extent=1.5, most=9)
    got = greedy.tree_groups(p, tree, limits)
    sizes = {t: n for t, n in greedy.tree_sizes(p, tree, limits, "dataset_id").select("threshold", "groups").collect()}
    for t in limits:
        alone = rows(greedy.bounded_groups(p, e, t, extent=1.5, most=9))
        assert rows(got.where(F.col("threshold") == t), "pid", "group") == alone
        assert sizes[t] == len({g for _, g in alone})
    assert len(set(sizes.values())) == len(limits)
    # extents as a column: two deals of the same points, each as by itself
    both = p.withColumn("extent", F.lit(1.5)).union(p.withColumn("pid", F.col("pid") + 1000).withColumn("extent", F.lit(0.9)))
    deals = e.union(e.select(F.col("src") + 1000, F.col("dst") + 1000, "probability"))
    two = rows(greedy.tree_groups(both, greedy.merge_tree(both, deals, 0.2, most=9), [0.5]), "pid", "group")
    assert two == sorted(rows(greedy.bounded_groups(p, e, 0.5, extent=1.5, most=9)) + [(a + 1000, b + 1000) for a, b in rows(greedy.bounded_groups(p, e, 0.5, extent=0.9, most=9))], key=str)
    assert greedy.merge_tree(p, e.limit(0), 0.2).count() == 0


def test_brackets_of_all_plots_equal_one_plot_at_a_time(spark):
    power = {1: 0.5, 2: 1.0, 3: 2.0, 4: 3.0}
    targets = spark.createDataFrame([(k, 5.0) for k in power], "dataset_id int, target double")
    f = F.element_at(F.create_map(*(F.lit(x) for kv in power.items() for x in kv)), F.col("dataset_id"))
    got = search.bracketed(targets, lambda s: s.select("dataset_id", F.pow("setting", f).alias("value")), 0.5, 32.0, 7)
    for k, a in power.items():
        low, high, want = 0.5, 32.0, []
        for _ in range(7):
            at = math.sqrt(low * high)
            want.append((at, at**a))
            low, high = (at, high) if at**a < 5 else (low, at)
        mine = got.where(F.col("dataset_id") == k).orderBy("step").collect()
        assert [(r.setting, pytest.approx(r.value)) for r in mine] == want
        assert [r.step for r in mine if r.chosen] == [min(range(7), key=lambda i: abs(math.log(want[i][1] / 5)))]


def test_paired_differences_need_both_methods(spark):
    data = [(i, "s", m, float(i) + (0.25 if m == "b" else 0)) for i in range(20) for m in "ab"] + [(99, "s", "a", 1e9)]
    got = search.paired_bootstrap(spark.createDataFrame(data, "dataset_id int, source string, method string, value double"), "method", "a", "b", "value", "source", rounds=50).first()
    assert got.low == got.high == got.mean == pytest.approx(0.25)
