"""Tables of a row a point or an edge are written as few bytes, and only where they must be."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from understory.functions import checkpoint
from understory.operators import consensus, greedy, votes

from conftest import rows


def test_stored_tables_are_the_same_and_smaller(spark):
    df = spark.range(40000).select("id", (F.col("id") % 50).cast("double").alias("y"), F.struct((F.col("id") % 7).alias("g"), F.lit(None).cast("int").alias("n")).alias("a"), F.lit(1.0).alias("e"))
    got = checkpoint.stored(df)
    assert got.columns == df.columns and got.exceptAll(df).isEmpty() and got.count() == 40000
    size = sum(os.path.getsize(f.removeprefix("file:")) for f in got.inputFiles() for f in [f.replace("file://", "")])
    assert size < 40000 * 16
    assert checkpoint.stored(df.limit(0)).count() == 0


def test_consensus_writes_no_copy_of_all_points(spark, monkeypatch):
    """Only points with their labels are written, without what the labels were made of."""
    cuts = []
    monkeypatch.setattr(consensus, "cut", lambda df, f=consensus.cut: cuts.append(df.columns) or f(df))
    data = [(i, 0, i / 10, 0.0, 5.0, i / 10, 0.0, 0.9, 1 if i < 20 else 0, 7) for i in range(40)]
    p = spark.createDataFrame(data, "pid long, dataset_id int, x double, y double, z double, vx double, vy double, p double, anchor long, other long")
    got = rows(consensus.fuse(p, consensus.Consensus(growth=1.0)), "pid")
    assert len(got) == 40 and len(cuts) == 1 and not {"anchor", "other"} & set(cuts[0])


def test_edges_of_an_agglomeration_are_stored(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(greedy, "stored", lambda df, f=greedy.stored: kept.append(df.columns) or f(df))
    p = spark.createDataFrame([(i, i * 0.2, 0.0, 0.0) for i in range(6)], "pid long, x double, y double, z double")
    e = spark.createDataFrame([(i, i + 1, 0.9) for i in range(5)], "src long, dst long, probability double")
    assert len({g for _, g in rows(greedy.bounded_groups(p, e, 0.5, extent=5.0))}) == 1 and kept


def test_points_of_vote_instances_are_found_once(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(votes, "stored", lambda df, f=votes.stored: kept.append(df.columns) or f(df))
    p = spark.createDataFrame([(0, i, i % 5 / 4, i // 5 / 4, 3.0, 0.5, 0.5, 0.9) for i in range(25)], "dataset_id int, pid long, x double, y double, z double, vx double, vy double, p double")
    assert votes.instances(p, votes.Voting(points=8)).count() == 25 and len(kept) == 1
