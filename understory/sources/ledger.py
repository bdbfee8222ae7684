"""Commits of several tables as one, and a ledger of frozen choices and single test runs.

Everything rests on one step that only one writer can win: creating a file that must not exist yet, through the Hadoop
file system. Files of the ledger are never changed, and one that is not whole counts as not there.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from .sinks import _digest, _files, aside, publish


def create_once(spark: SparkSession, path: str, record: Mapping) -> bool:
    """Write ``record`` as JSON to a path that must be new; False if another was first."""
    fs, at = _files(spark, path)
    fs.mkdirs(at.getParent())
    try:
        out = fs.create(at, False)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    try:
        out.write(bytearray(json.dumps({**record, "whole": True}, sort_keys=True), "utf-8"))
    finally:
        out.close()
    return True


def read_record(spark: SparkSession, path: str) -> dict | None:
    """The record at a path, or None if there is none or its writer died before it was whole."""
    fs, at = _files(spark, path)
    if not fs.exists(at):
        return None
    stream = fs.open(at)
    try:
        text = bytes(spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)).decode()
    finally:
        stream.close()
    try:
        found = json.loads(text)
    except ValueError:
        return None
    return {k: v for k, v in found.items() if k != "whole"} if found.get("whole") else None


# several tables, one commit


def versions(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the commit files in a folder, whole or not."""
    fs, at = _files(spark, f"{folder}/_commits")
    names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())


def current(spark: SparkSession, folder: str) -> tuple[int, dict[str, str]]:
    """The newest whole commit: its number and the path of each table; (-1, {}) before the first."""
    for n in reversed(versions(spark, folder)):
        if found := read_record(spark, f"{folder}/_commits/{n}.json"):
            return n, found["tables"]
    return -1, {}


def commit(spark: SparkSession, folder: str, tables: Mapping[str, DataFrame], base: int | None = None) -> int:
    """Write every table to a new place and then name all places in one commit file; gives its number.

    Readers go by the newest whole commit, so they see all tables of it or none, whatever step a writer died at. Each
    table is read back and compared with what was written. ``base``: the commit that the tables were made from; if
    another came after it, nothing is committed. Tables that are not given keep their place.
    """
    last, held = current(spark, folder)
    if base is not None and base != last:
        raise RuntimeError(f"{folder} is at commit {last}, not {base}")
    places = dict(held)
    for name, df in tables.items():
        places[name] = f"{folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(places[name])
        back = spark.read.parquet(places[name])
        if back.agg(*_digest(back.columns)).first() != df.agg(*_digest(df.columns)).first():
            raise ValueError(f"{name} differs from what was written")
    number = max(versions(spark, folder), default=-1) + 1
    if not create_once(spark, f"{folder}/_commits/{number}.json", {"tables": places}):
        raise RuntimeError(f"another writer made commit {number} of {folder}")
    return number


def committed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of the newest commit."""
    return {name: spark.read.parquet(path) for name, path in current(spark, folder)[1].items()}


# frozen choices and single runs


def signature(parameters: Mapping, **inputs: DataFrame) -> str:
    """A hash of parameters and of the rows of tables, in whatever order they lie; columns and their types count."""
    held = {n: [sorted(df.dtypes), list(df.agg(*_digest(sorted(df.columns))).first())] for n, df in inputs.items()}
    return hashlib.sha256(json.dumps([dict(parameters), held], sort_keys=True).encode()).hexdigest()


def cached(spark: SparkSession, folder: str, key: str, make: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """The table that ``key`` (a signature) names, made only if it is not there; and whether it was."""
    path = f"{folder}/{key}"
    fs, at = _files(spark, path)
    hit = fs.exists(at)
    if not hit:
        publish(spark, (aside(make(), path), path))
    return spark.read.parquet(path), hit


def freeze(spark: SparkSession, folder: str, choice: Mapping) -> dict:
    """Make ``choice`` the one that is tested; it can never be replaced."""
    if not create_once(spark, f"{folder}/frozen.json", choice):
        raise RuntimeError("a choice is frozen already")
    return dict(choice)


def test_once(spark: SparkSession, folder: str, key: str, run: Callable[[dict], DataFrame]) -> DataFrame:
    """The frozen choice's result on held-out data; a folder allows one run, even if it fails.

    ``key``: the signature that the choice was frozen with; it must hold for the data of now.
    """
    choice = read_record(spark, f"{folder}/frozen.json")
    if choice is None:
        raise RuntimeError("nothing is frozen")
    if choice["signature"] != key:
        raise RuntimeError("inputs or parameters have changed since the choice was frozen")
    if not create_once(spark, f"{folder}/tested.json", {"signature": key}):
        raise RuntimeError("the test has been run")
    path = f"{folder}/result"
    publish(spark, (aside(run(choice), path), path))
    return spark.read.parquet(path)


def best(scores: DataFrame, baseline: str, name: str = "model", by: tuple[str, ...] = ("pq", "f1")) -> dict | None:
    """The row of highest ``by`` that exceeds the baseline's row in all of them; None if none does. One row a candidate."""
    base = scores.where(F.col(name) == baseline).select(*(F.col(c).alias(f"_{c}") for c in by))
    better = scores.where(F.col(name) != baseline).join(F.broadcast(base), F.expr(" AND ".join(f"{c} > _{c}" for c in by)))
    row = better.agg(F.max_by(F.struct(name, *by), F.struct(*by, name)).alias("b")).first()["b"]
    return row.asDict() if row else None
