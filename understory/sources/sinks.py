"""Writers: verified and atomic tables, pairs, partitioned manifests, resumable shards, binary files, records, label lines.

What is published is complete: tables are written aside, compared if asked, and renamed into place.
"""

from __future__ import annotations

import os
import struct
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, Window

from ..functions.checkpoint import mounted

def _files(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def publish(spark: SparkSession, *moves: tuple[str, str]) -> None:
    """Rename (from, to) each, replacing what is there. All sources exist before the first rename, so no half is published early."""
    for source, _ in moves:
        fs, at = _files(spark, source)
        if not fs.exists(at):
            raise FileNotFoundError(source)
    for source, target in moves:
        fs, to = _files(spark, target)
        old = None
        if fs.exists(to):
            old = _files(spark, f"{target}.old-{uuid.uuid4().hex}")[1]
            fs.rename(to, old)
        fs.mkdirs(to.getParent())
        if not fs.rename(_files(spark, source)[1], to):
            raise OSError(f"cannot rename {source} to {target}")
        if old is not None:
            fs.delete(old, True)


def _digest(names: Sequence[str]) -> list[Column]:
    """Number of rows and two order-free sums of their hashes."""
    h = F.xxhash64(*names)
    return [F.count("*").alias("n"), F.sum(h.bitwiseAND(0x7FFFFFFF)).alias("low"), F.bit_xor(h).alias("mix")]


def aside(df: DataFrame, path: str, write: Callable[[DataFrame, str], None] | None = None) -> str:
    """Write ``df`` beside ``path`` (Parquet, or as ``write`` does) and give the place; nothing is published."""
    to = f"{path}.aside-{uuid.uuid4().hex}"
    (write or (lambda d, p: d.write.parquet(p)))(df, to)
    return to


def verified(df: DataFrame, path: str) -> DataFrame:
    """Write Parquet aside, read it back, and publish it only if it holds the same rows. ``df`` is computed once."""
    seen = Observation()
    to = aside(df.observe(seen, *_digest(df.columns)), path)
    back = df.sparkSession.read.parquet(to)
    if back.agg(*_digest(back.columns)).first().asDict() != seen.get:
        raise ValueError(f"{path} differs from what was written")
    publish(df.sparkSession, (to, path))
    return df.sparkSession.read.parquet(path)


def plain(df: DataFrame) -> DataFrame:
    """NaN as null in every column of floats."""
    return df.select(*(F.when(~F.isnan(n), F.col(n)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes))


def atomic(df: DataFrame, path: str, kind: str = "json") -> None:
    """Write JSON or CSV (with a header) aside and rename; NaN becomes null or empty."""
    publish(df.sparkSession, (aside(plain(df), path, lambda d, p: d.write.option("header", True).format(kind).save(p)), path))


def pair(first: DataFrame, first_path: str, second: DataFrame, second_path: str, by: str | None = None) -> None:
    """Two tables that belong together, partitioned by ``by``: both are written before either is published."""
    write = (lambda d, p: d.write.partitionBy(by).parquet(p)) if by else None
    publish(first.sparkSession, (aside(first, first_path, write), first_path), (aside(second, second_path, write), second_path))


def manifests(parts: Sequence[DataFrame], path: str, by: str = "model_split") -> None:
    """Union of tables with whatever columns each has, as CSV by split; NaN becomes empty."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    plain(out).write.mode("overwrite").partitionBy(by).csv(path, header=True)


def shard(df: DataFrame, path: str, signature: str, stripe: int) -> None:
    """Overwrite one stripe of a run; its signature is part of the path, so other runs' shards are not mixed in."""
    df.write.mode("overwrite").parquet(f"{path}/signature={signature}/stripe={stripe}")


def pending(jobs: DataFrame, spark: SparkSession, path: str, signature: str, key: str = "stripe") -> DataFrame:
    """Jobs whose shard is not there yet."""
    at = f"{path}/signature={signature}"
    fs, place = _files(spark, at)
    return jobs.join(spark.read.parquet(at).select(key).distinct(), key, "left_anti") if fs.exists(place) else jobs


@contextmanager
def locked(spark: SparkSession, path: str, wait: float = 60.0, lease: float = 600.0) -> Iterator[None]:
    """Hold ``path``.lock, a file that only one can create; wait for whoever holds it.

    A lock older than ``lease`` seconds was left by a crash and is taken down. Holders must be done within the lease.
    """
    fs, at = _files(spark, path + ".lock")
    until = time.time() + wait
    while not fs.createNewFile(at):
        if fs.exists(at) and time.time() - fs.getFileStatus(at).getModificationTime() / 1000 > lease:
            # renamed before it is deleted: of several that wait only one can take it down
            old = _files(spark, f"{path}.lock-{uuid.uuid4().hex}")[1]
            if fs.rename(at, old):
                fs.delete(old, False)
            continue
        if time.time() > until:
            raise TimeoutError(f"{path} is locked")
        time.sleep(0.1)
    try:
        yield
    finally:
        fs.delete(at, False)


def upsert(rows: DataFrame, path: str, key: str, at: str) -> DataFrame:
    """Append records under a lock; the result is the latest record of each key by ``at`` (ties: by the whole record)."""
    with locked(rows.sparkSession, path):
        rows.write.mode("append").parquet(path)
    held = rows.sparkSession.read.parquet(path)
    others = [c for c in held.columns if c not in (key, at)]
    newest = Window.partitionBy(key).orderBy(F.desc(at), *(F.desc(c) for c in others))
    return held.withColumn("_r", F.row_number().over(newest)).where("_r = 1").drop("_r")


def copy_without(collections: DataFrame, parts: DataFrame, links: DataFrame, key: str, part_key: str | list[str], keep: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collections that ``keep`` holds for, their parts, and the links of those parts: two cascaded left-semi joins."""
    left = collections.where(keep)
    own = parts.join(left, key, "left_semi")
    return left, own, links.join(own, part_key, "left_semi")


def binary_files(df: DataFrame, path: str, encode: Callable[[pa.Table], bytes], suffix: str, most: int = 1 << 20) -> DataFrame:
    """(file, n): a file for each ``most`` rows of a partition, or one, made by ``encode``; ``path`` is a folder that executors mount.

    A file is renamed into place when it is whole, so a task that runs again leaves no half file. A path in another
    file system is an error. A task holds the rows of one file, however large its partition is.
    """
    folder = mounted(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def whole(held: list[pa.RecordBatch], k: int) -> pa.RecordBatch:
            os.makedirs(folder, exist_ok=True)
            name = os.path.join(folder, f"part-{TaskContext.get().partitionId():05d}{f'-{k}' if k else ''}{suffix}")
            with open(f"{name}.{uuid.uuid4().hex}", "wb") as f:
                f.write(encode(pa.Table.from_batches(held)))
            os.replace(f.name, name)
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([sum(b.num_rows for b in held)], pa.int64())], ["file", "n"])

        held, n, k = [], 0, 0
        for batch in batches:
            while n + batch.num_rows >= most:
                yield whole([*held, batch.slice(0, most - n)], k)
                batch, held, n, k = batch.slice(most - n), [], 0, k + 1
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield whole(held, k)

    return df.mapInArrow(run, "file string, n bigint")


def las_bytes(table: pa.Table, scale: float = 0.001, extra: Sequence[str] = ()) -> bytes:
    """A LAS 1.2 file of x, y, z, intensity and classification; ``extra`` columns follow each point as 32-bit numbers.

    The extra ones are described in an extra-bytes record, as readers of labelled clouds expect.
    """
    xyz = [table[c].to_numpy() for c in "xyz"]
    low = [float(np.floor(v.min())) for v in xyz]
    note = b"".join(struct.pack("<2x2B32s4x24x24x24x24x24x32s", 5, 0, n.encode(), b"") for n in extra)
    notes = struct.pack("<H16sHH32s", 0, b"LASF_Spec", 4, len(note), b"") + note if extra else b""
    width, first = 20 + 4 * len(extra), 227 + len(notes)
    head = bytearray(227)
    head[:4], head[24], head[25] = b"LASF", 1, 2
    struct.pack_into("<HIIBHI", head, 94, 227, first, 1 if extra else 0, 0, width, table.num_rows)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *low)
    struct.pack_into("<6d", head, 179, *(f(v) for v in xyz for f in (np.max, np.min)))
    names = ["x", "y", "z", "i", "c", *extra]
    out = np.zeros(table.num_rows, np.dtype({"names": names, "formats": ["<i4"] * 3 + ["<u2", "u1"] + ["<u4"] * len(extra), "offsets": [0, 4, 8, 12, 15, *range(20, width, 4)], "itemsize": width}))
    for c, v, o in zip("xyz", xyz, low, strict=True):
        out[c] = np.round((v - o) / scale)
    out["i"], out["c"] = table["intensity"].to_numpy(), table["classification"].to_numpy()
    for n in extra:
        out[n] = table[n].to_numpy()
    return bytes(head) + notes + out.tobytes()


def label_line(ring: Column, width: Column, height: Column) -> Column:
    """A detector's label: class 0 and the ring's corners as shares of the image, six places."""
    corner = F.transform(ring, lambda p: F.concat_ws(" ", F.format_string("%.6f", p["x"] / width), F.format_string("%.6f", p["y"] / height)))
    return F.concat_ws(" ", F.lit("0"), F.array_join(corner, " "))


def colours(id: Column) -> list[Column]:
    """Red, green and blue of an id by multiplicative hashing in 32 bits."""
    h = (id * F.lit(2654435761)).bitwiseAND(0xFFFFFFFF)
    return [F.shiftright(h, s).bitwiseAND(255).cast("int").alias(n) for n, s in (("red", 0), ("green", 8), ("blue", 16))]


def highest_confidence(cells: DataFrame, by: str = "dataset_id") -> DataFrame:
    """One label a cell where predictions overlap: the most confident, ties to the smaller id."""
    best = F.max_by("tree_id", F.struct(F.col("confidence"), -F.col("tree_id")))
    return cells.groupBy(by, "row", "col").agg(best.alias("tree_id"))
