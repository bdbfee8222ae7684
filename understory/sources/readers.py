"""Readers: manifests, point files as text or fixed-width binary records, JSON records, file inventories."""

from __future__ import annotations

import hashlib
import os
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.checkpoint import mounted

MANIFEST = "dataset_id string, source_dataset string, collection string, official_split string, model_split string, source_las string, output string, bounds string, train_eligible string"


def manifest(spark: SparkSession, path: str, split: str | None = None, source: str | None = None, schema: str = MANIFEST, required: Sequence[str] = ("dataset_id", "model_split")) -> DataFrame:
    """A CSV manifest by header names, filtered by split and source; flags stay strings, bounds become four doubles.

    Columns that the file lacks are null; a missing required one is an error.
    """
    found = spark.read.csv(path, header=True)
    missing = [c for c in required if c not in found.columns]
    if missing:
        raise ValueError(f"manifest lacks {', '.join(missing)}")
    names = [part.strip().split(" ", 1)[0] for part in schema.split(",")]
    rows = found.select(*(F.col(n) if n in found.columns else F.lit(None).cast("string").alias(n) for n in names), *(c for c in found.columns if c not in names))
    if "bounds" in names:
        rows = rows.withColumn("bounds", F.from_json("bounds", "array<double>"))
    if split is not None:
        rows = rows.where(F.col("model_split") == split)
    return rows if source is None else rows.where(F.col("source_dataset") == source)


def points(spark: SparkSession, path: str, columns: Sequence[str] = ("x", "y", "z", "intensity", "classification"), box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Parquet points: only the named columns, finite coordinates, and within a half-open box if given.

    The box is a plain comparison, so row groups outside it are skipped by their statistics.
    """
    rows = spark.read.parquet(path).select(*columns)
    if box:
        left, bottom, right, top = box
        rows = rows.where((F.col("x") >= left) & (F.col("x") < right) & (F.col("y") >= bottom) & (F.col("y") < top))
    for c in ("x", "y", "z"):
        rows = rows.where(~F.isnan(c) & (F.abs(c) < float("inf")))
    return rows


def text_points(spark: SparkSession, path: str, names: Sequence[str], label: str | None = None) -> DataFrame:
    """White-space separated points, header lines (starting with a letter or #) skipped.

    ``label``: a pattern whose first group in the file's name becomes tree_id, for one file a tree.
    """
    lines = spark.read.text(path).withColumn("_file", F.input_file_name()).where(F.col("value").rlike(r"^\s*[-+0-9.]"))
    part = F.split(F.trim("value"), r"\s+")
    out = lines.select(*(F.try_element_at(part, F.lit(i + 1)).cast("double").alias(n) for i, n in enumerate(names)), "_file")
    return (out.withColumn("tree_id", F.regexp_extract("_file", label, 1).cast("bigint")) if label else out).drop("_file")


def ascii_cloud(spark: SparkSession, path: str) -> DataFrame:
    """An ASCII point-cloud file whose FIELDS header names its columns."""
    head = spark.read.text(path).where(F.col("value").startswith("FIELDS ")).first()
    if head is None:
        raise ValueError("no FIELDS header")
    return text_points(spark, path, head["value"].split()[1:])


def binary_points(spark: SparkSession, path: str, layout: str = "<3d2Id", names: Sequence[str] = ("x", "y", "z", "a", "b", "t")) -> DataFrame:
    """Fixed-width binary records; bytes after the last whole record are ignored. One file is one task's batches."""
    width = struct.calcsize(layout)
    kinds = [c for n, c in _fields(layout) for _ in range(n)]
    dtype = np.dtype([(n, "<" + {"d": "f8", "I": "u4", "f": "f4", "i": "i4"}[k]) for n, k in zip(names, kinds, strict=True)])
    schema = ", ".join(f"{n} {'double' if k in 'df' else 'bigint'}" for n, k in zip(names, kinds, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_buffer()
                rows = np.frombuffer(raw, dtype, len(raw) // width)
                for at in range(0, len(rows), 100_000):
                    part = rows[at : at + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part[n].astype("f8" if k in "df" else "i8")) for n, k in zip(names, kinds, strict=True)], list(names))

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


def _fields(layout: str) -> list[tuple[int, str]]:
    out, number = [], ""
    for c in layout.lstrip("<"):
        if c.isdigit():
            number += c
        else:
            out.append((int(number or 1), c))
            number = ""
    return out


def records(spark: SparkSession, glob: str, schema: str | None = None) -> DataFrame:
    """JSON records, one document a file."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(glob)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256) of files, read piece by piece where the folder is mounted; elsewhere whole, up to 2 GB each."""
    files = spark.read.format("binaryFile").load(path)
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]*:", path) or not files.where(~F.col("path").rlike("^(file:|/)")).isEmpty():
        return files.select("path", "length", F.sha2("content", 256).alias("sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for name in batch.column(0).to_pylist():
                with open(mounted(name), "rb") as f:
                    sums.append(hashlib.file_digest(f, "sha256").hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.string())], ["path", "length", "sha256"])

    return files.select("path", "length").mapInArrow(run, "path string, length bigint, sha256 string")


def same_stems(spark: SparkSession, left: str, right: str, pattern: str = r"([^/]+?)(?:\.[^./]*)?$", only: Sequence[str] | None = None) -> DataFrame:
    """(stem, status) of two folders' files paired by name without extension, or by the first group of ``pattern``.

    ``only``: names that are asked for; others are left out. Only file names are read.
    """
    from ..operators.governance import paired

    def files(path: str) -> DataFrame:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.regexp_extract("path", pattern, 1).alias("stem")).distinct()
        return found.where(F.col("stem").isin(*only)) if only is not None else found

    return paired(files(left), files(right), "stem")


def all_paired(pairs: DataFrame) -> DataFrame:
    """The stems of both sides; a stem that one side lacks is an error that names some."""
    lone = [r["stem"] for r in pairs.where("status <> 'both'").orderBy("stem").limit(5).collect()]
    if lone:
        raise ValueError(f"without a partner: {', '.join(lone)}")
    return pairs.select("stem")


def sources_of(manifest_: DataFrame, files: DataFrame, splits: Sequence[str], key: str = "dataset_id", file: str = "source_las") -> DataFrame:
    """(dataset_id, problem) of a manifest's rows: a split that is not expected, an id given twice, a file that is missing."""
    rows = manifest_.select(F.col(key).alias("dataset_id"), "model_split", F.col(file).alias("_file"))
    split = rows.where(~F.coalesce(F.col("model_split").isin(*splits), F.lit(False))).select("dataset_id", F.lit("unexpected split").alias("problem"))
    twice = rows.groupBy("dataset_id").agg(F.count("*").alias("n")).where("n > 1").select("dataset_id", F.lit("ambiguous id").alias("problem"))
    missing = rows.join(files.select(F.col(files.columns[0]).alias("_file")), "_file", "left_anti").select("dataset_id", F.lit("missing file").alias("problem"))
    return split.union(twice).union(missing).distinct()


def wkb_rings(content: Column) -> Column:
    """Rings (arrays of struct(x, y)) of a little-endian WKB polygon, read with byte arithmetic in the JVM."""
    text = F.hex(content)

    def number(at: Column, bytes_: int) -> Column:
        pairs = F.transform(F.sequence(F.lit(bytes_ - 1), F.lit(0)), lambda i: F.substring(text, (at + i) * 2 + 1, F.lit(2)))
        return F.array_join(pairs, "")

    def integer(at: Column) -> Column:
        return F.conv(number(at, 4), 16, 10).cast("int")

    def double(at: Column) -> Column:
        # sign, exponent and fraction of the IEEE 754 layout
        digits = number(at, 8)
        head = F.conv(F.substring(digits, 1, 3), 16, 10).cast("int")
        fraction = F.conv(F.substring(digits, 4, 13), 16, 10).cast("bigint") / F.lit(float(1 << 52))
        power = head.bitwiseAND(2047)
        value = F.when(power == 0, fraction * F.lit(2.0**-1022)).otherwise((1 + fraction) * F.pow(F.lit(2.0), power - 1023))
        return F.when(head >= 2048, -value).otherwise(value)

    def ring(at: Column, n: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(double(at + 16 * i).alias("x"), double(at + 16 * i + 8).alias("y")))

    start = F.struct(F.lit(9).alias("at"), F.array().cast("array<struct<at:int,n:int>>").alias("rings"))
    places = F.aggregate(F.sequence(F.lit(1), integer(F.lit(5))), start, lambda s, _: F.struct((s["at"] + 4 + 16 * integer(s["at"])).alias("at"), F.array_append(s["rings"], F.struct((s["at"] + 4).alias("at"), integer(s["at"]).alias("n"))).alias("rings")))
    return F.transform(places["rings"], lambda r: ring(r["at"], r["n"]))


def shards(spark: SparkSession, paths: Sequence[str], key: str = "pid") -> DataFrame:
    """Union of shards by name; a key that two shards give is an error."""
    out = spark.read.option("mergeSchema", True).parquet(*paths)
    twice = out.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    if twice:
        raise ValueError(f"{key} occurs in more than one shard")
    return out


def las_header(raw: bytes) -> dict:
    """What the public header of an uncompressed LAS file says of its records, scales and bounds."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    kind = raw[104]
    if kind & 0x80:
        raise ValueError("compressed points: decompress the file first")
    count = struct.unpack_from("<I", raw, 107)[0]
    if raw[25] >= 4 and not count:
        count = struct.unpack_from("<Q", raw, 247)[0]
    high_low = struct.unpack_from("<6d", raw, 179)
    return {
        "first": struct.unpack_from("<I", raw, 96)[0], "kind": kind, "width": struct.unpack_from("<H", raw, 105)[0], "count": count,
        "scale": struct.unpack_from("<3d", raw, 131), "offset": struct.unpack_from("<3d", raw, 155), "high": high_low[::2], "low": high_low[1::2],
    }


def las_points(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """(file, x, y, z, intensity, classification) of LAS files; those whose header lies outside the half-open box are not decoded.

    For any store that Spark reads: a file of up to 2 GB is one task's batches of 100,000 points. ``las_ranges`` has no such bound.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = data.as_buffer()
                h = las_header(bytes(raw[:375]))
                if not las_outside(h, box):
                    rows = np.frombuffer(raw, las_layout(h), h["count"], h["first"])
                    for start in range(0, len(rows), 100_000):
                        yield las_batch(name, rows[start : start + 100_000], h, box)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file string, x double, y double, z double, intensity int, classification int")


class LasSource(DataSource):
    """Format ``las``: uncompressed LAS files on a folder that driver and executors mount, by ranges of points.

    Options: ``box`` ("left bottom right top", half-open) and ``points`` (of a range). Only headers are read to plan:
    files outside the box give no task, and a file of any size is read in ranges of bounded memory.
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return "file string, x double, y double, z double, intensity int, classification int"

    def reader(self, schema) -> DataSourceReader:
        return LasReader(self.options)


class LasReader(DataSourceReader):
    def __init__(self, options) -> None:
        path = mounted(options["path"])
        self.files = sorted(os.path.join(path, f) for f in os.listdir(path) if f.endswith(".las")) if os.path.isdir(path) else [path]
        self.box = tuple(map(float, options["box"].split())) if options.get("box") else None
        self.step = int(options.get("points", 1_000_000))

    def partitions(self) -> list[InputPartition]:
        out = []
        for name in self.files:
            with open(name, "rb") as f:
                head = las_header(f.read(375))
            if not las_outside(head, self.box):
                out += [InputPartition((name, head, at, min(self.step, head["count"] - at))) for at in range(0, head["count"], self.step)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, head, at, n = partition.value
        with open(name, "rb") as f:
            f.seek(head["first"] + at * head["width"])
            for start in range(0, n, 100_000):
                k = min(100_000, n - start)
                yield las_batch(name, np.frombuffer(f.read(k * head["width"]), las_layout(head), k), head, self.box)


def las_outside(head: dict, box: tuple | None) -> bool:
    """Whether a file's bounds do not meet the half-open box."""
    return bool(box) and (head["low"][0] >= box[2] or head["high"][0] < box[0] or head["low"][1] >= box[3] or head["high"][1] < box[1])


def las_layout(head: dict) -> np.dtype:
    return np.dtype({"names": ["x", "y", "z", "i", "c"], "formats": ["<i4", "<i4", "<i4", "<u2", "u1"], "offsets": [0, 4, 8, 12, 16 if head["kind"] > 5 else 15], "itemsize": head["width"]})


def las_batch(name: str, part: np.ndarray, head: dict, box: tuple | None) -> pa.RecordBatch:
    """Points of a file as columns, those in the half-open box only."""
    xyz = [part[c] * s + o for c, s, o in zip("xyz", head["scale"], head["offset"], strict=True)]
    keep = np.ones(len(part), bool) if not box else (xyz[0] >= box[0]) & (xyz[0] < box[2]) & (xyz[1] >= box[1]) & (xyz[1] < box[3])
    label = part["c"] & (255 if head["kind"] > 5 else 31)
    columns = [pa.array([name] * int(keep.sum()), pa.string()), *(pa.array(v[keep]) for v in xyz), pa.array(part["i"][keep].astype("i4")), pa.array(label[keep].astype("i4"))]
    return pa.RecordBatch.from_arrays(columns, ["file", "x", "y", "z", "intensity", "classification"])


def las_ranges(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, points: int = 1_000_000) -> DataFrame:
    """(file, x, y, z, intensity, classification) of LAS files in a mounted folder, by ranges of points; see ``LasSource``."""
    spark.dataSource.register(LasSource)
    reader = spark.read.format("las").option("points", points)
    return (reader.option("box", " ".join(map(repr, map(float, box)))) if box else reader).load(path)


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """Vertices of a little-endian or ASCII PLY file whose vertex properties are scalars, all as doubles."""
    head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096).alias("h")).first()
    if head is None:
        raise ValueError("no PLY file")
    names, kinds, _, _ = _ply_header(bytes(head["h"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                raw = data.as_py()
                own, kind, count, first = _ply_header(raw[:4096])
                if raw[:64].find(b"format ascii") >= 0:
                    table = np.array([line.split()[: len(own)] for line in raw[first:].split(b"\n", count)[:count]], float)
                    columns = list(table.T)
                else:
                    rows = np.frombuffer(raw, np.dtype(list(zip(own, kind, strict=True))), count, first)
                    columns = [rows[n].astype(float) for n in own]
                for at in range(0, count, 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[at : at + 100_000]) for c in columns], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ", ".join(f"`{n}` double" for n in names))


def _ply_header(raw: bytes) -> tuple[list[str], list[str], int, int]:
    sizes = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "float32": "<f4", "float64": "<f8", "int32": "<i4", "uint8": "u1"}
    end = raw.index(b"end_header\n") + len(b"end_header\n")
    names, kinds, count, inside = [], [], 0, False
    for line in raw[:end].decode("ascii").splitlines():
        word = line.split()
        if word[:1] == ["element"]:
            inside = word[1] == "vertex"
            count = int(word[2]) if inside else count
        elif word[:1] == ["property"] and inside:
            names.append(word[2])
            kinds.append(sizes[word[1]])
    return names, kinds, count, end
