"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.checkpoint import cut


__all__ = ["apart", "cut", "map_texts", "table", "together"]
OTHERS = "_others"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def apart(docs: DataFrame, *own: str) -> DataFrame:
    """``docs`` with its columns ``own`` as they are and all others in one struct, where no name of theirs can clash."""
    others = [docs[_quoted(c)].alias(c) for c in docs.columns if c not in own]
    return docs.select(*own, F.struct(*others).alias(OTHERS) if others else F.lit(None).alias(OTHERS))


def together(parts: DataFrame, columns: list[str], *own: str) -> DataFrame:
    """``columns`` in their order: ``own`` as they are, the others from where ``apart`` put them."""
    return parts.select(*(F.col(c) if c in own else F.col(OTHERS)[c].alias(c) for c in columns))


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def map_texts(df: DataFrame, key: str, text: str, schema: str, fn: Callable[[list, list], dict[str, list]], pack: int = 256) -> DataFrame:
    """Run ``fn(keys, texts)`` over small packs of rows of each Arrow batch, without any shuffle.

    ``fn`` returns its output columns by name, in the order of ``schema``; it may return any number of rows.
    Packs keep what Python holds at once small however long the texts are.
    """
    source = df.select(df[key].alias("_key"), df[text].alias("_text"))
    arrow = _arrow_schema(df.sparkSession, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, pack):
                part = batch.slice(at, pack)
                out = fn(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return source.mapInArrow(run, schema)


def _arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.strip().split(" ", 1) for part in schema.split(","))])
