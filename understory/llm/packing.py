"""Best-fit packing with large-item matching.

What is packed is decided on the histogram of piece lengths, which has at most as many entries as a sequence has
tokens whatever the corpus: pieces above a third of the capacity are matched first, at most two to a sequence, each
with the longest partner that fits; shorter ones then go, longest first, to the smallest gap that holds them. Equal
lengths are interchangeable, so whole runs of equal sequences are filled at once and the plan stays a small table
of (length, ranks) -> (sequences, offset). Pieces then find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import base64
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F, Window
from tokenizers import Tokenizer

from .shared import cut

CAPACITY = 1024
END = 2  # id that closes each document
SPECIAL = "<|endoftext|>"
#: Fixed value: how the vocabulary's byte-level splitter cuts text.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: White space so long that the splitter of ranks, which tries shorter and shorter runs, would need too deep a stack.
LONG_SPACE = re.compile(r"(?<!\s)\s{50000}")


class Encoder:
    """Ids of whole texts by a byte-level vocabulary of the tokenizers library.

    Where ``ranks`` (the same vocabulary, one rank a token) is given, texts are encoded by them, which is some three
    times as fast and gives the same ids; the tokenizers library still reads texts with very long white space.
    """

    def __init__(self, tokenizer: str, ranks: str | None = None, pattern: str = PATTERN, special: str = SPECIAL) -> None:
        self.tokenizer, self.special, self.named, self.core = tokenizer, special, None, None
        if ranks:
            with open(ranks, "rb") as lines:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
            self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={special: len(table)})

    def encode(self, text: str) -> list[int]:
        if self.core is None or (len(text) >= 50_000 and LONG_SPACE.search(text)):
            if self.named is None:
                self.named = Tokenizer.from_file(self.tokenizer)
            return self.named.encode(text, add_special_tokens=False).ids
        return self.core.encode(text, allowed_special="all") if self.special in text else self.core.encode_ordinary(text)


_encoders: dict[tuple, Encoder] = {}


def encoder(*paths: str | None) -> Encoder:
    """This worker's encoder; it lives as long as the worker."""
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def pieces(docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): documents with their end id; only longer ones are cut.

    A cut document's pieces are full but for the first. The ids stay in the task: only lengths leave it.
    """
    source = docs.select(docs[key].alias("_key"), docs[text].alias("_text"))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, ranks).encode
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows = []
                for k, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    whole = np.array([*encode(t or ""), END], "<u4")
                    n, start = len(whole), 0
                    size = n % capacity or capacity
                    for i in range(-(-n // capacity)):
                        rows.append((k, i, start, size, zlib.crc32(whole[start : start + size].tobytes())))
                        start, size = start + size, capacity
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return source.mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, pieces a sequence, offset).

    A piece of rank r goes to sequence first + (r - first rank) // pieces, at offset + (r - first rank) % pieces * length.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    left = dict(counts)
    placed = dict.fromkeys(counts, 0)
    gaps: list[tuple[int, int, int]] = []  # (gap, first sequence, sequences), smallest gap first
    opened = 0

    def put(length: int, sequences: int, each: int, first: int, offset: int) -> None:
        n = sequences * each
        rows.append((length, placed[length], placed[length] + n, first, each, offset))
        placed[length] += n
        left[length] -= n

    large = sorted(k for k in counts if 3 * k > capacity)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        fits = bisect_left(large, capacity - a + 1) - 1
        while fits >= 0 and not left[large[fits]]:
            large.pop(fits)
            fits -= 1
        b = large[fits] if fits >= 0 else None
        if b == a:
            n = left[a] // 2
            if n:
                put(a, n, 2, opened, 0)
                insort(gaps, (capacity - 2 * a, opened, n))
            else:  # one is left over: its partner is the next shorter
                fits -= 1
                while fits >= 0 and not left[large[fits]]:
                    fits -= 1
                b, n = (large[fits], 1) if fits >= 0 else (None, 1)
                put(a, 1, 1, opened, 0)
                if b:
                    put(b, 1, 1, opened, a)
                insort(gaps, (capacity - a - (b or 0), opened, 1))
        else:
            n = min(left[a], left[b]) if b else left[a]
            put(a, n, 1, opened, 0)
            if b:
                put(b, n, 1, opened, a)
            insort(gaps, (capacity - a - (b or 0), opened, n))
        opened += n
    for length in sorted((k for k in counts if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(gaps, (length, -1, -1))
            if at == len(gaps):
                n = -(-left[length] // (capacity // length))
                gaps.append((capacity, opened, n))
                opened += n
                at = len(gaps) - 1
            gap, first, n = gaps.pop(at)
            each = gap // length
            full = min(n, left[length] // each)
            if full:
                put(length, full, each, first, capacity - gap)
                insort(gaps, (gap - each * length, first, full))
            elif left[length]:
                each = left[length]
                full = 1
                put(length, 1, each, first, capacity - gap)
                insort(gaps, (gap - each * length, first, 1))
            if n > full:
                insort(gaps, (gap, first + full, n - full))
    return rows


def pack(found: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset: sequences are gapless from 0 and hold ``capacity`` tokens at most.

    A piece's rank among pieces of its length is its place within its partition plus the counts of the partitions
    before, so equal pieces, however many, lie where their rows lie and no length is one task's window; the prefix
    sums run over one row a length and partition. ``found`` must be checkpointed: its partitions are read twice. The
    driver sees one count for each length.
    """
    spark = found.sparkSession
    held = found.withColumn("_part", F.spark_partition_id())
    sizes = held.groupBy("length", "_part").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    table = plan(counts, capacity)
    places = F.broadcast(spark.createDataFrame(table, "_l bigint, _from bigint, _to bigint, _first bigint, _each bigint, _offset bigint"))
    before = sizes.select("length", "_part", (F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).alias("_before"))
    ranked = held.mapInArrow(_numbered, ", ".join(f"{n} {k}" for n, k in [*held.dtypes, ("_i", "bigint")])).join(before, ["length", "_part"]).withColumn("_r", F.col("_i") + F.col("_before"))
    at = F.col("_r") - F.col("_from")
    return ranked.join(places, (F.col("length") == F.col("_l")) & (F.col("_r") >= F.col("_from")) & (F.col("_r") < F.col("_to"))).select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("_first") + F.floor(at / F.col("_each"))).cast("bigint").alias("sequence_id"),
        (F.col("_offset") + F.pmod(at, "_each") * F.col("length")).cast("bigint").alias("offset"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a partition with _i, the number of rows of the same length before."""
    seen = np.zeros(0, np.int64)
    for batch in batches:
        length = batch.column("length").to_numpy()
        order = np.argsort(length, kind="stable")
        kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
        seen = np.pad(seen, (0, max(0, int(kinds[-1]) + 1 - len(seen)))) if len(kinds) else seen
        place = np.empty(len(length), np.int64)
        place[order] = np.arange(len(length)) - np.repeat(first - seen[kinds], n)
        seen[kinds] += n
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(place)], [*batch.schema.names, "_i"])


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str | None = None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Every document's pieces, placed.

    A null or empty text is the end id alone; repeated rows are packed each; an empty table gives no rows. The pieces
    (a few numbers each) are checkpointed, so texts are encoded once and a lost executor costs no second pass.
    ``tokenizer`` and ``ranks``: see ``Encoder``.
    """
    return pack(cut(pieces(docs, tokenizer, ranks, key, text, capacity)), capacity)
