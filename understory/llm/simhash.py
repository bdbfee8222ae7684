"""SimHash near-duplicates: Golay-code fuzzy keys find fingerprints that differ in two bits at most.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits. Two errors leave at least one segment whole
(pigeonhole), and the next segment then holds two errors at most. That one is read as a word of the perfect
(23, 12) Golay code: the words at distance one from it, and itself, are decoded to codewords. Words two bits apart
have a common word at distance one from both and so share a codeword. A key is the whole segment with a codeword of
the next one: every pair in reach shares a key, and equal keys are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, Window

from ..operators.graph import components
from .shared import apart, cut, map_texts, together
from .similar import similar_texts

SEGMENTS = ((42, 22), (21, 21), (0, 21))  # shift, bits
GENERATOR = 0b101011100011  # of the cyclic (23, 12) Golay code
REACH = 2


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; zero for a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    whole = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(whole, seed)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - width + 1].tolist()
    digest = xxhash.xxh64_intdigest
    n = len(starts)
    h = np.fromiter((digest(whole[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist(), strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        ones += np.unpackbits(h[at : at + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int((np.uint64(1) << np.flatnonzero(2 * ones > n).astype(np.uint64)).sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; fp is the fingerprint's bits as a signed long."""

    def run(keys: list, texts: list) -> dict[str, list]:
        return {"doc_id": keys, "fp": np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, key, text, "doc_id bigint, fp bigint", run)


@lru_cache(1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the 23 unit words, and the error word of each syndrome."""

    def rest(word: int) -> int:
        for bit in range(22, 10, -1):
            if word >> bit & 1:
                word ^= GENERATOR << (bit - 11)
        return word

    unit = np.array([rest(1 << b) for b in range(23)], np.int64)
    error = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for bits in combinations(range(23), weight):
            error[np.bitwise_xor.reduce(unit[list(bits)])] = sum(1 << b for b in bits)
    return unit, error


def nearby_codewords(words: np.ndarray, bits: int) -> np.ndarray:
    """Indices (12 bits) of the codewords nearest to each word and to its neighbours; a row of 1 + bits each."""
    unit, error = _golay()
    syndrome = np.zeros(len(words), np.int64)
    for b in range(bits):
        syndrome ^= np.where(words >> b & 1, unit[b], 0)
    out = np.empty((len(words), bits + 1), np.int64)
    for b in range(-1, bits):
        flip, by = (1 << b, unit[b]) if b >= 0 else (0, 0)
        out[:, b + 1] = ((words ^ flip) ^ error[syndrome ^ by]) >> 11
    return out


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in fps, key): the distinct keys of each fingerprint."""
    bits = fps.view(np.uint64)
    part = [((bits >> np.uint64(s)) & np.uint64((1 << n) - 1)).astype(np.int64) for s, n in SEGMENTS]
    at, keys = [], []
    for i in range(3):
        j = (i + 1) % 3
        code = np.sort(nearby_codewords(part[j], SEGMENTS[j][1]), axis=1)
        new = np.ones(code.shape, bool)
        new[:, 1:] = code[:, 1:] != code[:, :-1]
        row, col = np.nonzero(new)
        at.append(row)
        keys.append(i << 34 | part[i][row] << 12 | code[row, col])
    return np.concatenate(at), np.concatenate(keys)


def linked(fps: DataFrame, bucket: int = 256) -> DataFrame:
    """Edges (a, b) that join all fingerprints within reach of each other, not every pair; ``fps``: distinct fp.

    Buckets of up to ``bucket`` fingerprints are compared whole in memory. Fingerprints of a larger bucket meet in
    the words at distance one from both, which every pair in reach has and which at most 65 fingerprints share: as
    exact, and linear in the bucket.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 8192):
                fp = batch.column(0).slice(start, 8192).to_numpy()
                at, key = fuzzy_keys(fp)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp[at])], ["key", "fp"])

    keys = fps.mapInArrow(emit, "key bigint, fp bigint")
    shared = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    held = cut(keys.join(shared, "key"))
    near = held.where(F.col("n") <= bucket).repartition("key").sortWithinPartitions("key").select("key", "fp").mapInArrow(_stars, "a bigint, b bigint")
    hot = held.where(F.col("n") > bucket).select("fp").distinct()
    around = F.concat(F.array(F.lit(0).cast("bigint")), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.call_function("shiftleft", F.lit(1).cast("bigint"), b)))
    mid = hot.select("fp", F.explode(around).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("z"))
    far = mid.select("fp", F.min("fp").over(Window.partitionBy("z")).alias("m")).where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))
    return near.union(far)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of key: within each key, an edge from each fingerprint to the first it is linked with."""
    key, fp = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy()])
        if not len(key):
            continue
        open_from = int(np.searchsorted(key, key[-1]))  # the last key may go on in the next batch
        yield _edges(key[:open_from], fp[:open_from])
        key, fp = key[open_from:], fp[open_from:]
    yield _edges(key, fp)


def _edges(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    a, b = [fp[:0]], [fp[:0]]
    cuts = np.flatnonzero(np.diff(key)) + 1
    for group in np.split(fp, cuts) if len(key) else []:
        near = np.bitwise_count((group[:, None] ^ group[None, :]).view(np.uint64)) <= REACH
        label = np.arange(len(group))
        while True:
            low = np.where(near, label[None, :], len(group)).min(1)
            if (low == label).all():
                break
            label = low
        moved = label != np.arange(len(group))
        a.append(group[moved])
        b.append(group[label[moved]])
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp, root, component_id) of every row: component_id is the smallest doc_id reachable over links.

    Equal fingerprints are one class before any search, so exact copies cost nothing more. Null and empty texts have
    fingerprint zero and are linked like any other; repeated rows fall into one class; an empty table gives none.
    ``root`` names the component where ids are repeated. Null ids stay and count only if a component has no other.
    """
    prints = cut(fingerprints(docs, key, text))
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = components(linked(classes.select("fp")), "a", "b")
    placed = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return prints.join(placed.select("fp", "root").join(ids, "root"), "fp").select("doc_id", "fp", "root", "component_id")


def near_texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(node, root): components of texts by their hash, linked by fingerprints within reach or by similarity of shingles.

    Texts of one fingerprint hang on the least of them, and that one stands for the fingerprint in the links. A null
    text is as an empty one; texts without a word have fingerprint zero, like those of ``similar_texts``.
    """
    lines = docs.select(F.coalesce(text, F.lit("")).alias("line")).select(F.xxhash64("line").alias("class"), "line")
    prints = cut(fingerprints(lines, "class", "line").select(F.col("doc_id").alias("class"), "fp").distinct())
    least = cut(prints.groupBy("fp").agg(F.min("class").alias("least")))
    same = prints.join(least, "fp").where("class <> least").select(F.col("class").alias("a"), F.col("least").alias("b"))
    end = lambda k: least.select(F.col("fp").alias(k), F.col("least").alias(f"_{k}"))
    within = linked(least.select("fp")).join(end("a"), "a").join(end("b"), "b").select(F.col("_a").alias("a"), F.col("_b").alias("b"))
    alike = similar_texts(docs, text).select(F.col("node").alias("a"), F.col("root").alias("b"))
    return components(same.union(within).union(alike), "a", "b")


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id, with all its columns.

    Near copies are texts whose fingerprints differ in two bits at most, or whose shingles are similar (``similar``).

    Rows go by id and text, so a repeated or null id does not join or drop rows of different groups; a null id stays
    only where its group has no other. The texts are shuffled once, to meet the rows that stay.
    """
    columns, docs = docs.columns, apart(docs, "doc_id", "text")
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    counts = docs.select("doc_id", row.alias("class")).groupBy("class", "doc_id").agg(F.count("*").alias("n"))
    least = lambda *more: F.min(F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", *more))
    classes = counts.groupBy("class").agg(least("n").alias("_f")).select("class", "_f.doc_id", "_f.n")
    placed = classes.join(near_texts(docs), classes["class"] == F.col("node"), "left").withColumn("root", F.coalesce("root", "class"))
    stays = cut(placed.groupBy("root").agg(least("class", "n").alias("_f")).select(F.col("_f.doc_id").alias("_id"), F.col("_f.class").alias("_class"), F.col("_f.n").alias("_count")))
    met = F.col("doc_id").eqNullSafe(F.col("_id")) & (row == F.col("_class"))
    once = docs.join(stays.where("_count = 1").hint("shuffle_hash"), met, "left_semi")
    again = stays.where("_count > 1")
    if again.isEmpty():
        return together(once, columns, "doc_id", "text")
    more = docs.join(again.hint("shuffle_hash"), met, "left_semi")
    return together(once.union(more.withColumn("_row", row).dropDuplicates(["doc_id", "_row"]).drop("_row")), columns, "doc_id", "text")
