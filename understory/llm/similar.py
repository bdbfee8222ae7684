"""Near-duplicate documents: MinHash bands propose pairs, the exact Jaccard similarity of their shingles decides.

A pair at the similarity shares one of 16 bands of four rows with a chance of 1 - (1 - 0.8^4)^16 = 0.9998.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from .passages import MULTIPLIER, _mix, _shingle_hashes, _word_hashes, met_classes
from .shared import cut, map_texts


@dataclass(frozen=True)
class Near:
    similarity: float = 0.8
    width: int = 5  # words of a shingle
    rows: int = 4
    bands: int = 16
    group: int = 256  # documents compared together
    sent: int = 500_000  # candidate classes up to so many are broadcast (8 bytes each)


def shingles(text: str, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; a text of fewer words is one shingle."""
    return np.unique(_shingle_hashes(_word_hashes(text.encode("utf-8", "surrogatepass").lower().split()), width))


def similar_texts(docs: DataFrame, text: str = "text", how: Near = Near()) -> DataFrame:
    """(node, root): components of similar texts by the hash of the text, a null text's being that of an empty one.

    Texts without a word are all alike, and like no other; repeated rows are one text; an empty table has no row.
    """
    salts = _mix(np.arange(1, how.rows * how.bands + 1, dtype=np.uint64) * MULTIPLIER)
    power = _mix(np.arange(101, 101 + how.rows, dtype=np.uint64) * MULTIPLIER) | np.uint64(1)

    def run(keys: list, texts: list) -> dict[str, list]:
        out = []
        for t in texts:
            s = shingles(t, how.width)
            least = np.array([_mix(s ^ x).min() for x in salts], np.uint64).reshape(how.bands, how.rows)
            out.append(_mix((least * power).sum(1, dtype=np.uint64) + salts[: how.bands]).view(np.int64))
        return {"class": keys, "keys": out}

    lines = docs.select(F.coalesce(text, F.lit("")).alias("line")).select(F.xxhash64("line").alias("class"), "line")
    keyed = cut(map_texts(lines, "class", "line", "class bigint, keys array<bigint>", run))
    edges = met_classes(keyed, lines, how, lambda line: shingles(line, how.width), lambda group: _linked(group, how))
    return components(edges, "a", "b")


def _linked(group: list[tuple[int, np.ndarray]], how: Near) -> pa.RecordBatch:
    """Edges that join all similar sets; a pair that is joined already is not compared."""
    root = list(range(len(group)))
    size = [len(s) for _, s in group]
    edges = []
    for j, (c, s) in enumerate(group):
        for i in range(j):
            if root[i] == root[j] or min(size[i], size[j]) < how.similarity * max(size[i], size[j]):
                continue
            n = size[i] + size[j] - len(np.union1d(group[i][1], s))
            if n >= how.similarity * (size[i] + size[j] - n):
                edges.append((group[i][0], c))
                old, new = root[j], root[i]
                root = [new if r == old else r for r in root[: j + 1]] + root[j + 1 :]
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])
