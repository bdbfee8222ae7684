"""Repeated passages: paragraph MinHash banding, verified by Jaccard, and exact blocks for passages inside paragraphs.

Lines of enough words are paragraphs. Each has MinHash bands of two rows over five-word shingles, as many as the wanted
recall needs; colliding paragraphs are verified by exact Jaccard similarity of their shingle sets.

A passage pasted into the middle of a paragraph leaves both paragraphs unlike. So texts are also cut where the hash
of two neighbouring words is the least around: the same passage has the same cuts wherever it stands, and its blocks
recur word for word. A run of blocks that other documents have too is a repeated passage.

Paragraphs that are linked form clusters; all but the first member of each are to be removed. Of a passage's blocks the
first place stays and stretches of later ones are to be removed, so that chance blocks link no two passages.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, functions as F

from ..operators.graph import components
from .shared import cut, map_texts

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Passages:
    similarity: float = 0.8
    width: int = 5  # words of a shingle
    recall: float = 0.99  # of the bands, at the similarity
    rows: int = 2  # of a band: at one, a shingle that many texts have would be a band of all of them
    paragraph_words: int = 20  # shorter lines recur by chance
    around: int = 4  # words to each side that a cut is the least of
    block_words: int = 5
    run_words: int = 18  # words that a run's blocks have at least; 99 of 100 passages of 51 words have them
    gap_words: int = 12  # between blocks of a run
    group: int = 512  # paragraphs compared together
    sent: int = 500_000  # candidate classes up to so many are broadcast (8 bytes each)

    @property
    def bands(self) -> int:
        return math.ceil(math.log(1 - self.recall) / math.log(1 - self.similarity**self.rows))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in words), np.uint64, len(words))


def _shingle_hashes(word: np.ndarray, width: int) -> np.ndarray:
    n = max(1, len(word) - width + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(width, len(word))):
        out = _mix(out + word[k : k + n])
    return out


def _row(text: str, twice: bool) -> int:
    """What tells rows of equal id apart: a hash of the text where ids repeat, else nothing."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))).astype(np.int64)) if twice else 0


def paragraph_rows(docs: DataFrame, how: Passages, twice: bool = False) -> DataFrame:
    """(doc_id, row, line, start, words, class, keys): paragraphs with the words before them, a hash of the line and its bands."""
    salts = _mix(np.arange(1, how.bands * how.rows + 1, dtype=np.uint64) * MULTIPLIER)

    def run(keys: list, texts: list) -> dict[str, list]:
        out: dict[str, list] = {n: [] for n in ("doc_id", "row", "line", "start", "words", "class", "keys")}
        for key, text in zip(keys, texts, strict=True):
            lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
            words: list[bytes] = []
            kept = []  # line, start, words
            for i, line in enumerate(lines):
                own = line.lower().split()
                if len(own) >= how.paragraph_words:
                    kept.append((i, len(words), len(own)))
                words += own
            if not kept:
                continue
            shingles = _shingle_hashes(_word_hashes(words), how.width)
            ends = np.array([(a, a + n - how.width + 1) for _, a, n in kept]).ravel()  # of the shingles within each line
            least = np.stack([np.minimum.reduceat(np.append(_mix(shingles ^ s), s), ends)[::2] ^ s for s in salts]).reshape(how.bands, how.rows, -1)
            bands = least[:, 0]
            for k in range(1, how.rows):
                bands = _mix(bands + least[:, k])
            out["doc_id"] += [key] * len(kept)
            out["row"] += [_row(text, twice)] * len(kept)
            out["line"] += [i for i, _, _ in kept]
            out["start"] += [a for _, a, _ in kept]
            out["words"] += [n for _, _, n in kept]
            out["class"] += [np.uint64(xxhash.xxh64_intdigest(lines[i], 42)).astype(np.int64) for i, _, _ in kept]
            out["keys"] += list(bands.T.copy().view(np.int64))
        return out

    return map_texts(docs, "doc_id", "text", "doc_id bigint, row bigint, line int, start int, words int, class bigint, keys array<bigint>", run)


def block_rows(docs: DataFrame, how: Passages, twice: bool = False) -> DataFrame:
    """(doc_id, row, start, words, class): the blocks of every text; class is a hash of the block's words."""

    def run(keys: list, texts: list) -> dict[str, list]:
        out = []
        for key, text in zip(keys, texts, strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").lower().split()
            if len(words) < 2 * how.around + how.block_words:
                continue
            h = _word_hashes(words)
            rank = _mix(h[:-1] + (h[1:] ^ MULTIPLIER))
            least = sliding_window_view(rank, 2 * how.around + 1).min(1)
            at = np.flatnonzero(rank[how.around : len(rank) - how.around] == least) + how.around
            a, b = at[:-1], at[1:]
            long = b - a >= how.block_words
            a, b = a[long], b[long]
            power = np.cumprod(np.full(len(h), MULTIPLIER))  # a block's hash is its words' hashes as digits, whatever stands before
            total = np.concatenate(([np.uint64(0)], np.cumsum(h * power)))
            inverse = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))
            back = np.cumprod(np.full(len(h), inverse))
            out.append((np.full(len(a), key), np.full(len(a), _row(text, twice)), a, b - a, _mix((total[b] - total[a]) * back[a]).view(np.int64)))
        names = ("doc_id", "row", "start", "words", "class")
        return {n: np.concatenate(c) if out else [] for n, c in zip(names, zip(*out, strict=True) if out else ([],) * 5, strict=True)}

    return map_texts(docs, "doc_id", "text", "doc_id bigint, row bigint, start int, words int, class bigint", run)


def similar_classes(docs: DataFrame, paragraphs: DataFrame, how: Passages) -> DataFrame:
    """Edges (a, b) between classes of different lines whose shingle sets are similar enough."""
    lines = docs.select(F.explode(F.split("text", "\n")).alias("line")).select(F.xxhash64("line").alias("class"), "line")
    return met_classes(paragraphs, lines, how, lambda line: line, lambda group: _similar(group, how))


def met_classes(keyed: DataFrame, lines: DataFrame, how, read: Callable, judge: Callable) -> DataFrame:
    """Edges (a, b) that ``judge`` finds among classes that share one of their ``keys``; ``lines``: class, line.

    Groups of a band are compared whole; larger ones chunk against chunk, so that no task holds more than two chunks
    and no link is lost. A task gives edges that join what it found similar, not every pair. It holds each line as
    ``read`` makes it.
    """
    keys = keyed.select("class", F.explode("keys").alias("key")).distinct()
    sets = keys.groupBy("key").agg(F.count("*").alias("n"), F.min("class").alias("low"), F.max("class").alias("high"), F.bit_xor(F.xxhash64("class")).alias("mark")).where("n > 1")
    # near copies meet in most of their bands: of bands that hold the same classes one is compared
    shared = sets.groupBy("n", "low", "high", "mark").agg(F.min("key").alias("key")).select("key", F.ceil(F.col("n") / how.group).cast("bigint").alias("chunks"))
    met = cut(keys.join(shared, "key"))
    wanted = met.select("class").distinct()
    if wanted.count() <= how.sent:
        wanted = F.broadcast(wanted)
    texts = lines.join(wanted, "class").groupBy("class").agg(F.min("line").alias("line"))
    mine = F.pmod(F.xxhash64("class"), F.col("chunks"))
    pairs = met.withColumn("_x", mine).withColumn("_y", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    tasks = pairs.select("class", "key", F.least("_x", "_y").alias("i"), F.greatest("_x", "_y").alias("j"))
    held = tasks.join(texts, "class").withColumn("task", F.xxhash64("key", "i", "j"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, group = None, []
        for batch in batches:
            for t, c, line in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if t != task and group:
                    yield judge(group)
                    group = []
                task = t
                group.append((c, read(line)))
        yield judge(group)

    return held.select("task", "class", "line").repartition("task").sortWithinPartitions("task", "class").mapInArrow(compare, "a bigint, b bigint").distinct()


def shingle_set(line: str, width: int) -> frozenset:
    words = line.encode("utf-8", "surrogatepass").lower().split()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def _similar(group: list[tuple[int, str]], how: Passages) -> pa.RecordBatch:
    sets = [shingle_set(line, how.width) for _, line in group]
    where: dict[tuple, list[int]] = {}
    root = list(range(len(group)))
    for j, s in enumerate(sets):
        both: dict[int, int] = {}
        for x in s:
            for i in where.setdefault(x, []):
                both[i] = both.get(i, 0) + 1
            where[x].append(j)
        for i, n in both.items():
            if n >= how.similarity * (len(s) + len(sets[i]) - n):
                a, b = i, j
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
    edges = [(group[i][0], group[r][0]) for i, r in enumerate(root) if r != i]
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in edges], pa.int64()) for k in (0, 1)], ["a", "b"])


def repeated_runs(blocks: DataFrame, how: Passages) -> DataFrame:
    """(doc_id, start, stop, cluster_id, removed): spans of blocks that at least two documents have.

    The first place of a block, by (doc_id, start), always stays: only stretches of later places that are passages by
    themselves are removed, so text that meets elsewhere text of its own cluster is not lost with it.
    """
    place = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "row", "start"))
    many = blocks.groupBy("class").agg(F.min(place).alias("_f"), F.max(place).alias("_b")).where("_f.doc_id <> _b.doc_id OR _f.row <> _b.row")
    first = many.select("class", F.col("_f.doc_id").alias("origin"), F.col("_f.row").alias("_o"), F.col("_f.start").alias("_s"))
    own = F.col("doc_id").eqNullSafe(F.col("origin")) & (F.col("row") == F.col("_o")) & (F.col("start") == F.col("_s"))
    hit = blocks.join(first, "class").select("doc_id", "row", "start", "words", "class", "origin", own.alias("first"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("doc_id", "start", "stop", "cluster_id", "removed")
        types = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_())
        doc, held = None, []

        def table(out: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], names)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:2] != doc:
                    out += _spans(doc[0], held, how)
                    held = []
                doc = row[:2]
                if not held or held[-1] != row[2:]:  # repeated rows
                    held.append(row[2:])
            yield table(out)
        yield table(_spans(doc[0] if doc else None, held, how))

    return hit.repartition("doc_id", "row").sortWithinPartitions("doc_id", "row", "start", "class").mapInArrow(judge, "doc_id bigint, start int, stop int, cluster_id bigint, removed boolean")


def passages_of(blocks: list[tuple], how: Passages) -> list[tuple[int, int]]:
    """Index ranges of (start, words, ...) that are passages; a run with too few words in blocks is cut at its widest gaps."""
    gap = [0, *(b[0] - a[0] - a[1] for a, b in zip(blocks, blocks[1:]))]
    out, todo = [], [(0, len(blocks), how.gap_words)]
    while todo:
        low, high, limit = todo.pop()
        cuts = [low, *(k for k in range(low + 1, high) if gap[k] > limit), high]
        for i, j in zip(cuts, cuts[1:]):
            n = sum(b[1] for b in blocks[i:j])
            if n < how.run_words:
                continue
            if n >= how.similarity * (max(b[0] + b[1] for b in blocks[i:j]) - blocks[i][0]):
                out.append((i, j))
            else:
                todo.append((i, j, max(gap[i + 1 : j]) - 1))
    return sorted(out)


def _spans(doc: int | None, blocks: list[tuple], how: Passages) -> list[tuple]:
    """Rows of one document: its repeated passages, divided into what stays and what other places have before."""
    out = []

    def add(part: list[tuple], removed: bool) -> None:
        origin: dict = {}
        for _, n, _, o, _ in part:
            origin[o] = origin.get(o, 0) + n
        least = min(origin, key=lambda o: (-origin[o], o)) if removed else doc
        out.append((doc, part[0][0], max(b[0] + b[1] for b in part), least, removed))

    for low, high in passages_of(blocks, how):
        part, at = blocks[low:high], 0
        gone, i = [], 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[j][4] == part[i][4]:
                j += 1
            if not part[i][4]:
                gone += [(i + a, i + b) for a, b in passages_of(part[i:j], how)]
            i = j
        for a, b in [*gone, (len(part), len(part))]:
            if sum(x[1] for x in part[at:a]) >= how.run_words:
                add(part[at:a], False)
            if a < b:
                add(part[a:b], True)
            at = b
    return out


def repeated(docs: DataFrame, how: Passages = Passages()) -> DataFrame:
    """(doc_id, start, stop, kind, cluster_id, removed), a row for each repeated paragraph or passage.

    start and stop count words. cluster_id of a paragraph is the smallest doc_id of its cluster; the first member (by
    doc_id, start) stays, all others are removed. Of a removed passage it is the document that has most of it first, of
    one that stays its own. Clusters within one document count for paragraphs, not for passages. Documents
    without repeats give no rows, so null, empty and short texts give none; exact copies give all their paragraphs.
    Rows that repeat an id with another text are documents of their own, those that repeat both are one.
    """
    docs = docs.select("doc_id", "text").where("text is not null")
    twice = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    paragraphs = cut(paragraph_rows(docs, how, twice))
    roots = components(similar_classes(docs, paragraphs, how), "a", "b")
    lines = paragraphs.join(roots, paragraphs["class"] == roots["node"], "left").select("doc_id", "row", "start", (F.col("start") + F.col("words")).alias("stop"), F.coalesce("root", "class").alias("class"))
    alike = lines.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    lines = cut(lines.join(alike, "class"))
    first = lines.groupBy("class").agg(F.min(F.struct("doc_id", "row", "start")).alias("_f"))
    same = F.col("doc_id").eqNullSafe(F.col("_f.doc_id")) & (F.col("row") == F.col("_f.row")) & (F.col("start") == F.col("_f.start"))
    found = lines.join(first, "class").select("doc_id", "start", "stop", F.lit("paragraph").alias("kind"), F.col("_f.doc_id").alias("cluster_id"), (~same).alias("removed"))
    runs = repeated_runs(cut(block_rows(docs, how, twice)), how)
    return found.union(runs.select("doc_id", "start", "stop", F.lit("passage").alias("kind"), "cluster_id", "removed"))
