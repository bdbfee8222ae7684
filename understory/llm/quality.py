"""Quality rules: word and line counts, and bands of zstandard compression ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .shared import map_texts

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of compressed size over size, by length in bytes.

    ``whole``: (least length, lowest ratio, highest ratio); the last entry whose length is reached holds, and texts
    shorter than the first have too few bytes to judge. Short texts compress less, so their bands lie higher.
    ``chunk_bytes`` and ``chunk``: the band of each whole chunk, and of the text's last ``chunk_bytes``, which overlap
    the chunk before; a text goes if over ``bad_share`` of its chunks are outside.
    """

    whole: tuple[tuple[int, float, float], ...] = ((64, 0.45, 1.03), (128, 0.40, 0.95), (256, 0.30, 0.95), (1024, 0.25, 0.82), (8192, 0.20, 0.75), (65536, 0.15, 0.72))
    chunk_bytes: int = 2048
    chunk: tuple[float, float] = (0.20, 0.85)
    bad_share: float = 0.5
    level: int = 3


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; a null text has no words."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup_lines += 1
        elif line.strip():
            seen.add(line)
    chars = len(text) - sum(map(text.count, SPACES))
    return len(words), chars, sum(map(text.count, SYMBOLS)), dup_lines, repeated_words(words)


def repeated_words(words: list[bytes], width: int = 3) -> int:
    """Words that lie in a window of ``width`` words which the text has twice or more, its first place included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    word = np.array([ids.setdefault(w, len(ids)) for w in words], np.int64)
    key = word[:n]
    for k in range(1, width):  # dense ids of ever longer windows: no overflow however many words there are
        key = np.unique(key * len(ids) + word[k : k + n], return_inverse=True)[1]
    again = np.bincount(key)[key] > 1
    covered = np.zeros(len(words), bool)
    for k in range(width):
        covered[k : k + n] |= again
    return int(covered.sum())


def compression_verdict(raw: bytes, bands: Bands, squeeze: zstandard.ZstdCompressor) -> tuple[float | None, float | None, bool]:
    """Ratio of the whole text, share of chunks outside their band, and whether both are in order."""
    band = [b for b in bands.whole if b[0] <= len(raw)]
    if not band:
        return None, None, True
    ratio = len(squeeze.compress(raw)) / len(raw)
    last = len(raw) - bands.chunk_bytes
    starts = [*range(0, last, bands.chunk_bytes), last] if last >= 0 else []
    sizes = [len(squeeze.compress(raw[i : i + bands.chunk_bytes])) / bands.chunk_bytes for i in starts]
    bad = sum(not bands.chunk[0] <= x <= bands.chunk[1] for x in sizes) / len(sizes) if sizes else None
    return ratio, bad, band[-1][1] <= ratio <= band[-1][2] and (bad or 0) <= bands.bad_share


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Counts, ratios and verdict of every document; one row out for each row in, no shuffle.

    A null or empty text has no words and so fails; repeated rows are judged alike; no other column is read.
    """

    def run(keys: list, texts: list) -> dict[str, list]:
        squeeze = zstandard.ZstdCompressor(level=bands.level)
        rows = []
        for k, t in zip(keys, texts, strict=True):
            n, chars, symbols, lines, repeats = base_counts(t)
            failed = n < 50 or 100 * repeats > 50 * n
            ratio, bad, fine = compression_verdict((t or "").encode("utf-8", "surrogatepass"), bands, squeeze)
            rows.append((k, n, chars, symbols, lines, repeats, failed, not failed and fine, ratio, bad))
        return dict(zip(NAMES, zip(*rows, strict=True), strict=True)) if rows else {n: [] for n in NAMES}

    return map_texts(docs, key, text, SCHEMA, run)


SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, ratio double, bad_chunks double"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The documents that pass, with all their columns.

    The verdict is computed beside the row in one pass (no join back), so repeated ids are judged row by row. Null and
    empty texts have no words and go; an empty table stays empty.
    """
    @pandas_udf("boolean")
    def passes(texts):
        squeeze = zstandard.ZstdCompressor(level=bands.level)

        def one(t):
            n, _, _, _, repeats = base_counts(t)
            return not (n < 50 or 100 * repeats > 50 * n) and compression_verdict(t.encode("utf-8", "surrogatepass"), bands, squeeze)[2]

        return texts.map(one).astype(bool)

    return docs.where(passes(F.col("text")))
