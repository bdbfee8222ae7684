"""Spelling variants: words at one edit from each other, by composition of finite-state machines.

The vocabulary is an acceptor A, and E a transducer that reads a word and writes it with exactly one code point
inserted, deleted or replaced. The pairs accepted by A . E . A are the near words. Before the edit both copies of A
are in the same state, so the composed machine is split by the state in which it begins: all words that share what is
read before a range of places, and, from the other end, what is read after it. A part with its own minimised acceptor
is enumerated by itself, in a task's stream of parts; the edit must lie in the part's range, at the first difference,
so each pair comes from one part only. A part with too many words is dealt anew on halves of its range, before any
shuffle, down to single places, where the alphabet bounds it.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .shared import cut

SHORTEST = 7
TWICE = 2
FACTOR = 10
DELETE = 31
MOST = 2048  # words of a part that is enumerated in one piece
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = TWICE) -> DataFrame:
    """(word, n) of all words of at least ``shortest`` code points that occur ``least`` times.

    Words are maximal runs of letters A-Z, a-z and U+00C0 to U+00FF, in lower case (A-Z only). Where 31 divides the
    crc32 of ``<id>:<run>``, the run loses its code point number crc32 modulo length.
    """
    runs = docs.select(docs[key].alias("id"), F.explode(F.regexp_extract_all(docs[text], F.lit(f"([A-Za-zÀ-ÿ]{{{shortest},}})"), F.lit(1))).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
    at = F.pmod(F.col("h"), F.length("run")).cast("int")
    shorter = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % DELETE == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _keyed(words: DataFrame) -> DataFrame:
    """With ``part``: the shorter length, the range of places, and what a word of it reads before and after them."""
    after = F.greatest(F.lit(0), F.col("size") - F.col("to"))
    long = F.length("word")
    return words.withColumn("part", F.concat_ws("|", "size", "start", "to", F.substr("word", F.lit(1), F.col("start")), F.substr("word", long - after + 1, after)))


def _halved(words: DataFrame) -> DataFrame:
    middle = F.floor((F.col("start") + F.col("to")) / 2).cast("int")
    halves = F.array(F.struct(F.col("start").alias("start"), middle.alias("to")), F.struct(middle.alias("start"), F.col("to").alias("to")))
    return words.withColumn("_h", F.explode(halves)).select("word", "n", "size", F.col("_h.start").alias("start"), F.col("_h.to").alias("to"))


def parts(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, size, start, to, part): ``words`` dealt to parts of at most ``most`` words, or of one place.

    A pair of lengths (m, m) or (m, m + 1) belongs to size m, and its edit to one place of 0 to m. Parts are counted
    first, so no crowded part is ever sent to one task.
    """
    sizes = F.explode(F.array(F.length("word"), F.length("word") - 1))
    todo = cut(_halved(words.withColumn("size", sizes).select("word", "n", "size", F.lit(0).alias("start"), (F.col("size") + 1).alias("to"))))
    done = None
    while True:
        keyed = _keyed(todo)
        counts = keyed.groupBy("part").agg(F.count("*").alias("held"), F.max(F.col("to") - F.col("start")).alias("wide")).where("held > 1")
        counts = cut(counts.withColumn("crowded", (F.col("held") > most) & (F.col("wide") > 1)).select("part", "crowded"))
        shared = keyed.join(counts, "part")
        small = shared.where("not crowded").drop("crowded")
        done = small if done is None else done.unionByName(small)
        if counts.where("crowded").isEmpty():
            return done
        todo = cut(_halved(shared.where("crowded")))


class Acceptor:
    """Minimised acceptor of a sorted set of words: equal states are one, and a state is its (final, arcs)."""

    def __init__(self, words: list[str]) -> None:
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        last, path = "", [[False, {}]]  # the last word's states, which later words may still share
        for word in words:
            shared = len(os.path.commonprefix((last, word)))
            self._close(path, last, shared)
            path.extend([False, {}] for _ in range(len(word) - shared))
            path[-1][0] = True
            last = word
        self._close(path, last, 0)
        self.start = self._one(*path[0])

    def _close(self, path: list, last: str, shared: int) -> None:
        """Make the states beyond the shared characters final: no later word adds to them."""
        while len(path) > shared + 1:
            state = self._one(*path.pop())
            path[-1][1][last[len(path) - 1]] = state

    def _one(self, final: bool, arcs: dict[str, int]) -> int:
        key = (final, *arcs.items())
        if key not in self._known:
            self._known[key] = len(self.arcs)
            self.arcs.append(arcs)
            self.final.append(final)
        return self._known[key]


def one_edit(a: Acceptor, within: int) -> Iterator[tuple[str, str]]:
    """Pairs accepted by A . E . A whose first difference is before place ``within``; of unequal lengths the shorter comes first."""
    before = [(a.start, 0, None)]  # state, characters read, and these as pairs (what was read, last character)
    while before:
        q, depth, read = before.pop()
        if depth >= within:
            continue
        arcs = sorted(a.arcs[q].items())
        lead = _text(read) if len(arcs) > 1 or a.final[q] else ""
        for i, (c, after) in enumerate(arcs):
            # replaced: both go on from different arcs, and then read the same
            for d, other in arcs[i + 1 :]:
                yield from ((lead + c + rest, lead + d + rest) for rest in _both(a, after, other))
            # inserted: only the longer one reads c, and the other does not read c next
            if a.final[q] and a.final[after]:
                yield lead, lead + c
            for d, shorter in arcs:
                if d != c and d in a.arcs[after]:
                    yield from ((lead + d + rest, lead + c + d + rest) for rest in _both(a, shorter, a.arcs[after][d]))
            before.append((after, depth + 1, (read, c)))


def _both(a: Acceptor, p: int, q: int) -> Iterator[str]:
    """Words that are read from both states to an end."""
    held = [(p, q, None)]
    while held:
        p, q, read = held.pop()
        if a.final[p] and a.final[q]:
            yield _text(read)
        fewer, more = sorted((a.arcs[p], a.arcs[q]), key=len)
        held.extend((fewer[c], more[c], (read, c)) for c in fewer if c in more)


def _text(read: tuple | None) -> str:
    found = []
    while read:
        read, c = read
        found.append(c)
    return "".join(reversed(found))


def near_words(words: DataFrame, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n): every ordered pair of ``words`` (word, n) that differ by exactly one edit."""
    dealt = parts(words, most).repartition("part").sortWithinPartitions("part", "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
        for rows in _bundles(batches):
            held, size, start, to = {w: n for w, n, *_ in rows}, *rows[0][2:]
            after = max(0, size - to)
            lead, tail = rows[0][0][:start], rows[0][0][len(rows[0][0]) - after :]
            middles = sorted(w[start : len(w) - after] for w in held)
            found = []
            for x, y in one_edit(Acceptor(middles), to - start):
                v, w = lead + x + tail, lead + y + tail
                # the shorter of a pair sets its size
                if min(len(v), len(w)) == size:
                    found += ((v, held[v], w, held[w]), (w, held[w], v, held[v]))
            for at in range(0, len(found), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[at : at + 10_000], strict=True), schema, strict=True)], schema=schema)

    return dealt.select("part", "word", "n", "size", "start", "to").mapInArrow(run, "word string, n bigint, near string, near_n bigint")


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows (word, n, size, start, to) of each part of a sorted partition; a part has few rows."""
    now, held = None, []
    for batch in batches:
        for part, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part != now:
                if len(held) > 1:
                    yield held
                now, held = part, []
            held.append(tuple(row))
    if len(held) > 1:
        yield held


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) by following ``forms`` (word, form) to the last; forms must not run in circles.

    Each round doubles the steps taken. A form is ten times as frequent as its word, so the rounds are few.
    """
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        now = cut(now.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if now.where("moved").isEmpty():
            return now.select("word", "root")
        now = now.select("word", "root")


def group_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", factor: int = FACTOR, most: int = MOST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the vocabulary.

    ``form`` is the near word of largest n (ties: the smallest) if that is at least ``factor`` times the word's own,
    else null; ``root`` the last of the chain of forms, or the word. A null or empty text has no words, repeated rows
    count each, a null id is written as nothing before the colon, and an empty table gives no rows.
    """
    words = cut(vocabulary(docs, key, text))
    # the largest n, then the smallest word: as a minimum of structs, which combines before the shuffle
    best = near_words(words, most).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best"))
    known = cut(words.join(best, "word", "left").withColumn("chosen", -F.col("best.rank") >= factor * F.col("n")).select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(F.col("chosen"), F.col("best.form")).alias("form"), F.when(F.col("chosen"), -F.col("best.rank")).alias("form_n"),
    ))
    last = roots(known.where("form is not null").select("word", "form"))
    return known.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
