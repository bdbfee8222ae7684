"""Token counts of whole texts by a finite-state compilation of a sentence-piece vocabulary.

The vocabulary's merges are compiled into a deterministic transducer whose transitions carry the number of tokens
that they emit. Merging always takes the best-scored pair, leftmost first, so a sequence of tokens is the result for
its string exactly if every two neighbours stay apart when merged alone, and each prefix of a text has one last
token. A state therefore keeps, for each start of a token that may still be open, the place in the vocabulary's trie,
the token before it and how many tokens it is behind; the emission is the change of the prefix's count, which may be
zero or negative. States and transitions are built when first met. Between two characters that no token holds side
by side nothing is open: there every state goes to the same one.

A text is cut into chunks. A chunk's state map is a function of the state before it: a head that runs until the first
such place, and from there a constant. Maps compose associatively, so those of a text combine in a tree, the up-sweep
of a prefix scan. A text is one Spark row, so its chunks are composed in its own task and nothing is shuffled.
"""

from __future__ import annotations

import gc
import re
from typing import NamedTuple

import sentencepiece
from pyspark.sql import DataFrame, functions as F

from .shared import map_texts

LIMIT = 4096
CHUNK = 2048
MOST_STATES = 400_000  # kept at once; beyond it they are built anew
MOST_RUNS = 200_000  # kept at once in a state
FEW = 64
NEVER = (float("-inf"), "")
#: Fixed value: how the vocabulary writes a blank, which it also puts before every text that is not empty.
BLANK = "▁"
RUNS = re.compile(f"{BLANK}+[^{BLANK}]{{0,63}}|[^{BLANK}]{{1,64}}")


class State(dict):
    """Transitions of a state: character or run of characters -> (next state, emitted tokens)."""

    __slots__ = ("before", "machine", "open")

    def __init__(self, machine: Transducer, before: str, open_: tuple) -> None:
        self.machine, self.before, self.open = machine, before, open_

    def __missing__(self, read: str) -> tuple[State, int]:
        if len(read) == 1:
            move = self.machine.move(self, read)
        else:
            state, n = self, 0
            for c in read:
                state, emitted = state[c]
                n += emitted
            move = state, n
            if len(self) >= MOST_RUNS:
                self.clear()
        self[read] = move
        return move


class ChunkMap(NamedTuple):
    """From a state: read ``head`` (runs of characters); if ``end`` is given, go there and emit ``n`` more."""

    head: tuple[str, ...]
    end: State | None
    n: int


class Alone(NamedTuple):
    """A piece merged by itself: whether it becomes one symbol, and (score, symbol at the left, at the right end) after each merge."""

    whole: bool
    lefts: list[tuple[float, str]]
    rights: list[tuple[float, str]]


class Transducer:
    """The compiled vocabulary of one sentence-piece file (merges by score, unknown characters as bytes)."""

    def __init__(self, model: str) -> None:
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        pieces = [i for i in range(sp.vocab_size()) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in pieces}
        self.inner = {piece[i : i + 2] for piece in self.score for i in range(len(piece) - 1)}
        self.known = set("".join(self.score))
        if not self.known <= self.score.keys():
            raise ValueError("every character of a piece must be a piece")
        self.children: list[dict[str, int]] = [{}]
        self.token: list[str | None] = [None]
        self.below: list[list[str]] = [[]]  # tokens that a node's children lead to
        for piece in self.score:
            node = 0
            for c in piece:
                self.below[node].append(piece)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.token.append(None)
                    self.below.append([])
                node = self.children[node][c]
            self.token[node] = piece
        self.merges: dict[str, Alone] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        self.living: dict[tuple[str, int], bool] = {}
        self.states: dict[tuple, State] = {}
        self.start = self.state("", ((0, None, 0),))

    def state(self, before: str, open_: tuple) -> State:
        if len(self.states) >= MOST_STATES:
            for held in (self.states, self.apart, self.living, self.start):
                held.clear()
            self.states["", self.start.open] = self.start
        key = (before, open_)
        if key not in self.states:
            self.states[key] = State(self, before, open_)
        return self.states[key]

    def alone(self, piece: str) -> Alone:
        """How a piece merges with nothing beside it."""
        if piece not in self.merges:
            parts, lefts, rights = list(piece), [], []
            while found := [(self.score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]:
                score, i = max(found)
                parts[-i : 2 - i] = ["".join(parts[-i : 2 - i])]
                lefts.append((score, parts[0]))
                rights.append((score, parts[-1]))
            self.merges[piece] = Alone(len(parts) == 1, [*lefts, NEVER], [*rights, NEVER])
        return self.merges[piece]

    def stays_apart(self, left: str | None, right: str) -> bool:
        """Whether both are results of merging, and remain when merged side by side.

        Their own merges are followed in the order in which they interleave, better score first and then left first,
        until the symbols that meet between them are the best pair, or nothing is left to merge.
        """
        if left is None:
            return self.alone(right).whole
        key = (left, right)
        if key not in self.apart:
            one, two = self.alone(left), self.alone(right)
            self.apart[key] = one.whole and two.whole and not self._meets(left[-1], one.rights, right[0], two.lefts)
        return self.apart[key]

    def _meets(self, x: str, rights: list, y: str, lefts: list) -> bool:
        i = j = 0
        while True:
            mine, theirs = rights[i][0], lefts[j][0]
            both = self.score.get(x + y)
            if both is not None and both > mine and both >= theirs:
                return True
            if mine >= theirs:
                if mine == NEVER[0]:
                    return False
                x = rights[i][1]
                i += 1
            else:
                y = lefts[j][1]
                j += 1

    def alive(self, last: str | None, node: int) -> bool:
        """Whether some token at or below a node of few tokens may follow ``last``; an open start where none may is closed."""
        if last is None or len(self.below[node]) > FEW:
            return True
        key = (last, node)
        if key not in self.living:
            self.living[key] = any(self.stays_apart(last, t) for t in self.below[node])
        return self.living[key]

    def move(self, state: State, c: str) -> tuple[State, int]:
        if c not in self.known:  # one token for each byte, and nothing is open after it
            return self.start, len(c.encode())
        open_ = state.open if state.before + c in self.inner else self.start.open
        grown = [(self.children[node][c], last, behind) for node, last, behind in open_ if c in self.children[node]]
        ended = [(self.token[node], behind + 1) for node, last, behind in grown if self.token[node] and self.stays_apart(last, self.token[node])]
        ((token, emitted),) = ended  # a prefix has one last token
        kept = tuple((node, last, behind - emitted) for node, last, behind in grown if self.below[node] and self.alive(last, node))
        return self.state(c, (*kept, (0, token, 0))), emitted

    def chunk_map(self, chunk: str) -> ChunkMap:
        """The map of a chunk, whatever comes before it."""
        first = next((i for i in range(1, len(chunk)) if chunk[i - 1 : i + 1] not in self.inner), len(chunk))
        head = tuple(chunk[i : min(i + 64, first)] for i in range(0, first, 64))
        if first == len(chunk):
            return ChunkMap(head, None, 0)
        state, n = self.start, 0
        for run in RUNS.findall(chunk, first):
            # a blank after another character is such a place, so every run of blanks goes on from the start
            state, emitted = (self.start if run[0] == BLANK else state)[run]
            n += emitted
        return ChunkMap(head, state, n)

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        """First ``a``, then ``b``."""
        if a.end is None:
            return ChunkMap(a.head + b.head, b.end, b.n)
        state, n = self.through(a.end, b)
        return ChunkMap(a.head, state, a.n + n)

    def through(self, state: State, m: ChunkMap) -> tuple[State, int]:
        n = m.n
        for run in m.head:
            state, emitted = state[run]
            n += emitted
        return (state if m.end is None else m.end), n

    def count(self, text: str) -> int:
        """Number of tokens of a whole text."""
        if not text:
            return 0
        text = BLANK + text.replace(" ", BLANK)
        maps = [self.chunk_map(text[i : i + CHUNK]) for i in range(0, len(text), CHUNK)]
        while len(maps) > 1:
            maps = [self.compose(*maps[i : i + 2]) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
        return self.through(self.start, maps[0])[1]


_transducers: dict[str, Transducer] = {}


def transducer(model: str) -> Transducer:
    """This worker's transducer; it lives as long as the worker."""
    if model not in _transducers:
        gc.set_threshold(200_000, 20, 100)  # states are many and live long: looking through them often is a third of the time
        _transducers[model] = Transducer(model)
    return _transducers[model]


def count_tokens(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row.

    ``model``: a sentence-piece file that merges by score, falls back to bytes and changes nothing of a text but its
    blanks. A null or empty text has no bytes and no tokens; repeated rows and null ids are rows of their own; an empty
    table gives no rows. Strings of special tokens are ordinary text. Work is linear in a text's length.
    """

    def count(keys: list, texts: list) -> dict[str, list]:
        machine = transducer(model)
        texts = [t or "" for t in texts]
        return {"doc_id": keys, "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [machine.count(t) for t in texts]}

    found = map_texts(docs, key, text, "doc_id bigint, n_bytes bigint, n_tokens bigint", count, pack=64)
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
