"""Operator 6: token counts by compiled finite-state transducers, for byte-level BPE files of the tokenizers library.

Two deterministic transducers are compiled. The *splitter* cuts texts into pre-tokens: a table over classes of characters whose entries say
which cuts a character brings. Texts are laid out in chunks; each chunk's state map (exit state for every entry state) is computed for all
chunks at once, the maps are composed by a parallel prefix scan, and a second pass emits the cuts from the now known entry states. The
*counter* reads the bytes of a pre-token; each transition carries the number of tokens it emits. It is the determinisation, built as far as
the texts need it, of the automaton of valid token sequences: a sequence is the BPE encoding of its bytes exactly if each two neighbours
encode to themselves, so a state is the set of (last token, bytes since then) that are still possible, with the tokens not yet emitted.

Defined cases: a null text is empty and has no bytes and tokens; the added special tokens of the file count as one token where they stand
in a text, as the library does by default; rows are counted one by one, whatever their doc_id; further columns are not read.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.text import arrow_schema, per_row, slices, tables, utf8

#: Classes of characters that the splitting pattern tells apart.
END, LETTER, NUMBER, OTHER, QUOTE, BLANK, WHITE, STMD, R, V, LOW_L, E = range(12)
#: States, named by what has been read of the current pre-token.
BEGIN, LETTERS, NUMBERS, OTHERS, ONE_QUOTE, CLOSED, QUOTE_R, QUOTE_V, QUOTE_L, BLANK_1, WHITE_1, BLANK_N, WHITE_N = range(13)
STATES, CLASSES = 13, 12
#: What a transition cuts: before this character, before the previous one.
HERE, BACK = 1, 2
CHUNK = 64
#: States of the counter and pre-tokens that a worker keeps; both stores start anew when full.
KEPT_STATES, KEPT_TOKENS = 200_000, 800_000


def _step(state: int, kind: int) -> tuple[int, int]:
    """Next state and cuts, for the pattern 's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space but its last|white space."""
    letter = kind in (LETTER, STMD, R, V, LOW_L, E)
    fresh = {NUMBER: NUMBERS, OTHER: OTHERS, QUOTE: ONE_QUOTE, BLANK: BLANK_1, WHITE: WHITE_1}.get(kind, LETTERS)
    if kind == END:
        return BEGIN, HERE | (BACK if state in (QUOTE_R, QUOTE_V, QUOTE_L) else 0)
    if state in (QUOTE_R, QUOTE_V, QUOTE_L):
        if kind == (LOW_L if state == QUOTE_L else E):
            return CLOSED, 0
        to, cuts = _step(LETTERS, kind)
        return to, cuts | BACK
    if state == LETTERS and letter or state == NUMBERS and kind == NUMBER or state == OTHERS and kind in (OTHER, QUOTE):
        return state, 0
    if state == ONE_QUOTE:
        if kind in (OTHER, QUOTE):
            return OTHERS, 0
        if kind in (STMD, R, V, LOW_L):
            return {STMD: CLOSED, R: QUOTE_R, V: QUOTE_V, LOW_L: QUOTE_L}[kind], 0
    if state in (BLANK_1, WHITE_1, BLANK_N, WHITE_N):
        if kind in (BLANK, WHITE):
            return (BLANK_N if kind == BLANK else WHITE_N), 0
        last = BACK if state in (BLANK_N, WHITE_N) else 0
        if state in (BLANK_1, BLANK_N):
            return (OTHERS if kind == QUOTE else fresh), last
        return fresh, last | HERE
    return fresh, HERE


@cache
def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cuts, at state * CLASSES + class."""
    both = np.array([_step(s, k) for s in range(STATES) for k in range(CLASSES)], np.uint8)
    return both[:, 0].copy(), both[:, 1].copy()


@cache
def classes() -> np.ndarray:
    """Class of every code point, from its Unicode category; white space is what the property White_Space says."""
    out = np.full(0x110000, OTHER, np.uint8)
    for c in range(0x110000):
        if 0xAC00 <= c <= 0xD7A3 or 0x4E00 <= c <= 0x9FFF:
            out[c] = LETTER
            continue
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            out[c] = LETTER if major == "L" else NUMBER
        elif chr(c).isspace() and not 0x1C <= c <= 0x1F:
            out[c] = WHITE
    out[ord(" ")], out[ord("'")] = BLANK, QUOTE
    out[[ord(c) for c in "stmd"]] = STMD
    out[ord("r")], out[ord("v")], out[ord("l")], out[ord("e")] = R, V, LOW_L, E
    return out


def compose(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    """State maps (chunks x states) of each chunk of ``first`` followed by that of ``then``."""
    return np.take_along_axis(then, first, 1)


def scan(maps: np.ndarray) -> np.ndarray:
    """State map of all chunks up to and with each one, in log2(chunks) rounds of composing neighbours at doubling distance."""
    maps, reach = maps.copy(), 1
    while reach < len(maps):
        maps[reach:] = compose(maps[:-reach].copy(), maps[reach:].copy())
        reach *= 2
    return maps


def cut(kinds: np.ndarray) -> np.ndarray:
    """True where a pre-token starts, for a run of classes that begins in the state BEGIN."""
    to, cuts = splitter()
    n = len(kinds)
    if not n:
        return np.zeros(0, bool)
    chunks = -(-n // CHUNK)
    grid = np.full(chunks * CHUNK, END, np.uint8)
    grid[:n] = kinds
    grid = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (chunks, 1))
    for row in grid:
        maps = to[maps * np.uint8(CLASSES) + row[:, None]]
    state = np.concatenate(([BEGIN], scan(maps)[:-1, BEGIN])).astype(np.uint8)
    out = np.empty((CHUNK, chunks), np.uint8)
    for k, row in enumerate(grid):
        at = state * np.uint8(CLASSES) + row
        out[k], state = cuts[at], to[at]
    out = out.T.ravel()
    start = (out & HERE).astype(bool)
    start[:-1] |= (out[1:] & BACK).astype(bool)
    start = start[:n]
    start[0] = True
    return start


class Counter:
    """Counts of the tokens of pre-tokens, by the transducer compiled from a tokenizer's file."""

    _known: dict[str, Counter] = {}

    @classmethod
    def of(cls, path: str) -> Counter:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre, model = spec["pre_tokenizer"], spec["model"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"] or spec["normalizer"] or model.get("ignore_merges") or model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: only byte-level BPE with its default pattern is compiled")
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shown = {c: c for c in plain} | {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        byte = {chr(c): b for b, c in shown.items()}
        added = {t["id"] for t in spec["added_tokens"]}
        self.special = [t["content"].encode() for t in spec["added_tokens"]]
        self.bytes = {i: bytes(byte[c] for c in s) for s, i in model["vocab"].items() if i not in added}
        number = model["vocab"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.merges = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(pairs)}
        self.single = {b[0]: i for i, b in self.bytes.items() if len(b) == 1}
        self.child: list[dict[int, int]] = [{}]
        self.token: list[int] = [-1]
        for i, b in self.bytes.items():
            node = 0
            for x in b:
                if x not in self.child[node]:
                    self.child[node][x] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][x]
            self.token[node] = i
        self.valid: dict[tuple[int, int], bool] = {}
        self.known: dict[bytes, int] = {}
        self.clear()

    def clear(self) -> None:
        self.sets: list[tuple] = [((-1, 0, 0),)]
        self.number = {self.sets[0]: 0}
        self.next: list[dict[int, tuple[int, int]]] = [{}]
        self.last: list[int] = [0]

    def merged(self, raw: bytes) -> list[int]:
        """Encoding of ``raw`` by the merges, lowest rank first."""
        out = [self.single[b] for b in raw]
        while len(out) > 1:
            best = min((self.merges[p][0], k) for k, p in enumerate(zip(out, out[1:])) if p in self.merges) if any(p in self.merges for p in zip(out, out[1:])) else None
            if best is None:
                break
            k = best[1]
            out[k : k + 2] = [self.merges[out[k], out[k + 1]][1]]
        return out

    def follows(self, before: int, token: int) -> bool:
        """Whether ``token`` can stand behind ``before`` (-1: first) in an encoding."""
        pair = (before, token)
        if pair not in self.valid:
            if len(self.valid) > 4 * KEPT_STATES:
                self.valid.clear()
            self.valid[pair] = self.merged(self.bytes.get(before, b"") + self.bytes[token]) == [t for t in pair if t >= 0]
        return self.valid[pair]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition of ``state`` on ``byte``: next state and emitted tokens."""
        reached: dict[tuple[int, int], int] = {}
        for before, node, owed in self.sets[state]:
            node = self.child[node].get(byte, -1)
            if node < 0:
                continue
            reached[before, node] = owed
            token = self.token[node]
            if token >= 0 and self.follows(before, token):
                reached[token, 0] = owed + 1
        least = min(reached.values())
        key = tuple(sorted((b, n, owed - least) for (b, n), owed in reached.items()))
        to = self.number.setdefault(key, len(self.sets))
        if to == len(self.sets):
            self.sets.append(key)
            self.next.append({})
            self.last.append(next((owed for _, n, owed in key if n == 0), -1))
        self.next[state][byte] = to, least
        return to, least

    def count(self, raw: bytes) -> int:
        if len(self.sets) > KEPT_STATES:
            self.clear()
        state = total = 0
        table = self.next
        for b in raw:
            state, emitted = table[state].get(b) or self.compile(state, b)
            total += emitted
        return total + self.last[state]

    def counts(self, pretokens: pa.Array) -> np.ndarray:
        """Tokens of each pre-token; each distinct one runs through the transducer once."""
        coded = pretokens.dictionary_encode()
        if len(self.known) > KEPT_TOKENS:
            self.known.clear()
        known, out = self.known, []
        for raw in coded.dictionary.to_pylist():
            n = known.get(raw)
            if n is None:
                n = known[raw] = self.count(raw)
            out.append(n)
        return np.array(out, np.int64)[coded.indices.to_numpy()] if len(pretokens) else np.zeros(0, np.int64)


def token_counts(column: pa.Array, counter: Counter) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, tokens) of every text of a column."""
    data, offsets = utf8(column)
    if not len(data):
        return np.diff(offsets), np.zeros(len(column), np.int64)
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    kinds = classes()[np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)]
    char_offsets = np.searchsorted(lead, offsets)
    special = np.zeros(len(data), np.int64)
    raw = data.tobytes()
    for mark in counter.special:
        for m in re.finditer(re.escape(mark), raw) if mark in raw else ():
            row = int(np.searchsorted(offsets, m.start(), "right")) - 1
            if m.end() <= offsets[row + 1]:
                special[m.start()] = 1
                special[m.start() + 1 : m.end()] = -1
    # A closing mark behind every text keeps its last state from the next one.
    wide = np.insert(kinds, char_offsets[1:], END)
    wide[np.arange(len(kinds)) + np.repeat(np.arange(len(column)), np.diff(char_offsets))] = np.where(special[lead] != 0, END, kinds)
    keep = np.ones(len(wide), bool)
    keep[char_offsets[1:] + np.arange(len(column))] = False
    starts = lead[cut(wide)[keep]]
    ends = np.append(starts, len(data)).astype(np.int32)
    pretokens = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data.tobytes())])
    tokens = counter.counts(pretokens)
    inside = special[starts]
    at = np.zeros(len(data), np.int64)
    at[starts] = np.where(inside == 0, tokens, inside == 1)
    return np.diff(offsets), per_row(at, offsets)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit. One pass without a shuffle."""
    out = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(tokenizer)
        for batch in slices(batches, "text", 8 << 20):
            size, tokens = token_counts(batch.column("text"), counter)
            yield from tables(iter([{"doc_id": batch.column("doc_id"), "n_bytes": size, "n_tokens": tokens, "over_limit": tokens > limit}]), arrow_schema(out))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)
