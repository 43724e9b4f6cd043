"""Operator 1: token-id files compressed by Re-Pair grammars, one grammar per shard, with random access to any document.

File format (Parquet, one row per shard, shards and their documents in ascending order of doc_id):

* ``shard`` long: range partition << 32 | number within it; ``n_docs``, ``n_tokens``, ``n_rules``, ``width`` (bytes of a symbol, 2 or 4);
* ``doc_ids`` array<long>; ``doc_symbols``, ``doc_tokens``: little-endian uint32, symbols and tokens of each document;
* ``rules``: little-endian uint32 pairs, rule r being the nonterminal ``base + r``; ``lengths``: uint32 expansion length of each rule;
* ``sequence``: the symbols of all documents, one after another. No rule spans two documents.

Defined cases: a null text is empty and becomes the end id alone; null doc_ids come first; rows that share a doc_id are ordered by a
hash of their text and all kept; an empty table gives no shards; further columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.storage import shared_path
from panelmill.llm.text import arrow_schema, slices, tables
from panelmill.llm.tokens import Encoder, with_end

SHARDS = (
    "shard long, base int, width int, n_docs int, n_tokens long, n_rules int, doc_ids array<long>, "
    "doc_symbols binary, doc_tokens binary, rules binary, lengths binary, sequence binary"
)
#: Least room for rules in 16 bits for which a shard keeps to symbols of 2 bytes.
SHORT = 1 << 12
DIGEST = "shard long, doc_id long, before long, n_tokens long, ids_crc32 long"


def _chosen(keys: np.ndarray, least: int, free: int) -> np.ndarray:
    """The pairs that occur at least a sixteenth as often as the most frequent one, most frequent first."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    count = np.diff(np.append(first, len(keys)))
    if count.max(initial=0) < least:
        return keys[:0]
    take = np.flatnonzero(count >= max(least, count.max() // 16))
    take = take[np.lexsort((keys[first[take]], -count[take]))][:free]
    return keys[first[take]]


def grammar(ids: np.ndarray, bounds: np.ndarray, base: int, least: int = 0, most: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Re-Pair over one shard: (symbols, bounds of the documents, rules, expansion lengths).

    Each round counts all pairs, makes rules of those that are at least a sixteenth as frequent as the most frequent one, and replaces them
    all at once (on shards of prose the symbols left differ by 1 % from those at a quarter, in half the rounds); in a run of overlapping matches every second one is taken. By default it ends when no further rule makes the file smaller: a
    rule takes 12 bytes and saves a symbol each time, so it needs 7 repeats of 2-byte symbols, or 4 of 4-byte ones; symbols have 2 bytes as
    long as SHORT rules or more fit in them, and then no rule more is made. ``least`` repeats and ``most`` rules set other ends.
    """
    room = (1 << 16) - base
    least = least or (7 if room >= SHORT else 4)
    most = most or (room if room >= SHORT else 1 << 24)
    wide = np.uint32 if base + most <= 1 << 16 else np.uint64
    half, factor, slot = (wide(16), wide(0x9E3779B1), wide(32 - 18)) if wide is np.uint32 else (wide(32), wide(0x9E3779B97F4A7C15), wide(64 - 18))
    low = wide((1 << int(half)) - 1)
    seq, bounds = ids.astype(wide), bounds.astype(np.int64)
    rules, lengths = np.zeros((0, 2), np.int64), np.zeros(0, np.int64)
    while len(seq) > 1 and len(rules) < most:
        inner = np.ones(len(seq), bool)
        inner[bounds[1:][bounds[1:] > 0] - 1] = False  # a document's last symbol begins no pair
        keys = (seq[:-1] << half) | seq[1:]
        new = _chosen(keys[inner[:-1]], least, most - len(rules))
        if not len(new):
            break
        table = np.full(1 << 18, -1, np.int32)
        place = (new * factor) >> slot
        table[place[::-1]] = np.arange(len(new), dtype=np.int32)[::-1]  # of two pairs in one slot the more frequent stays, the other waits
        new = new[np.sort(table[np.unique(place)])]
        table[:] = -1
        table[(new * factor) >> slot] = np.arange(len(new), dtype=np.int32)
        found = table[(keys * factor) >> slot]
        at = np.flatnonzero(inner[:-1] & (found >= 0))
        at = at[new[found[at]] == keys[at]]
        head = np.concatenate(([True], np.diff(at) > 1))
        rank = np.arange(len(at)) - np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
        at = at[rank % 2 == 0]
        pairs = np.stack([new >> half, new & low], 1).astype(np.int64)
        size = np.concatenate([np.ones(base, np.int64), lengths])
        seq[at] = (found[at] + (base + len(rules))).astype(wide)
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        bounds = bounds - np.searchsorted(at, bounds, "left")
        seq = seq[stay]
        lengths = np.concatenate([lengths, size[pairs].sum(1)])
        rules = np.concatenate([rules, pairs])
    return seq, bounds, rules, lengths


def _unfold(symbols: np.ndarray, rules: np.ndarray, base: int) -> np.ndarray:
    """Token ids of a few ``symbols``, one level of rules after another."""
    seq = symbols.astype(np.int64)
    while len(seq) and (inner := seq >= base).any():
        start = np.cumsum(1 + inner) - (1 + inner)
        out = np.empty(len(seq) + int(inner.sum()), np.int64)
        out[start[~inner]] = seq[~inner]
        pairs = rules[seq[inner] - base]
        out[start[inner]], out[start[inner] + 1] = pairs[:, 0], pairs[:, 1]
        seq = out
    return seq


def expand(symbols: np.ndarray, rules: np.ndarray, base: int, lengths: np.ndarray) -> np.ndarray:
    """Token ids of ``symbols``: the rules among them are unfolded once, then every symbol's ids are copied to its place."""
    used, place = np.unique(symbols, return_inverse=True) if len(symbols) < len(rules) else (np.arange(base + len(rules)), symbols.astype(np.int64))
    size = np.ones(len(used), np.int64)
    inner = used >= base
    size[inner] = lengths[used[inner] - base]
    ids = _unfold(used, rules, base).astype(np.uint32)
    first, each = (np.cumsum(size) - size)[place], size[place]
    ends = np.cumsum(each)
    return ids[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + each, each)]


class Shard:
    """One row of the file format, opened for random access."""

    def __init__(self, row: dict):
        self.base, self.doc_ids = row["base"], row["doc_ids"]
        self.rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], "<u4").astype(np.int64)
        self.symbols = np.frombuffer(row["sequence"], f"<u{row['width']}")
        self.tokens = np.frombuffer(row["doc_tokens"], "<u4").astype(np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(np.frombuffer(row["doc_symbols"], "<u4").astype(np.int64))))

    def ids(self, k: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids [start, stop) of the shard's document ``k``; only the symbols that reach into the range are expanded."""
        symbols = self.symbols[self.bounds[k] : self.bounds[k + 1]].astype(np.int64)
        stop = self.tokens[k] if stop is None else min(stop, self.tokens[k])
        size = np.ones(len(symbols), np.int64)
        size[symbols >= self.base] = self.lengths[symbols[symbols >= self.base] - self.base]
        ends = np.cumsum(size)
        lo = int(np.searchsorted(ends, start, "right"))
        hi = int(np.searchsorted(ends, stop, "left")) + 1
        before = int(ends[lo - 1]) if lo else 0
        return expand(symbols[lo:hi], self.rules, self.base, self.lengths)[start - before : max(stop - before, 0)]

    def all_ids(self) -> tuple[np.ndarray, np.ndarray]:
        return expand(self.symbols, self.rules, self.base, self.lengths), np.concatenate(([0], np.cumsum(self.tokens)))


def encode(docs: DataFrame, tokenizer: str, end: int, shard_tokens: int = 1 << 20) -> DataFrame:
    """Shards of all ``docs`` (doc_id, text) in ascending doc_id order, closing each document with the id ``end``.

    A shard is closed when it holds ``shard_tokens`` ids, so a task keeps one shard and one slice of text.
    """
    schema = arrow_schema(SHARDS)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        base = max(encoder.tokenizer.get_vocab_size(with_added_tokens=True), end + 1)
        number = TaskContext.get().partitionId() << 32
        names: list[int | None] = []
        held: list[np.ndarray] = []
        sizes: list[int] = []

        def shard() -> dict:
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            seq, cut, rules, lengths = grammar(np.concatenate(held), bounds, base)
            width = 2 if base + len(rules) <= 1 << 16 else 4
            return {
                "shard": [number], "base": [base], "width": [width], "n_docs": [len(names)], "n_tokens": [int(bounds[-1])],
                "n_rules": [len(rules)], "doc_ids": [names], "doc_symbols": [np.diff(cut).astype("<u4").tobytes()],
                "doc_tokens": [np.array(sizes, "<u4").tobytes()], "rules": [rules.astype("<u4").tobytes()],
                "lengths": [lengths.astype("<u4").tobytes()], "sequence": [seq.astype(f"<u{width}").tobytes()],
            }

        for batch in slices(batches, "text", 8 << 20):
            ids, bounds = with_end(*encoder.encode(batch.column("text")), end)
            keys = batch.column("doc_id").to_pylist()
            at = 0
            while at < len(keys):
                room = shard_tokens - sum(sizes)
                to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + room, "right")) - 1)
                held.append(ids[bounds[at] : bounds[to]])
                names += keys[at:to]
                sizes += np.diff(bounds[at : to + 1]).tolist()
                at = to
                if sum(sizes) >= shard_tokens or at < len(keys):
                    yield from tables(iter([shard()]), schema)
                    number += 1
                    names, held, sizes = [], [], []
        if names:
            yield from tables(iter([shard()]), schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = rows.repartitionByRange(*keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())
    return rows.mapInArrow(write, SHARDS)


def write_files(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Write the shards to ``path``. Texts are shuffled once, to order them by doc_id; the grammars are local to a shard."""
    encode(docs, tokenizer, end).write.option("compression", "zstd").parquet(path)


def first_ids(files: DataFrame) -> DataFrame:
    """(shard, first): number of ids before each shard. Sums within a range partition, then over the partitions, a few numbers each."""
    size = files.select("shard", F.shiftright("shard", 32).alias("part"), "n_tokens")
    parts = size.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard")) - F.col("n_tokens")
    return size.select("shard", "part", within.alias("within")).join(parts, "part").select("shard", (F.col("base") + F.col("within")).alias("first"))


def digests(files: DataFrame) -> DataFrame:
    """Per document of written ``files``: doc_id, start, n_tokens, and the crc32 of its decoded ids."""
    schema = arrow_schema(DIGEST)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                shard = Shard(row)
                ids, bounds = shard.all_ids()
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
                yield from tables(iter([{"shard": np.full(len(crc), row["shard"]), "doc_id": row["doc_ids"], "before": bounds[:-1], "n_tokens": shard.tokens, "ids_crc32": crc}]), schema)

    blobs = files.select("shard", "base", "width", "doc_ids", "doc_symbols", "doc_tokens", "rules", "lengths", "sequence")
    rows = blobs.mapInArrow(read, DIGEST).join(first_ids(files), "shard")
    return rows.select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """Write ``docs`` in the file format to the shared folder, read the files back, and return their digests."""
    path = shared_path(docs.sparkSession, "repair")
    write_files(docs, path, tokenizer, end)
    return digests(docs.sparkSession.read.schema(SHARDS).parquet(path))
