"""Operator 4: bigram language model in a log-frequency Bloom filter.

Counts of words and of word pairs are summed over all training documents. A count is quantised to a level on a logarithmic scale, and an
n-gram of level q is entered q times under different hashes; its level is read back by probing 1, 2, ... until a probe fails. The filter is
blocked (the probes of one n-gram fall in one block), built block by block in Spark, and has as many blocks as the n-grams need: all words
and all pairs seen twice or more are in it at every size (a pair seen once says nothing under leave-one-out).

A filter of at most ``FILTER_BYTES`` is broadcast. A larger one stays a table of blocks: texts are numbered in chunks, the distinct n-grams of
a chunk meet the block they fall in, and the levels found go back to their chunk. Only the most frequent n-grams, at most ``HEAD``, are
broadcast with the level that the filter has for them. Both ways read the same blocks and give the same levels.

log10 P(text) sums, over the words and one end token, log10(w * c(v, x) / c(v) + (1 - w) * (c(x) + 0.5) / (N + 0.5 (V + 1))), all counts as
probed, with one weight w per range of c(v), fitted by expectation maximisation on leave-one-out counts of all training documents.

The exact counts of the base score come from two places: words of the most frequent levels, at most ``HOT_WORDS``, are broadcast; the other
words of a document are joined with the table of counts.

Defined cases: a null text is empty (its end token alone); a null doc_id counts as the text '' for the hold-out rule; rows that share a
doc_id are scored one by one; without training rows every token is unknown; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.llm.storage import stage
from panelmill.llm.text import LOWER, arrow_schema, hashes, mix, owner, prefix, slices, tables, utf8, words

#: Largest filter that is broadcast, most words with exact counts, and most n-grams with levels that are.
FILTER_BYTES = 64 << 20
HOT_WORDS = 1 << 20
HEAD = 1 << 22
#: Smallest count of a pair in the filter.
LEAST_PAIR = 2
BLOCK_BYTES = 1 << 16
#: Bytes of text that a worker holds as arrays at once, and of a chunk that asks a filter that isn't broadcast.
SLICE = 1 << 20
CHUNK = 4 << 20
#: Probes of the first level and of each further one.
FIRST, MORE = 8, 4
END, START = np.uint64(0x5EED0E4D), np.uint64(0x5EED57A7)
_PAIR = np.uint64(0xD6E8FEB86659FD93)
COUNTS = "size int, key long, n long"


def level(count: np.ndarray) -> np.ndarray:
    """Level of a count: 1, 2 and 3 exactly, then half octaves."""
    count = np.maximum(np.asarray(count, np.int64), 1)
    return np.where(count <= 3, count, np.floor(2 * np.log2(count) + 1e-9).astype(np.int64))


#: Mean of the counts of each level; a level's counts end where the next one's begin.
VALUE = np.concatenate(([0, 1, 2, 3], [(np.ceil(2 ** (q / 2)) + np.ceil(2 ** ((q + 1) / 2)) - 1) / 2 for q in range(4, 128)]))


def sequence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the tokens (words in lower case, then an end) of all texts, of the token before each, and the bounds per text."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, bounds = words(data, offsets)
    tokens = np.insert(hashes(prefix(data), start, end), bounds[1:], END)
    bounds = bounds + np.arange(len(bounds))
    before = np.concatenate(([START], tokens[:-1]))
    before[bounds[:-1]] = START
    return tokens, before, bounds


def pair_key(before: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(before * _PAIR + mix(token))


def training(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 1


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).select("doc_id", "text", training(F.col("doc_id")).alias("train"))


def counts(rows: DataFrame) -> DataFrame:
    """(size, key, n) of all words (size 1) and word pairs (2) of the training rows; tasks add up before the shuffle."""
    schema = arrow_schema(COUNTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def added() -> Iterator[dict]:
            for size, kept in enumerate(held, 1):
                if kept:
                    key, n = np.unique(np.concatenate(kept), return_counts=True)
                    kept.clear()
                    for at in range(0, len(key), 1 << 18):
                        part = slice(at, at + (1 << 18))
                        yield {"size": np.full(len(key[part]), size, np.int32), "key": key[part].view(np.int64), "n": n[part]}

        for batch in slices(batches, "text", SLICE):
            tokens, before, _ = sequence(batch.column("text"))
            held[0] += [tokens, before[before == START]]
            held[1].append(pair_key(before, tokens))
            if sum(map(len, held[0])) >= 1 << 22:
                yield from tables(added(), schema)
        yield from tables(added(), schema)

    return rows.where("train").mapInArrow(run, COUNTS).groupBy("size", "key").agg(F.sum("n").alias("n"))


def spark_level(n: Column) -> Column:
    return F.when(n <= 3, n).otherwise(F.floor(2 * F.log2(n.cast("double")) + 1e-9)).cast("int")


@dataclass
class Model:
    """What workers need: filter blocks or levels of the most frequent n-grams, exact counts of the most frequent words, totals, and the
    weights of pairs. ``start`` is the level of the token before a text."""

    bits: np.ndarray
    hot_keys: np.ndarray
    hot_counts: np.ndarray
    total: int
    distinct: int
    least_pair: int
    weights: np.ndarray
    head_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    head_levels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    start: int = 0

    def probe(self, key: np.ndarray) -> np.ndarray:
        """Level of each key, 0 if it isn't in the filter."""
        found = np.zeros(len(key), np.int64)
        if not len(self.bits):
            return found
        blocks = np.uint64(len(self.bits) // BLOCK_BYTES)
        at = np.arange(len(key))
        base = ((key >> np.uint64(20)) % blocks) * np.uint64(BLOCK_BYTES)
        one, two = probes(key)
        step = 0
        while len(at):
            done = step == FIRST or step > FIRST and (step - FIRST) % MORE == 0
            if done:
                found[at] += 1
                if found[at[0]] >= 100:
                    break
            place = (one + np.uint64(step) * two) & np.uint64(BLOCK_BYTES * 8 - 1)
            hit = ((self.bits[base + (place >> np.uint64(3))] >> (place & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            at, base, one, two = at[hit], base[hit], one[hit], two[hit]
            step += 1
        return found

    def pair_value(self, found: np.ndarray) -> np.ndarray:
        """Counts of pairs from their levels in the filter."""
        return np.where(found > 0, VALUE[found + level(self.least_pair) - 1], 0.0)

    def floor(self, count: np.ndarray) -> np.ndarray:
        return (count + 0.5) / (self.total + 0.5 * (self.distinct + 1))


def probes(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    one = mix(key + np.uint64(0x51ED270B))
    return one, (one >> np.uint64(32)) | np.uint64(1)


def places(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[pa.RecordBatch]:
    """``batches`` with the block of each key in front."""
    for batch in batches:
        key = batch.column("key").to_numpy().view(np.uint64)
        block = ((key >> np.uint64(20)) % np.uint64(blocks)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], names=["block", *batch.schema.names])


def blocks_of(sizes: dict[tuple[int, int], int]) -> int:
    """Blocks of a filter that half fills with all words and all pairs of ``LEAST_PAIR`` and more. ``sizes``: number of n-grams by (size, level)."""
    entered = sum(n * (FIRST + MORE * (q - 1 if s == 1 else q - LEAST_PAIR)) for (s, q), n in sizes.items() if s == 1 or q >= LEAST_PAIR)
    blocks = int(-(-entered / np.log(2) // (8 * BLOCK_BYTES)))
    if blocks >= 1 << 31:
        raise ValueError(f"{blocks} blocks are more than their number can count")
    return blocks


def build(counted: DataFrame, blocks: int) -> DataFrame:
    """(block, bits) of the filter."""
    depth = F.when(F.col("size") == 1, spark_level(F.col("n"))).otherwise(spark_level(F.col("n")) - (LEAST_PAIR - 1))
    entries = counted.select("key", depth.alias("depth")).where("depth >= 1")

    def fill(group: pa.Table) -> pa.Table:
        key, depth = group.column("key").to_numpy().view(np.uint64), group.column("depth").to_numpy().astype(np.int64)
        one, two = probes(key)
        bits = np.zeros(BLOCK_BYTES * 8, bool)
        need = FIRST + MORE * (depth - 1)
        for step in range(int(need.max())):
            on = need > step
            bits[(one[on] + np.uint64(step) * two[on]) & np.uint64(BLOCK_BYTES * 8 - 1)] = True
        return pa.table({"block": group.column("block")[:1], "bits": [np.packbits(bits, bitorder="little").tobytes()]}, schema=pa.schema([("block", pa.int32()), ("bits", pa.binary())]))

    return entries.mapInArrow(lambda batches: places(batches, blocks), "block int, key long, depth int").groupBy("block").applyInArrow(fill, "block int, bits binary")


def gathered(made: DataFrame, blocks: int) -> np.ndarray:
    """The blocks of a filter that is broadcast."""
    out = np.zeros(blocks * BLOCK_BYTES, np.uint8)
    for row in made.toLocalIterator(prefetchPartitions=True) if blocks else ():
        out[row["block"] * BLOCK_BYTES : (row["block"] + 1) * BLOCK_BYTES] = np.frombuffer(row["bits"], np.uint8)
    return out


ASKED = "chunk long, key long"


def answers(asked: DataFrame, made: DataFrame, blocks: int) -> DataFrame:
    """(chunk, key, level) of the n-grams (chunk, key) that are in the filter."""
    schema = arrow_schema(ASKED + ", level int")

    def probed(keys: pa.Table, block: pa.Table) -> pa.Table:
        if not (keys.num_rows and block.num_rows):
            return schema.empty_table()
        bits = np.frombuffer(block.column("bits")[0].as_py(), np.uint8)
        none = np.zeros(0)
        # One block: every key falls in it.
        found = Model(bits, none, none, 0, 0, LEAST_PAIR, none).probe(keys.column("key").to_numpy().view(np.uint64))
        at = pa.array(np.flatnonzero(found))
        return pa.table([keys.column("chunk").take(at), keys.column("key").take(at), pa.array(found[found > 0].astype(np.int32))], schema=schema)

    put = asked.mapInArrow(lambda batches: places(batches, blocks), "block int, " + ASKED)
    return put.groupBy("block").cogroup(made.groupBy("block")).applyInArrow(probed, ASKED + ", level int")


def looked_up(keys: np.ndarray, levels: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Levels of ``wanted`` by the sorted ``keys``, -1 where they are not among them."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, levels[at].astype(np.int64), -1)


RATIOS = 64


def ratio_bins(p_pair: np.ndarray, p_word: np.ndarray) -> np.ndarray:
    """Bin of p_pair / p_word: 0 for no pair, else a scale of half octaves around 1."""
    with np.errstate(divide="ignore"):
        log = np.where(p_pair > 0, 2 * np.log2(np.maximum(p_pair, 1e-300) / p_word), 0)
    return np.where(p_pair > 0, np.clip(np.round(log) + 16, 1, RATIOS - 1), 0).astype(np.int64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """Range of the count of the word before: four octaves each."""
    return np.minimum(level(np.maximum(context, 1)) // 8, 7)


LEVELS = "row long, doc_id long, train boolean, n_tokens long, known_hot long, base_hot double, word_levels binary, pair_levels binary, rare_keys array<long>, rare_n array<long>"


def measured(m: Model, batch: pa.RecordBatch, row: object, probe: Callable[[np.ndarray], np.ndarray]) -> dict:
    """Columns of ``LEVELS`` of a batch: the level of each token and of each pair that ends with it, and what the base score needs."""
    tokens, before, bounds = sequence(batch.column("text"))
    text, docs_here = owner(bounds), batch.num_rows
    codes, distinct = pd.factorize(tokens)
    place = np.minimum(np.searchsorted(m.hot_keys, distinct), max(len(m.hot_keys) - 1, 0))
    is_hot = m.hot_keys[place] == distinct if len(m.hot_keys) else np.zeros(len(distinct), bool)
    count = np.where(is_hot, m.hot_counts[place], 0) if len(m.hot_keys) else np.zeros(len(distinct))
    base = np.log10(m.floor(count))[codes]
    hot = is_hot[codes]
    # Tokens without a broadcast count, each with how often it stands in its text.
    rare = np.flatnonzero(~hot)
    one, n = np.unique(text[rare] * max(len(distinct), 1) + codes[rare], return_counts=True)
    of, code = np.divmod(one, max(len(distinct), 1))
    edge = np.searchsorted(of, np.arange(docs_here + 1)).astype(np.int32)

    def packed(levels: np.ndarray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), docs_here, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(levels.astype(np.uint8))])

    return {
        "row": row, "doc_id": batch.column("doc_id"), "train": batch.column("train"), "n_tokens": np.diff(bounds),
        "known_hot": np.bincount(text, hot, docs_here).astype(np.int64), "base_hot": np.bincount(text, np.where(hot, base, 0), docs_here),
        "word_levels": packed(probe(distinct)[codes]), "pair_levels": packed(probe(pair_key(before, tokens))),
        "rare_keys": pa.ListArray.from_arrays(edge, distinct[code].view(np.int64)), "rare_n": pa.ListArray.from_arrays(edge, n.astype(np.int64)),
    }


def near_levels(rows: DataFrame, model: Model) -> DataFrame:
    """``LEVELS`` of all rows, from a filter that is broadcast."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = arrow_schema(LEVELS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text", SLICE):
            yield from tables(iter([measured(m, batch, row + np.arange(batch.num_rows), m.probe)]), schema)
            row += batch.num_rows

    return rows.mapInArrow(run, LEVELS)


CHUNKS = "chunk long, row long, doc_id long, train boolean, text string"


def far_levels(rows: DataFrame, model: Model, made: DataFrame, blocks: int) -> DataFrame:
    """``LEVELS`` of all rows, from a filter that stays a table: chunks of texts ask for their n-grams outside the head."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = row = TaskContext.get().partitionId() << 36
        for batch in slices(batches, "text", CHUNK):
            n = batch.num_rows
            yield from tables(iter([{"chunk": np.full(n, chunk), "row": row + np.arange(n), **{c: batch.column(c) for c in ("doc_id", "train", "text")}}]), arrow_schema(CHUNKS))
            chunk, row = chunk + 1, row + n

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, "text", CHUNK):
            chunk = batch.column("chunk").to_numpy()
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(chunk)) + 1, [len(chunk)]))
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                tokens, before, _ = sequence(batch.column("text").slice(a, b - a))
                keys = np.unique(np.concatenate((tokens, pair_key(before, tokens))))
                keys = keys[looked_up(m.head_keys, m.head_levels, keys) < 0]
                yield from tables(iter([{"chunk": np.full(len(keys), chunk[a]), "key": keys.view(np.int64)}]), arrow_schema(ASKED))

    def measure(texts: pa.Table, found: pa.Table) -> pa.Table:
        m = shared.value
        keys, levels = found.column("key").to_numpy().view(np.uint64), found.column("level").to_numpy()
        order = np.argsort(keys)
        keys, levels = keys[order], levels[order]

        def probe(wanted: np.ndarray) -> np.ndarray:
            head = looked_up(m.head_keys, m.head_levels, wanted)
            return np.where(head >= 0, head, np.maximum(looked_up(keys, levels, wanted), 0))

        out = []
        for batch in slices(iter(texts.combine_chunks().to_batches()), "text", CHUNK):
            out += tables(iter([measured(m, batch, batch.column("row"), probe)]), arrow_schema(LEVELS))
        return pa.Table.from_batches(out, arrow_schema(LEVELS))

    chunks = stage(rows.mapInArrow(number, CHUNKS), "chunks")
    found = answers(chunks.select("chunk", "text").mapInArrow(ask, ASKED), made, blocks)
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(measure, LEVELS)


def unpacked(m: Model, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of all tokens, of the token before each, and of the pair, as the filter has them, and the bounds per text."""
    word, bounds = utf8(batch.column("word_levels"))
    pair, _ = utf8(batch.column("pair_levels"))
    before = np.concatenate((np.zeros(1, np.uint8), word[:-1]))
    before[bounds[:-1]] = m.start
    return VALUE[word], VALUE[before], m.pair_value(pair.astype(np.int64)), bounds


def fit_weights(measures: DataFrame, m: Model) -> np.ndarray:
    """Weights of pairs by range of the context's count. Training rows send how often each ratio of the two probabilities occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(8 * RATIOS, np.int64)
        for batch in slices(batches, "word_levels", SLICE // 2):
            c_word, c_before, pair, _ = unpacked(m, batch)
            pair = np.maximum(pair - 1, 0)
            p = np.where(c_before > 1, np.minimum(pair / np.maximum(c_before - 1, 1), 1), 0)
            seen += np.bincount(bucket_of(c_before) * RATIOS + ratio_bins(p, m.floor(np.maximum(c_word - 1, 0))), minlength=len(seen))
        at = np.flatnonzero(seen)
        yield from tables(iter([{"cell": at, "n": seen[at]}]), arrow_schema("cell long, n long"))

    cells = measures.where("train").select("word_levels", "pair_levels").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    grid = np.zeros((8, RATIOS))
    for c in cells:
        grid[c["cell"] // RATIOS, c["cell"] % RATIOS] = c["n"]
    ratio = np.where(np.arange(RATIOS) == 0, 0, 2.0 ** ((np.arange(RATIOS) - 16) / 2))
    weights = np.full(8, 0.1)
    for _ in range(60):
        share = weights[:, None] * ratio / (weights[:, None] * ratio + 1 - weights[:, None])
        weights = np.where(grid.sum(1) > 0, (grid * share).sum(1) / np.maximum(grid.sum(1), 1), weights)
        weights = np.clip(weights, 1e-6, 0.999)
    return weights


def fit(rows: DataFrame) -> tuple[Model, DataFrame, DataFrame]:
    """The model without what only finds levels, ``LEVELS`` of all rows, and the table of exact counts of words (key, n). Only counts per level,
    the hot words, and a small filter or the levels of the head reach the driver."""
    counted = stage(counts(rows).where("size = 1 or n > 1"), "ngrams")
    sizes, total = {}, 0
    for r in counted.groupBy("size", spark_level(F.col("n")).alias("q")).agg(F.count("*").alias("words"), F.sum("n").alias("tokens"), F.min("n").alias("least")).collect():
        sizes[r["size"], r["q"]] = r["words"]
        total += r["tokens"] if r["size"] == 1 else 0
    one = counted.where("size = 1")
    starts = one.where(F.col("key") == int(START.astype(np.int64))).select("n").collect()
    begun = starts[0]["n"] if starts else 0
    distinct = sum(n for (s, _), n in sizes.items() if s == 1) - (begun > 0)
    q, held = max((q for s, q in sizes if s == 1), default=0), 0
    while q >= 1 and held + sizes.get((1, q), 0) <= HOT_WORDS:
        held += sizes.get((1, q), 0)
        q -= 1
    hot = one.where(spark_level(F.col("n")) > q).select("key", "n").toArrow()
    keys, n = hot.column("key").to_numpy().view(np.uint64), hot.column("n").to_numpy()
    order = np.argsort(keys)
    blocks, start = blocks_of(sizes), int(START.astype(np.int64))
    made = build(counted, blocks)
    model = Model(np.zeros(0, np.uint8), keys[order], n[order], total - begun, distinct, LEAST_PAIR, np.full(8, 0.1))
    if blocks * BLOCK_BYTES <= FILTER_BYTES:
        model.bits = gathered(made, blocks)
        model.start = int(model.probe(np.array([START]))[0])
        measures = stage(near_levels(rows, model), "levels")
    else:
        made = stage(made, "filter")
        q, held = max(q for _, q in sizes), 0
        while q >= 1 and held + sizes.get((1, q), 0) + sizes.get((2, q), 0) <= HEAD:
            held += sizes.get((1, q), 0) + sizes.get((2, q), 0)
            q -= 1
        head = counted.where((spark_level(F.col("n")) > q) | (F.col("size") == 1) & (F.col("key") == start))
        got = answers(head.select(F.lit(0).cast("long").alias("chunk"), "key"), made, blocks).select("key", "level").toArrow()
        head_keys, head_levels = got.column("key").to_numpy().view(np.uint64), got.column("level").to_numpy()
        order = np.argsort(head_keys)
        model.head_keys, model.head_levels = head_keys[order], head_levels[order].astype(np.uint8)
        model.start = max(int(looked_up(model.head_keys, model.head_levels, np.array([START]))[0]), 0)
        measures = stage(far_levels(rows, model, made, blocks), "levels")
    none = np.zeros(0, np.uint64)
    model = replace(model, bits=none.astype(np.uint8), hot_keys=none, hot_counts=none, head_keys=none, head_levels=none)
    model.weights = fit_weights(measures, model)
    return model, measures, one.where(F.col("key") != start).select("key", "n")


SCORED = "row long, doc_id long, train boolean, n_tokens long, known_hot long, base_hot double, score double"


def score(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    model, measures, exact = fit(_rows(docs))
    schema = arrow_schema(SCORED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "word_levels", SLICE // 2):
            word, context, pair, bounds = unpacked(model, batch)
            weight = model.weights[bucket_of(context)]
            p = weight * np.minimum(pair / np.maximum(context, 1), 1) + (1 - weight) * model.floor(word)
            kept = {c: batch.column(c) for c in ("row", "doc_id", "train", "n_tokens", "known_hot", "base_hot")}
            yield from tables(iter([kept | {"score": np.bincount(owner(bounds), np.log10(p), batch.num_rows)}]), schema)

    scored = measures.drop("rare_keys", "rare_n").mapInArrow(run, SCORED)
    rare = measures.select("row", F.explode(F.arrays_zip("rare_keys", "rare_n")).alias("t")).select("row", F.col("t.rare_keys").alias("key"), F.col("t.rare_n").alias("m"))
    log = F.log10((F.col("n") + 0.5) / F.lit(model.total + 0.5 * (model.distinct + 1)))
    found = rare.join(exact, "key").groupBy("row").agg(F.sum("m").alias("known"), F.sum(F.col("m") * log).alias("base"))
    none = F.lit(float(np.log10(model.floor(np.zeros(1)))[0]))
    known = F.coalesce("known", F.lit(0))
    rest = F.col("n_tokens") - F.col("known_hot") - known
    return scored.join(found, "row", "left").select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("known_hot") + known).alias("n_known"), F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_hot") + F.coalesce("base", F.lit(0.0)) + rest * none).alias("base_score"), "score",
    )
