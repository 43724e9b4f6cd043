"""Operator 7: vector best-fit packing of token pieces into sequences under token, document-count and attention-cost capacities.

A document is its ids and an end id; only documents longer than a sequence are cut, the first piece taking what does not fill a whole one.
Pieces are dealt out evenly, without a key, into pools of the size that Spark's adaptive execution gives a partition, and each pool is
packed by itself, largest pieces first: a piece goes to the open sequence that holds it under every capacity with the smallest weighted
residual norm (or the largest weighted dot product of piece and residual), and to a new sequence if there is none.

Defined cases: a null text is empty and packs as the end id alone; a null doc_id stays null; rows that share a doc_id, or are equal, are
packed one by one; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.text import arrow_schema, slices, tables
from panelmill.llm.tokens import Encoder, with_end

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"
#: Pieces a task packs at once; a pool is a partition, cut further only beyond this.
POOL = 1 << 19


def pieces(docs: DataFrame, tokenizer: str, end: int, size: int) -> DataFrame:
    """All pieces of all documents: (doc_id, piece, start, length, ids_crc32)."""
    schema = arrow_schema(PIECES)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(tokenizer)
        for batch in slices(batches, "text", 2 << 20):
            ids, bounds = with_end(*encoder.encode(batch.column("text")), end)
            total = np.diff(bounds)
            count = -(-total // size)
            row = np.repeat(np.arange(len(total)), count)
            number = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            first = (total - (count - 1) * size)[row]
            start = np.where(number == 0, 0, first + (number - 1) * size)
            length = np.where(number == 0, first, size)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = bounds[row] + start
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            yield from tables(iter([{"doc_id": batch.column("doc_id").take(pa.array(row)), "piece": number, "start": start, "length": length, "ids_crc32": crc}]), schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def best_fit(length: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float], rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece; the pieces' needs are (length, 1, length squared).

    Open sequences stand in classes by residual tokens, each a heap by the weighted norm of its other residuals. Where a class's first
    sequence lacks documents or attention cost for the piece, the rest of the class is looked through.
    """
    size, docs, cost = capacity
    scale = np.array(weights, float) / np.array([size, docs, max(cost, 1)], float) ** (2 if rule == "norm" else 1)
    heaps: list[list[tuple[float, int, int, int]]] = [[] for _ in range(size + 1)]
    head = np.full((size + 1, 2), -1.0)
    bins, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
    opened = 0
    tokens = np.arange(size + 1, dtype=float)
    sign = 1.0 if rule == "norm" else -1.0

    def show(r: int) -> None:
        head[r] = heaps[r][0][1:3] if heaps[r] else (-1.0, -1.0)

    for i in np.argsort(-length, kind="stable").tolist():
        n = int(length[i])
        need = n * n
        if n > size or docs < 1 or need > cost:
            raise ValueError(f"a piece of {n} tokens exceeds an empty sequence")
        d, c = head[n:, 0], head[n:, 1]
        if rule == "norm":
            score = scale[0] * (tokens[n:] - n) ** 2 + scale[1] * (d - 1) ** 2 + scale[2] * (c - need) ** 2
        else:
            score = -(scale[0] * tokens[n:] * n + scale[1] * d + scale[2] * c * need)
        fits = (d >= 1) & (c >= need)
        r, chosen = -1, None
        if fits.any():
            r = n + int(np.argmin(np.where(fits, score, np.inf)))
            chosen = heapq.heappop(heaps[r])
        else:
            for k in np.flatnonzero(d >= 0).tolist():
                inner = [x for x in heaps[n + k] if x[1] >= 1 and x[2] >= need]
                if inner:
                    r, chosen = n + k, min(inner)
                    heaps[r].remove(chosen)
                    heapq.heapify(heaps[r])
                    break
        if chosen is None:
            chosen, r = (0.0, docs, cost, opened), size
            opened += 1
        else:
            show(r)
        _, left, spare, number = chosen
        bins[i], offset[i] = number, size - r
        left, spare, r = left - 1, spare - need, r - n
        heapq.heappush(heaps[r], (sign * (scale[1] * left**2 + scale[2] * float(spare) ** 2), left, spare, number))
        show(r)
    return bins, offset


def pack(rows: DataFrame, size: int, docs: int, cost: int, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> DataFrame:
    """Place ``rows`` (PIECES) in sequences: adds sequence_id and offset. ``size``, ``docs`` and ``cost`` bound each sequence."""
    schema = arrow_schema(PLACED)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 36
        held: list[pa.RecordBatch] = []
        count = 0

        def packed() -> pa.Table:
            nonlocal base
            pool = pa.Table.from_batches(held)
            bins, offset = best_fit(pool.column("length").to_numpy(), (size, docs, cost), weights, rule)
            base += int(bins.max()) + 1
            return pool.append_column("sequence_id", pa.array(bins + (base - int(bins.max()) - 1))).append_column("offset", pa.array(offset))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= POOL:
                yield from packed().cast(schema).to_batches()
                held, count = [], 0
        if held:
            yield from packed().cast(schema).to_batches()

    return rows.hint("rebalance").mapInArrow(place, PLACED)


def pack_documents(docs: DataFrame, tokenizer: str, end: int = 0, size: int = 2048, most_docs: int | None = None, cost: int | None = None, weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3), rule: str = "norm") -> DataFrame:
    """Pack all ``docs`` (doc_id, text). By default a sequence may hold as many documents and as much attention cost as its tokens allow."""
    return pack(pieces(docs, tokenizer, end, size), size, most_docs or size, cost or size * size, weights, rule)
