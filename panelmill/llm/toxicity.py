"""Operator 5: toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is the bag of its words and of their character n-grams (3 to 5, with word borders), hashed into buckets; a word that stands n times
weighs log2(1 + n), and PAD neutral subwords are added, so that very short or monotonous texts stay near the prior. Each bucket has an
embedding; their weighted mean over the text, times a fixed gain, goes into a softmax of two classes. Embeddings and softmax are trained together by
Adam on a bounded sample of labelled documents, so misspelled words share the vectors of the n-grams they keep. After training each
bucket's part of the score is one number, which scores every whole text in one pass.

Defined cases: a null text is empty; a text without words gets the prior of the labels; several labels of one document count as toxic if
one is; null labels are ignored; without labels of both classes the score is the labelled share of toxic documents, or 0; rows are scored
one by one whatever their doc_id; empty tables give no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from panelmill.llm.text import LOWER, arrow_schema, hashes, owner, prefix, release, slices, tables, utf8

BITS = 18
BUCKETS = 1 << BITS
GRAMS = (3, 4, 5)
PAD = 100.0
#: Bytes that part words: white space and ASCII marks other than those that stand for letters.
BREAK = np.zeros(256, bool)
BREAK[:33] = True
BREAK[list(b".,;:!?\"'()[]{}|/\\<>=+~`^#%&-_")] = True


@dataclass(frozen=True)
class Plan:
    """Bounds and settings of the training: at most ``toxic`` and ``clean`` documents of the two classes are learnt from."""

    toxic: int = 3000
    clean: int = 6000
    dim: int = 8
    gain: float = 40.0
    epochs: int = 8
    batch: int = 128
    rate: float = 0.03
    decay: float = 0.05
    seed: int = 7


def bag(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of a batch and their subwords: (bucket of each subword, bounds per distinct word), with each text's words as
    (word code, bounds per text)."""
    data, offsets = utf8(column)
    data = LOWER[data]
    lead = (data & 0xC0) != 0x80
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.concatenate(([0], np.cumsum(lead)))[offsets]
    solid = ~BREAK[np.minimum(cp, 255)] | (cp > 127)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = at[(at > 0) & (at < len(cp))]
    first[inner], last[inner - 1] = solid[inner], solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    bounds = np.searchsorted(start, at)
    codes, distinct = pd.factorize(hashes(prefix(cp), start, end))
    where = np.full(len(distinct), -1, np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    # The distinct words side by side, each between two border marks.
    size = end[where] - start[where] + 2
    edge = np.concatenate(([0], np.cumsum(size)))
    text = np.full(edge[-1], 1, np.uint32)
    body = np.arange(edge[-1]) - np.repeat(edge[:-1], size)
    middle = (body > 0) & (body < np.repeat(size, size) - 1)
    text[middle] = cp[(np.repeat(start[where], size) + body - 1)[middle]]
    sums = prefix(text)
    word = np.arange(len(distinct))
    buckets, of = [hashes(sums, edge[:-1], edge[1:]) >> np.uint64(64 - BITS)], [word]
    for n in GRAMS:
        grams = np.maximum(size - n + 1, 0) * (size > n)
        begin = np.repeat(edge[:-1], grams) + np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
        buckets.append(hashes(sums, begin, begin + n) >> np.uint64(64 - BITS))
        of.append(np.repeat(word, grams))
    buckets, of = np.concatenate(buckets).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return buckets[order], np.searchsorted(of[order], np.arange(len(distinct) + 1)), codes, bounds


def features(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(doc_id, toxic, buckets, weights): each text as the mean of its subwords, one entry per distinct bucket (at most BUCKETS of them)."""
    for batch in slices(batches, "text"):
        buckets, edge, codes, bounds = bag(batch.column("text"))
        for k, (doc_id, toxic) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("toxic").to_pylist())):
            word, count = np.unique(codes[bounds[k] : bounds[k + 1]], return_counts=True)
            size = edge[word + 1] - edge[word]
            place = np.repeat(edge[word], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            found, inverse = np.unique(buckets[place], return_inverse=True)
            weight = np.bincount(inverse, np.repeat(np.log2(1 + count), size), len(found))
            yield doc_id, toxic, found.astype(np.int32), (weight / (weight.sum() + PAD)).astype(np.float32)


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], prior: float, plan: Plan) -> tuple[np.ndarray, float]:
    """Joint training of embeddings, softmax and bias: (score of each bucket, bias), in log-odds of class 1 at the share ``prior``.

    ``rows`` are used up: each goes as soon as its batch stands, so that no entry is held twice.
    """
    rng = np.random.default_rng(plan.seed)
    y = np.array([r[0] for r in rows])
    batches = []
    order = rng.permutation(len(rows))
    for at in range(0, len(order), plan.batch):
        picked = order[at : at + plan.batch].tolist()
        part = [rows[i] for i in picked]
        for i in picked:
            rows[i] = None
        size = np.array([len(r[1]) for r in part])
        used, place = np.unique(np.concatenate([r[1] for r in part]), return_inverse=True)
        weight = np.concatenate([r[2] for r in part]) * np.float32(plan.gain)
        batches.append((y[picked], used, place.astype(np.int32), size, weight))
        if len(batches) % 8 == 0:
            del part, place
            release()
    emb = np.zeros((BUCKETS, plan.dim), np.float32)
    seen = np.unique(np.concatenate([b[1] for b in batches]))
    emb[seen] = rng.normal(0, 0.05, (len(seen), plan.dim))
    out = np.zeros((plan.dim, 2), np.float32)
    out[0] = (-0.5, 0.5)
    bias = np.zeros(2, np.float32)
    dense = [(out, np.zeros_like(out), np.zeros_like(out)), (bias, np.zeros_like(bias), np.zeros_like(bias))]
    m1, m2 = np.zeros_like(emb), np.zeros_like(emb)
    step = 0
    for epoch in range(plan.epochs):
        rate = plan.rate * (1 - epoch / plan.epochs)
        for k in rng.permutation(len(batches)).tolist():
            truth, used, place, size, weight = batches[k]
            rows_in, here = len(truth), emb[used]
            doc = np.repeat(np.arange(rows_in, dtype=np.int32), size)
            mean = np.stack([np.bincount(doc, weight * column[place], rows_in) for column in np.ascontiguousarray(here.T)], 1)
            logit = mean @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(rows_in), truth] -= 1
            p /= rows_in
            back = (p @ out.T).astype(np.float32)
            grad = np.stack([np.bincount(place, weight * column[doc], len(used)) for column in np.ascontiguousarray(back.T)], 1)
            step += 1
            fix = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for (value, first, second), g in zip(dense, (mean.T @ p, p.sum(0))):
                first += 0.1 * (g - first)
                second += 0.001 * (g * g - second)
                value -= rate * fix * first / (np.sqrt(second) + 1e-8)
            f = m1[used] = m1[used] + 0.1 * (grad - m1[used])
            s = m2[used] = m2[used] + 0.001 * (grad * grad - m2[used])
            emb[used] = here * (1 - rate * plan.decay) - rate * fix * f / (np.sqrt(s) + 1e-8)
    direction = out[:, 1] - out[:, 0]
    sampled = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    shift = np.log(prior / (1 - prior)) - np.log(sampled / (1 - sampled))
    return (plan.gain * emb @ direction).astype(np.float32), float(bias[1] - bias[0] + shift)


def learning_rows(doc_id: Column) -> Column:
    """Rows whose labels may be learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 != 0


def fit(docs: DataFrame, labels: DataFrame, plan: Plan) -> tuple[np.ndarray, float]:
    """Fit on the labelled documents of the learning rows, those first in a hash order of doc_id, ``plan.toxic`` and
    ``plan.clean`` at most.

    The ids of the sample are broadcast (a number each). One task trains, on as many rows of at most BUCKETS entries, and returns
    one number per bucket.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    marked = marked.where(learning_rows(F.col("doc_id")))
    count = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    total = sum(count.values())
    if len(count) < 2:
        share = 1 - 1e-6 if count.get(1) else 1e-6
        return np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    prior = count[1] / total
    chosen = [r for c, most in ((0, plan.clean), (1, plan.toxic)) for r in marked.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()]
    ids = spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id")
    # A doc_id that many rows share counts once, by its first text; so the sample stays bounded.
    once = texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "toxic", "text")
    out = "score binary, bias double"

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted(features(batches), key=lambda r: r[0])
        if got:
            rows = [r[1:] for r in got]
            got.clear()
            score, bias = train(rows, prior, plan)
            yield from tables(iter([{"score": [score.tobytes()], "bias": [bias]}]), arrow_schema(out))
        release()

    # texts go to the one task, not their entries, of which there are some eight bytes for a byte of text
    model = once.coalesce(1).mapInArrow(learn, out).collect()
    if not model:
        return np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior)))
    return np.frombuffer(model[0]["score"], np.float32), model[0]["bias"]


def score_batch(column: pa.Array, value: np.ndarray, bias: float) -> np.ndarray:
    """Probability of class 1 of each text, from the model's number per bucket."""
    buckets, edge, codes, bounds = bag(column)
    total = np.concatenate(([0.0], np.cumsum(value[buckets])))
    word = total[edge[1:]] - total[edge[:-1]]
    pair, count = np.unique(owner(bounds) * max(len(word), 1) + codes, return_counts=True)
    text, code = np.divmod(pair, max(len(word), 1))
    weigh = np.log2(1 + count)
    mean = np.bincount(text, weigh * word[code], len(column)) / (np.bincount(text, weigh * np.diff(edge)[code], len(column)) + PAD)
    return 1 / (1 + np.exp(-np.clip(mean + bias, -40, 40)))


def scores(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted. The model (BUCKETS numbers) is broadcast; texts are not shuffled."""
    weight, bias = fit(docs, labels, plan)
    model = docs.sparkSession.sparkContext.broadcast(weight)
    out = "doc_id long, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value.astype(np.float64)
        for batch in slices(batches, "text"):
            yield from tables(iter([{"doc_id": batch.column("doc_id"), "score": score_batch(batch.column("text"), value, bias)}]), arrow_schema(out))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, out)
    return rows.select("doc_id", (~learning_rows(F.col("doc_id"))).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""
    weight, bias = fit(docs, labels, plan)
    model = docs.sparkSession.sparkContext.broadcast(weight)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = model.value.astype(np.float64)
        for batch in slices(batches, "text"):
            yield batch.select(["row"]).filter(pa.array(score_batch(batch.column("text"), value, bias) < 0.5))

    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").cast("string").alias("text"))
    return packed.mapInArrow(run, StructType([StructField("row", docs.schema)])).select("row.*")
