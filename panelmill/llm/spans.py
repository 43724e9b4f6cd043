"""Operator 2: removal of repeated passages by hashes of sliding runs of consecutive sentences.

A sentence ends behind . ! ? or … and white space, or at a line break; its words are compared in lower case. From every sentence one span
runs on to the first sentence with which it has ``SENTENCES`` sentences and ``WORDS`` words. The hashes of all spans of all documents meet
in one aggregation that finds, of each repeated span, the first place (smallest doc_id, then smallest digest of the text, then position);
sentences that any other place of a repeated span covers are removed. The rest of the text stays as it is, byte for byte.

A hash that many documents share is summed up within tasks before it is shuffled. First places are written, then joined with all places, a
join that Spark may split; nothing gathers the places of a hash, and a text meets its own cuts only, by doc_id and digest.

Defined cases: a null text stays null, an empty one empty, and neither has spans; texts of fewer sentences or words than a span have none;
a text all of whose sentences are removed becomes empty; equal rows (same doc_id and text) count as one document and keep or lose the same
sentences; null doc_ids come first; an empty table gives no rows; ``clean`` keeps all columns, ``removed`` reads doc_id and text only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from panelmill.llm.storage import stage
from panelmill.llm.text import LOWER, SPACE, arrow_schema, hashes, mix, owner, prefix, slices, tables, utf8, words

SENTENCES, WORDS = 2, 12
STOP = np.zeros(256, bool)
STOP[list(b".!?")] = True
PLACES = "doc_id long, digest long, span long, pos int, reach int"


def split(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences of all texts as byte ranges that tile them: (data, offsets, starts, bounds per text, words of each, hash of its words)."""
    data, offsets = utf8(column)
    stop = STOP[data]
    if len(data) > 2:
        stop[2:] |= (data[:-2] == 0xE2) & (data[1:-1] == 0x80) & (data[2:] == 0xA6)
    blank = SPACE[data]
    # A sentence begins behind the white space that follows a stop or holds a line break.
    begin = np.zeros(len(data) + 1, bool)
    run = np.flatnonzero(blank & ~np.append(False, blank[:-1]))
    end = np.flatnonzero(blank & ~np.append(blank[1:], False)) + 1
    if len(run):
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        cuts = (breaks[end] > breaks[run]) | ((run > 0) & stop[np.maximum(run - 1, 0)])
        begin[end[cuts]] = True
    begin[offsets] = True
    start = np.flatnonzero(begin[:-1])
    bounds = np.searchsorted(start, offsets)
    ends = np.append(start[1:], len(data)) if len(start) else start
    low = LOWER[data]
    w_start, w_end, _ = words(low, np.unique(np.append(start, len(data)))) if len(data) else (start, start, None)
    first = np.searchsorted(w_start, start)
    last = np.searchsorted(w_start, ends)
    sums = prefix(hashes(prefix(low), w_start, w_end))
    return data, offsets, start, bounds, last - first, hashes(sums, first, last)


def spans(count: np.ndarray, sentence: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first sentence, last sentence + 1) of the span that starts at each sentence with words, where the text is long enough for one."""
    text = owner(bounds)
    total = np.concatenate(([0], np.cumsum(count)))
    filled = np.concatenate(([0], np.cumsum(count > 0)))
    first = np.flatnonzero(count > 0)
    reach = np.maximum(np.searchsorted(total, total[first] + WORDS, "left"), np.searchsorted(filled, filled[first] + SENTENCES, "left"))
    inside = reach <= bounds[1:][text[first]]
    return text[first][inside], first[inside], reach[inside]


def places(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, span, pos, reach): every span of every document, pos and reach counted in the text's sentences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            _, _, _, bounds, count, sentence = split(batch.column("text"))
            text, first, reach = spans(count, sentence, bounds)
            # Empty sentences add nothing to the hash, so that line breaks within a passage don't matter.
            sums = prefix(sentence[count > 0])
            rank = np.concatenate(([0], np.cumsum(count > 0)))
            key = mix(hashes(sums, rank[first], rank[reach]))
            yield from tables(
                iter([{
                    "doc_id": batch.column("doc_id").take(pa.array(text)), "digest": batch.column("digest").take(pa.array(text)), "span": key.view(np.int64),
                    "pos": first - bounds[text], "reach": reach - bounds[text],
                }]), arrow_schema(PLACES))

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("digest")).mapInArrow(run, PLACES)


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, cut): per document that loses sentences, the ranges of sentences [pos, reach) that go."""
    found = places(docs)
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "digest", "pos")
    # The end of the ordering, too: a span whose first and last place are equal occurs once.
    first = found.groupBy("span").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first <> last").select("span", "first")
    first = stage(first, "first-places")  # a join of two shuffles, of which Spark can split the places of a common span
    again = found.join(first, "span").where(place != F.col("first"))
    return again.groupBy("doc_id", "digest").agg(F.collect_set(F.struct("pos", "reach")).alias("cut"))


def clean(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, text without its repeated passages, plus n_sentences and n_removed in a struct ``spans_found``."""
    schema = docs.schema
    text = F.col("text").cast("string")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("of"))
    cuts = removed(docs).select(F.col("doc_id").alias("cut_id"), "digest", "cut")
    joined = packed.join(cuts, (F.col("of") == F.col("digest")) & F.col("id").eqNullSafe(F.col("cut_id")), "left").select("row", "text", "cut")
    out = StructType([StructField("row", schema), StructField("kept", StringType()), StructField("n_sentences", LongType()), StructField("gone", ArrayType(IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            data, offsets, start, bounds, _, _ = split(batch.column("text"))
            stop = np.zeros(len(start) + 1, np.int64)
            lists = batch.column("cut")
            cut = lists.flatten()
            owners = np.repeat(bounds[:-1], np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            np.add.at(stop, owners + np.asarray(cut.field("pos")), 1)
            np.add.at(stop, owners + np.asarray(cut.field("reach")), -1)
            gone = np.cumsum(stop[:-1]) > 0
            ends = np.append(start[1:], len(data)) if len(start) else start
            stay = np.repeat(~gone, ends - start)
            size = np.concatenate(([0], np.cumsum(stay)))[offsets].astype(np.int32)
            text = pa.Array.from_buffers(pa.string(), batch.num_rows, [None, pa.py_buffer(size), pa.py_buffer(data[stay].tobytes())])
            text = pc.if_else(batch.column("text").is_valid(), text, pa.scalar(None, pa.string()))
            at = np.flatnonzero(gone)
            edge = np.searchsorted(at, bounds).astype(np.int32)
            numbers = pa.ListArray.from_arrays(edge, (at - bounds[:-1][owner(bounds)][at]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("row"), text, pa.array(np.diff(bounds)), numbers], names=["row", "kept", "n_sentences", "gone"])

    return joined.mapInArrow(run, out)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_sentences, n_removed, removed (numbers of the removed sentences) and the remaining text."""
    rows = clean(docs.select("doc_id", "text"))
    return rows.select(F.col("row.doc_id").cast("long").alias("doc_id"), "n_sentences", F.size("gone").cast("long").alias("n_removed"), F.col("gone").alias("removed"), F.col("kept").alias("text"))


def cleaned(docs: DataFrame) -> DataFrame:
    """``docs`` with the same columns and rows; text has lost its repeated passages, n_chars (if there) counts what is left."""
    out = {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return clean(docs).select(*[(out[c] if c in out else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
