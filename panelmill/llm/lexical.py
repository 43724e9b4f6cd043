"""Operator 13: ranked lexical search by scanning documents with an Aho-Corasick automaton of all items' terms.

The terms of all items, each between two spaces, make one automaton. A text is lower-cased (A-Z only), every character that is not of a term
becomes a space, and the automaton runs over it once: the guards let it find whole terms only, and two neighbours share the space between
them. Its outputs are numbers of terms, which map to the items that have them. Texts are scanned twice, no index of them is kept: once for
the statistics (documents, terms, and documents that hold each term), once for scores, of which a task keeps the ``k`` best of each item.
The tasks' best meet in two steps, first in many groups an item, then in one.

Items go to the workers in groups of at most ``TERMS`` terms (an item with more is a group by itself), one pair of scans for each group; so
what is sent is bounded by TERMS and the length of an item's text, whatever the number of items.

Defined cases: a null or empty text has no terms and is no document of the statistics; an item without terms gets no rows; equal items are
ranked one by one, each under its item_id, rows that share an item_id by their own text with ranks of their own; rows that share a doc_id are
documents of their own, of equal score and doc_id they stand side by side; null doc_ids come last among equal scores; empty tables give no
rows; further columns are not read.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.storage import stage
from panelmill.llm.text import arrow_schema, owner, slices, tables, utf8, words

#: Most terms of a group of items.
TERMS = 1 << 18
#: Gains of items summed at once.
STEP = 1 << 20
#: Groups an item's candidates are ranked in before they meet.
DEALS = 64
#: Characters of a term: all but the ASCII ones that are no letters or digits.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STATS = "term int, holds long, terms long"
BEST = "item int, doc_id long, score long"

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[c for c in range(128) if not (chr(c).isalnum())]] = 32
_GAP = np.zeros(256, bool)
_GAP[32] = True


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): distinct terms of each item's text; ``item`` numbers the items that have terms."""
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), UPPER, LOWER)
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), F.array_distinct(F.regexp_extract_all(low, F.lit(TERM), 0)).alias("terms")).where("size(terms) > 0")
    return stage(rows.select(F.monotonically_increasing_id().alias("item"), "*"), "items")


def groups(items: DataFrame) -> Iterator[list]:
    """Rows of ``items`` in groups of at most TERMS terms, one at a time."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row.terms) > TERMS:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.terms)
    if held:
        yield held


class Terms:
    """Automaton of a group's terms, and the documents' terms that it finds."""

    _known: dict[str, Terms] = {}

    def __init__(self, names: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for number, name in enumerate(names):
            self.automaton.add_word(f" {name} ", number)
        self.automaton.make_automaton()

    @classmethod
    def of(cls, names: Broadcast) -> Terms:
        """The automaton of a broadcast (name of the group, terms); a worker keeps one."""
        group, terms = names.value
        if group not in cls._known:
            cls._known.clear()
            cls._known[group] = cls(terms)
        return cls._known[group]

    def counts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of all terms of each text, and its own terms that the automaton knows: (sizes, text, term, times)."""
        data, offsets = utf8(column)
        # A space stands before each text and at the end, so that no term spans two texts.
        folded = np.insert(_FOLD[data], offsets, 32)
        starts = offsets + np.arange(len(offsets))
        _, _, bounds = words(folded, starts, _GAP)
        found = np.fromiter(itertools.chain.from_iterable(self.automaton.iter(folded.tobytes().decode())), np.int64).reshape(-1, 2)
        # The automaton counts characters: those that begin before a text's first byte.
        first = np.concatenate(([0], np.cumsum((folded & 0xC0) != 0x80)))[starts]
        text = np.searchsorted(first, found[:, 0] - 1, "right") - 1
        key, times = np.unique(text * len(self.automaton) + found[:, 1], return_counts=True)
        return np.diff(bounds), key // len(self.automaton), key % len(self.automaton), times


def statistics(texts: DataFrame, names: Broadcast) -> DataFrame:
    """(term, holds, terms), summed within tasks: documents that hold a term; under -1, documents with terms and number of their terms."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms.of(names)
        holds = np.zeros(len(known.automaton), np.int64)
        filled = total = 0
        for batch in slices(batches, "text"):
            size, _, term, _ = known.counts(batch.column("text"))
            holds += np.bincount(term, minlength=len(holds))
            filled, total = filled + int((size > 0).sum()), total + int(size.sum())
        at = np.flatnonzero(holds)
        yield from tables(iter([{"term": np.append(at, -1), "holds": np.append(holds[at], filled), "terms": np.append(np.zeros(len(at), np.int64), total)}]), arrow_schema(STATS))

    return texts.select("text").mapInArrow(scan, STATS).groupBy("term").agg(F.sum("holds").alias("holds"), F.sum("terms").alias("terms"))


def summed(text: np.ndarray, term: np.ndarray, gain: np.ndarray, bounds: np.ndarray, items: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, item, score above 0) from the gains of the terms of texts, which are in order of the text; term t is in items[bounds[t]:bounds[t + 1]]."""
    out = [[np.zeros(0, np.int64)] * 3]
    each = np.diff(bounds)[term]
    ends = np.cumsum(each)
    at = 0
    while at < len(text):
        # Texts with STEP gains of items together, one text at least.
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, "right"))
        to = int(np.searchsorted(text, text[min(to, len(text) - 1)])) if to < len(text) else to
        to = to if to > at else int(np.searchsorted(text, text[at], "right"))
        n = each[at:to]
        place = np.arange(n.sum()) + np.repeat(bounds[term[at:to]] - np.cumsum(n) + n, n)
        key = np.repeat(text[at:to] - text[at], n) * number + items[place]
        cells = int(text[to - 1] - text[at] + 1) * number
        if cells > 4 * len(key):
            found, key = np.unique(key, return_inverse=True)
        else:
            found = np.arange(cells)
        score = np.zeros(len(found), np.int64)
        np.add.at(score, key, np.repeat(gain[at:to], n))
        found, score = found[score > 0], score[score > 0]
        out.append([found // number + text[at], found % number, score])
        at = to
    return tuple(map(np.concatenate, zip(*out)))


def best(item: np.ndarray, score: np.ndarray, doc_id: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each item: highest scores first, then smallest doc_ids, nulls last."""
    order = np.lexsort((doc_id, ~known, -score, item))
    begins = np.flatnonzero(np.concatenate(([True], np.diff(item[order]) != 0))) if len(order) else order
    return order[np.arange(len(order)) - np.repeat(begins, np.diff(np.append(begins, len(order)))) < k]


def scored(texts: DataFrame, names: Broadcast, postings: Broadcast, k: int) -> DataFrame:
    """(item, doc_id, score): each task's ``k`` best documents of each item. ``postings``: bounds, items and number of items, weights, N and L."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms.of(names)
        bounds, items, number, weight, n_docs, n_terms = postings.value
        kept = [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]  # item, score, doc_id, whether doc_id is known
        for batch in slices(batches, "text"):
            size, text, term, times = known.counts(batch.column("text"))
            damp = 10 + (90 * size[text] * n_docs) // n_terms
            gain = weight[term] * ((1_000_000_000 * times) // (1000 * times + 8 * damp))
            docs, item, score = summed(text, term, gain, bounds, items, number)
            ids = batch.column("doc_id")
            new = [item, score, np.asarray(ids.fill_null(0))[docs], np.asarray(ids.is_valid())[docs]]
            kept = [np.concatenate(pair) for pair in zip(kept, new)]
            top = best(kept[0], kept[1], kept[2], kept[3], k)
            kept = [c[top] for c in kept]
        yield from tables(iter([{"item": kept[0], "doc_id": pa.array(kept[2], mask=~kept[3]), "score": kept[1]}]), arrow_schema(BEST))

    return texts.mapInArrow(scan, BEST)


def top(rows: DataFrame, keys: list[str | Column], k: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """The ``k`` best documents (doc_id, text) of each item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for group in groups(item_terms(items)):
        names = sorted({t for row in group for t in row.terms})
        number = {t: i for i, t in enumerate(names)}
        of_item = np.repeat(np.arange(len(group)), [len(row.terms) for row in group])
        of_term = np.array([number[t] for row in group for t in row.terms], np.int64)
        postings = of_item[np.argsort(of_term, kind="stable")]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(of_term, minlength=len(names)))))
        sent = spark.sparkContext.broadcast((uuid.uuid4().hex, names))
        found = {r.term: r for r in statistics(texts, sent).collect()}  # one row a term of the group
        n_docs, n_terms = found[-1].holds, found[-1].terms
        if not n_docs:
            continue
        holds = [found[i].holds if i in found else 0 for i in range(len(names))]
        weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in holds], np.int64)
        rows = scored(texts, sent, spark.sparkContext.broadcast((bounds, postings, len(group), weight, n_docs, n_terms)), k)
        rows = top(top(rows.withColumn("deal", F.spark_partition_id() % DEALS), ["item", "deal"], k).drop("rank"), ["item"], k)
        ids = spark.createDataFrame([(i, row.item_id) for i, row in enumerate(group)], "item int, item_id long")
        out = out.unionByName(rows.join(ids, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def sql(documents: str = "documents", benchmark: str = "benchmark", k: int = 10) -> str:
    """The rows of ``search`` as SQL for DuckDB."""
    terms = lambda text: f"regexp_extract_all(translate(coalesce({text}, ''), '{UPPER}', '{LOWER}'), '{TERM}')"
    return f"""WITH found AS (SELECT row_number() OVER () AS line, doc_id, {terms('text')} AS terms FROM {documents}),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM found WHERE len(terms) > 0),
wanted AS (SELECT item, item_id, unnest(list_distinct(terms)) AS term FROM (SELECT row_number() OVER () AS item, item_id, {terms('text')} AS terms FROM {benchmark})),
counted AS (SELECT line, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT line, doc_id, len(terms)::BIGINT AS n, unnest(terms) AS term FROM found)
  WHERE term IN (SELECT term FROM wanted) GROUP BY ALL),
weighed AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM counted, total GROUP BY term),
scores AS (SELECT item, item_id, line, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN counted USING (term) JOIN weighed USING (term), total GROUP BY ALL),
ordered AS (SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ordered WHERE rank <= {k}"""
