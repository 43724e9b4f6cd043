"""Operator 3: quality rules whose cutoffs are certified on labelled holdouts with exact binomial bounds.

Per stratum (language) and rule, cutoffs of a fixed grid are tested from the loosest to the tightest: with n labelled good documents of
which k exceed a cutoff, the hypothesis "more than ``alpha / rules`` of good documents are rejected" has the exact p-value
P(Bin(n, alpha / rules) <= k). Testing stops at the first cutoff that is not certified (a fixed sequence, which needs no correction within
it); strata and rules are corrected for by Bonferroni. So with probability 1 - ``delta`` no stratum loses more than ``alpha`` of its good
documents to the certified rules. A stratum with too few labels gets no cutoffs and only the base rules.

Defined cases: a null text has no words and fails the base rules; a null language is a stratum of its own; several labels of one document
count as good if all are; null labels and labels of unknown documents are ignored; rows that share a doc_id are judged one by one; empty
tables give no rows (no labels: no cutoffs); further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.storage import stage
from panelmill.llm.text import SPACE, arrow_schema, hashes, mix, owner, per_row, prefix, slices, tables, utf8, words

SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True
RULES = ["symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "shout_ratio"]
#: Cutoffs from loose to tight; the last ones ask for a few marks in a thousand characters.
GRID = [round(2.0 ** (-k / 4), 6) for k in range(37)]
BASE = "doc_id long, stratum string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
METRICS = BASE + "".join(f", {r} double" for r in RULES)


def repeated(key: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice."""
    order = np.sort(key)
    again = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(again):
        return np.zeros(len(key), bool)
    at = np.minimum(np.searchsorted(again, key), len(again) - 1)
    return again[at] == key


def measure(column: pa.Array, window: int = 8) -> dict[str, np.ndarray]:
    """The base counts and the rules' features of every text of a column."""
    data, offsets = utf8(column)
    rows = len(column)
    start, end, bounds = words(data, offsets)
    n_words = np.diff(bounds)
    sums = prefix(data)
    solid = ~SPACE[data]
    chars = per_row(((data & 0xC0) != 0x80) & solid, offsets)
    symbols = per_row(SYMBOL[data], offsets)
    # Windows of words: a hash of each within its text, then the words that repeated windows cover.
    h = hashes(sums, start, end)
    text = owner(bounds)
    covered = np.zeros(len(h), np.int64)
    if len(h) >= window:
        key = mix(text[: len(h) - window + 1].astype(np.uint64) + np.uint64(1))
        for k in range(window):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - window + 1 + k])
        whole = text[: len(key)] == text[window - 1 :]
        at = np.flatnonzero(whole)
        at = at[repeated(key[at])]
        edge = np.zeros(len(h) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
        covered = np.cumsum(edge[:-1]) > 0
    n_repeat = per_row(covered, bounds)
    # Lines with a word, and those of them that are first of their kind in the text.
    breaks = np.flatnonzero(data == 10)
    line_text = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, "right") - 1])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_start, line_text))
    line_text, line_start = line_text[order], line_start[order]
    line_end = np.where(np.append(line_text[1:] == line_text[:-1], False), np.append(line_start[1:], 0) - 1, offsets[line_text + 1])
    solids = np.concatenate(([0], np.cumsum(solid)))
    filled = solids[line_end] > solids[line_start]
    line_text, key = line_text[filled], hashes(sums, line_start[filled], line_end[filled])
    _, first = np.unique(mix(key + mix(line_text.astype(np.uint64) + np.uint64(1))), return_index=True)
    lines = np.bincount(line_text, minlength=rows)
    dup_lines = lines - np.bincount(line_text[first], minlength=rows)
    upper = per_row((data >= 65) & (data <= 90), offsets)
    shout = per_row(data == 33, offsets)
    some = np.maximum(chars, 1)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": n_repeat,
        "symbol_ratio": symbols / some, "dup_line_ratio": dup_lines / np.maximum(lines, 1), "repeat_ratio": n_repeat / np.maximum(n_words, 1),
        "upper_ratio": upper / some, "shout_ratio": shout / some,
    }


def metrics(docs: DataFrame) -> DataFrame:
    """Counts and features of all documents, in one pass over whole texts."""
    schema = arrow_schema(METRICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield from tables(iter([{"doc_id": batch.column("doc_id"), "stratum": batch.column("stratum"), **measure(batch.column("text"))}]), schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, METRICS)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed exactly in logarithms."""
    if k >= n:
        return 1.0
    i = np.arange(k + 1)
    log = np.array([math.lgamma(n + 1) - math.lgamma(x + 1) - math.lgamma(n - x + 1) for x in i.tolist()])
    return float(min(1.0, np.exp(log + i * math.log(p) + (n - i) * math.log1p(-p)).sum()))


def certified(exceed: list[int], n: int, rate: float, level: float) -> float | None:
    """The tightest cutoff of GRID reached before the first one whose false rejection isn't bounded by ``rate`` at ``level``."""
    best = None
    for cutoff, k in zip(GRID, exceed):
        if k > n * rate or binomial_cdf(k, n, rate) > level:
            break
        best = cutoff
    return best


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """One row per stratum that has labels: its certified cutoff of each rule (null: none). Only counts per cutoff leave the tasks."""
    good = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1")
    rows = measured.join(good, "doc_id")
    # Level of a feature: how many cutoffs of the grid it exceeds, counted from the tight end.
    level = [sum((F.col(r) > c).cast("int") for c in GRID).alias(r) for r in RULES]
    long = rows.select("stratum", *level).select("stratum", F.explode(F.map_from_arrays(F.array(*map(F.lit, RULES)), F.array(*RULES))).alias("rule", "level"))
    counts = long.groupBy("stratum", "rule", "level").agg(F.count("*").alias("n"))
    strata = counts.agg(F.count_distinct("stratum").alias("strata"))

    def certify(key: tuple, counted: pd.DataFrame) -> pd.DataFrame:
        by_level = np.zeros(len(GRID) + 1, np.int64)
        np.add.at(by_level, counted["level"].to_numpy(), counted["n"].to_numpy())
        exceed = [int(by_level[len(GRID) - j :].sum()) for j in range(len(GRID))]  # the j-th loosest is exceeded by the levels above
        tests = int(counted["strata"].iloc[0]) * len(RULES)
        return pd.DataFrame({"stratum": [key[0]], "rule": [key[1]], "cutoff": [certified(exceed, int(by_level.sum()), alpha / len(RULES), delta / tests)]})

    found = counts.crossJoin(F.broadcast(strata)).groupBy("stratum", "rule").applyInPandas(certify, "stratum string, rule string, cutoff double")
    return found.groupBy("stratum").agg(*(F.max(F.when(F.col("rule") == r, F.col("cutoff"))).alias(f"cut_{r}") for r in RULES))


def judge(docs: DataFrame, labels: DataFrame, alpha: float = 0.02, delta: float = 0.05) -> DataFrame:
    """Verdict on every document of ``docs`` (doc_id, text, lang); ``labels`` (doc_id, quality) certify the cutoffs.

    The measured counts are written once, as both the certification and the verdict read them.
    """
    measured = stage(metrics(docs), "quality")
    chosen = cutoffs(measured, labels, alpha, delta)
    over = chain.from_iterable([F.coalesce(F.col(r) > F.col(f"cut_{r}"), F.lit(False))] for r in RULES)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    rejected = F.array_contains(F.array(*over), True)
    named = [c.split()[0] for c in BASE.split(", ") if c.split()[0] != "stratum"]
    return measured.join(chosen, "stratum", "left").select(*named, failed.alias("base_failed"), (~failed & ~rejected).alias("kept"), "stratum", *(f"cut_{r}" for r in RULES))
