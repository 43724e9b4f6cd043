"""Spearman correlations of many pairs of columns that rank each column once.

A pair is ranked among the rows that have both its columns, so a value has a rank for each partner of its column. Each follows from counts of rows
that have the partner too: a column's distinct values are sorted once, and the counts of all partners are summed along them. A group of
up to ``ranking.CELL`` rows is worked as arrays in one call. A larger one is dealt over chunks of about that size, whatever its values. A chunk sends
each column's distinct values and their counts to cells, cut at a sample of such entries, so that a value which many rows share goes once from a
chunk; the cell adds up the chunks and gives each its ranks back. What leaves a chunk at last is five numbers for a pair.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import ranking
from panelmill.functions.ranking import PER_CUT, _any, _null_safe_join, every


def _columns(table: pa.Table, names: Sequence[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Which rows have each column, and its values; NaN is a value, the largest."""
    cols = [table.column(c) for c in names]
    return [c.is_valid().to_numpy() for c in cols], [c.fill_null(0.0).to_numpy() for c in cols]


def _distinct(have: list[np.ndarray], values: list[np.ndarray], col: int, partners: Sequence[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, rows of each that have each partner, place of each present row's value)."""
    own = have[col]
    distinct, place = np.unique(values[col][own], return_inverse=True)
    counts = [np.bincount(place, weights=have[o][own], minlength=len(distinct)) for o in partners]
    return distinct, np.array(counts).astype(np.int64), place


def _centred(counts: np.ndarray, below: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Twice the mean rank of each value less twice the mean of all ranks, in whole numbers: a constant column has zeros."""
    return 2 * (below[:, None] + counts.cumsum(axis=1) - counts) + counts - total[:, None]


def _lists(arrays: Sequence[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays)))


def _table(table: pa.Table, by: Sequence[str], cols: dict[str, pa.Array]) -> pa.Table:
    """``cols`` behind the keys of the group that ``table`` holds."""
    n = len(next(iter(cols.values())))
    keys = {c: pa.array([table.column(c)[0].as_py()] * n, table.schema.field(c).type) for c in by}
    return pa.table(keys | cols)


def spearmans(df: DataFrame, by: Sequence[str], pairs: Sequence[tuple[str, str]], min_n: int = 1, out: str = "ic") -> DataFrame:
    """Spearman correlation with average ties of each pair, as rows (by, ``first``, ``second``, n, ``out``) of groups with ``min_n`` complete pairs."""
    from panelmill.sources.io import written

    by, names = list(by), list(dict.fromkeys(c for pair in pairs for c in pair))
    cols = [f"__c{i}" for i in range(len(names))]
    ends = [(names.index(a), names.index(b)) for a, b in pairs]
    partners: list[list[int]] = [[] for _ in names]
    slots = []
    for a, b in ends:  # where each side of a pair finds its ranks among those of its column
        slots.append((len(partners[a]), len(partners[b]) + (a == b)))
        partners[a].append(b)
        partners[b].append(a)

    def sums(table, have, places, ranks):
        """n and the sums of products of one pair after another."""
        got = []
        for (a, b), (i, j) in zip(ends, slots):
            both = have[a] & have[b]
            x, y = (ranks[c][k][places[c][both[have[c]]]].astype(np.float64) for c, k in ((a, i), (b, j)))
            got.append((len(x), x @ y, x @ x, y @ y))
        n, xy, xx, yy = map(np.array, zip(*got))
        return _table(table, by, {"__p": pa.array(range(len(ends)), pa.int32()), "__n": pa.array(n, pa.int64()), "__xy": pa.array(xy), "__xx": pa.array(xx), "__yy": pa.array(yy)})

    def whole(table):
        have, values = _columns(table, cols)
        places, ranks = [], []
        for c, other in enumerate(partners):
            _, counts, place = _distinct(have, values, c, other)
            places.append(place)
            ranks.append(_centred(counts, np.zeros(len(other), np.int64), counts.sum(axis=1)))
        return sums(table, have, places, ranks)

    def send(table, cuts):
        if not table.num_rows:  # a chunk that no row was dealt to
            return sent.empty_table()
        have, values = _columns(table, cols)
        rows = []
        for c, other in enumerate(partners):
            distinct, counts, _ = _distinct(have, values, c, other)
            cut = np.unique(cuts.column(f"__q{c}")[0].values.to_numpy()) if cuts.num_rows else np.zeros(0)
            edges = [0, *np.searchsorted(distinct, cut, side="right"), len(distinct)]
            for cell, (lo, hi) in enumerate(zip(edges, edges[1:])):
                rows.append((c, cell, distinct[lo:hi], counts[:, lo:hi].ravel(), counts[:, :lo].sum(axis=1), counts.sum(axis=1)))
        c, cell, *lists = zip(*rows)
        lists = dict(zip(("__u", "__k", "__below", "__all"), map(_lists, lists)))
        return _table(table, [*by, "__chunk"], {"__col": pa.array(c, pa.int32()), "__cell": pa.array(cell, pa.int32())} | lists)

    def rank(table):
        lists = {c: [v.values.to_numpy() for v in table.column(c)] for c in ("__u", "__k", "__below", "__all")}
        counts = np.concatenate([k.reshape(len(b), -1) for k, b in zip(lists["__k"], lists["__below"])], axis=1)
        _, place = np.unique(np.concatenate(lists["__u"]), return_inverse=True)
        added = np.array([np.bincount(place, weights=k) for k in counts]).astype(np.int64).reshape(len(counts), -1)
        ranks = _centred(added, sum(lists["__below"]), sum(lists["__all"]))[:, place]
        parts = np.split(ranks, np.cumsum([len(u) for u in lists["__u"]])[:-1], axis=1)
        kept = {c: table.column(c) for c in (*by, "__chunk", "__col", "__cell")}
        return pa.table(kept | {"__x": _lists([p.ravel() for p in parts])})

    def gather(table, ranked):
        if not table.num_rows:
            return summed.empty_table()
        have, values = _columns(table, cols)
        parts: list[dict[int, np.ndarray]] = [{} for _ in names]
        for c, cell, x in zip(ranked.column("__col").to_pylist(), ranked.column("__cell").to_pylist(), ranked.column("__x")):
            parts[c][cell] = x.values.to_numpy().reshape(len(partners[c]), -1)
        places = [np.unique(values[c][have[c]], return_inverse=True)[1] for c in range(len(names))]
        return sums(table, have, places, [np.concatenate([p[k] for k in sorted(p)], axis=1) for p in parts])

    keys = [df.schema[c] for c in by]
    number = lambda name, kind: T.StructField(name, kind)
    of_sums = T.StructType([*keys, number("__p", T.IntegerType()), number("__n", T.LongType()), *[number(c, T.DoubleType()) for c in ("__xy", "__xx", "__yy")]])
    place = [*keys, *[number(c, T.IntegerType()) for c in ("__chunk", "__col", "__cell")]]
    of_sent = T.StructType([*place, number("__u", T.ArrayType(T.DoubleType())), *[number(c, T.ArrayType(T.LongType())) for c in ("__k", "__below", "__all")]])
    of_ranked = T.StructType([*place, number("__x", T.ArrayType(T.LongType()))])
    from pyspark.sql.pandas.types import to_arrow_schema

    sent, summed = to_arrow_schema(of_sent), to_arrow_schema(of_sums)

    complete = _any([F.col(a).isNotNull() & F.col(b).isNotNull() for a, b in pairs])
    rows = df.where(complete).select(*by, *[F.col(c).cast("double").alias(v) for c, v in zip(names, cols)], F.monotonically_increasing_id().alias("__row"))
    rows = written(rows, "pairs")
    hot = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / ranking.CELL).cast("int").alias("__chunks")).where("__chunks > 1")
    hot = written(hot, "hot")
    if hot.isEmpty():
        parts = rows.groupBy(*by).applyInArrow(whole, of_sums)
    else:
        dealt = _null_safe_join(rows, F.broadcast(hot), by, "left").withColumn("__chunk", F.pmod(F.xxhash64("__row"), "__chunks").cast("int")).drop("__row")
        large, chunk = dealt.where("__chunk IS NOT NULL"), [*by, "__chunk"]
        picked = [F.col(c).isNotNull() & (F.pmod(F.xxhash64(c, "__chunk"), F.lit(max(ranking.CELL // PER_CUT, 1))) == 0) for c in cols]
        entries = [F.sort_array(F.collect_set(F.when(p, F.struct(c, "__chunk")))).alias(c) for p, c in zip(picked, cols)]
        cuts = large.where(_any(picked)).groupBy(*by).agg(F.max("__chunks").alias("__chunks"), *entries)
        at = [F.transform(every(F.col(c), PER_CUT), lambda e: e[c]).alias(f"__q{i}") for i, c in enumerate(cols)]
        cuts = written(cuts.select(*by, "__chunks", *at), "cuts").withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
        large = large.drop("__chunks")
        cells = large.groupBy(*chunk).cogroup(cuts.groupBy(*chunk)).applyInArrow(send, of_sent)
        ranked = cells.groupBy(*by, "__col", "__cell").applyInArrow(rank, of_ranked)
        parts = large.groupBy(*chunk).cogroup(ranked.groupBy(*chunk)).applyInArrow(gather, of_sums)
        parts = parts.unionByName(dealt.where("__chunk IS NULL").drop("__chunk", "__chunks").groupBy(*by).applyInArrow(whole, of_sums))
    total = parts.groupBy(*by, "__p").agg(*[F.sum(c).alias(c) for c in ("__n", "__xy", "__xx", "__yy")]).where(F.col("__n") >= min_n)
    label = lambda side: F.element_at(F.array(*[F.lit(pair[side]) for pair in pairs]), F.col("__p") + 1)
    spread = F.col("__xx") * F.col("__yy")
    return total.select(*by, label(0).alias("first"), label(1).alias("second"), F.col("__n").alias("n"), F.when(spread > 0, F.col("__xy") / F.sqrt(spread)).alias(out))


def spearman(df: DataFrame, by: Sequence[str], a: str, b: str, min_n: int = 1, out: str = "ic") -> DataFrame:
    """``spearmans`` of one pair."""
    return spearmans(df, by, [(a, b)], min_n, out).select(*by, "n", out)
