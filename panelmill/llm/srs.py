"""Operator 10: nearest neighbours by low-dimensional stable projections, a kd-tree over them, and a chi-square stopping test.

Nearness is the largest inner product. With all vectors lifted to the greatest norm M by one more coordinate, and a query scaled to norm M,
the largest inner product is the smallest Euclidean distance. Gaussian (2-stable) projections to ``DIM`` dimensions make the squared
projected distance of a point at distance d distributed as d^2 times chi-square with DIM degrees of freedom. So points are verified in order
of projected distance p, and when chi2(p^2 / d_k^2) >= ``STOP`` for the k-th best distance d_k so far, any nearer point would have been met
with that probability: the search ends.

The kd-tree is cut on a bounded sample of projected vectors (``SAMPLE``); its leaves partition all vectors, large leaves are cut further
into blocks of about ``BLOCK``. A query first searches one block of the leaf it falls in; then it goes to every other block whose box in the
projected space does not yet pass the stopping test, and the blocks' answers are merged.

Defined cases: vectors that are null, zero, hold a null or a non-finite component, or have another dimension than most, take no part, and
neither do null ids; equal rows count once; rows of one vec_id but different vectors count with the best score as candidates, and the
smallest vector is the query; a query never meets rows of its own vec_id; fewer candidates than k give all; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.storage import stage
from panelmill.llm.text import arrow_schema, mix, tables

DIM, STOP, BLOCK = 8, 0.98, 4096
#: Bounds: sampled vectors, leaves of the tree, queries that meet a block at once.
SAMPLE, LEAVES, QUERIES = 20_000, 4096, 50_000
STEP = 64
#: Rounding of squared projected distances, as a share of the squared greatest norm: copies of a query are at 0 only up to it.
ROUNDING = 1e-12


def chi2(x: np.ndarray) -> np.ndarray:
    """Distribution function of chi-square with DIM (even) degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700)
    return 1 - np.exp(-half) * sum(half**i / math.factorial(i) for i in range(DIM // 2))


@dataclass
class Tree:
    """Projection and kd-tree. Node i has children 2i+1 and 2i+2; the nodes of the last level are leaves."""

    norm: float
    matrix: np.ndarray
    axis: np.ndarray
    at: np.ndarray
    depth: int

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0))])

    def points(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.matrix

    def targets(self, q: np.ndarray) -> np.ndarray:
        return (q * (self.norm / np.sqrt((q * q).sum(1)))[:, None]) @ self.matrix[:-1]

    def leaf(self, p: np.ndarray) -> np.ndarray:
        node = np.zeros(len(p), np.int64)
        for _ in range(self.depth):
            node = 2 * node + 1 + (p[np.arange(len(p)), self.axis[node]] > self.at[node])
        return node - (2**self.depth - 1)


def grow(sample: np.ndarray, norm: float, count: int, seed: int = 5) -> Tree:
    """Tree with about ``count / BLOCK`` leaves, cut at medians of the widest dimension of the sample."""
    matrix = np.random.default_rng(seed).normal(size=(sample.shape[1] + 1, DIM))
    depth = max(0, min(int(math.log2(LEAVES)), math.ceil(math.log2(max(1, count / BLOCK)))))
    tree = Tree(norm, matrix, np.zeros(2**depth, np.int64), np.zeros(2**depth), depth)
    groups = [tree.points(sample)]
    node = 0
    for _ in range(depth):
        halves = []
        for p in groups:
            axis = int(np.argmax(np.ptp(p, axis=0))) if len(p) else 0
            cut = float(np.median(p[:, axis])) if len(p) else 0.0
            tree.axis[node], tree.at[node] = axis, cut
            node += 1
            right = p[:, axis] > cut
            halves += [p[~right], p[right]]
        groups = halves
    return tree


def valid(rows: DataFrame, vector: str) -> DataFrame:
    """(vec_id, v) of the vectors that take part, before the choice of the dimension."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & good)


def matrix_of(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1)


def search(points: np.ndarray, vectors: np.ndarray, ids: np.ndarray, targets: np.ndarray, queries: np.ndarray, own: np.ndarray, bound: np.ndarray, norm: float, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, row, score) of each query's k nearest ids of a block, by their best row; ``bound`` is a known k-th best squared distance."""
    out_q, out_row, out_score = [], [], []
    repeated, slack = len(np.unique(ids)) < len(ids), max(ROUNDING * norm**2, 1e-300)
    scale = norm / np.sqrt((queries * queries).sum(1))
    for a in range(0, len(queries), 128):
        part = slice(a, a + 128)
        apart = (targets[part] ** 2).sum(1)[:, None] + (points**2).sum(1) - 2 * targets[part] @ points.T
        for i in range(len(apart)):
            q, best = a + i, np.zeros(0, np.int64)
            score = np.zeros(0)
            limit, near = bound[q], np.maximum(apart[i], 0)
            if chi2(near.min() / (limit + slack)) >= STOP:
                continue
            order, at, step = np.argsort(near), 0, STEP
            while at < len(ids) and chi2(near[order[at]] / (limit + slack)) < STOP:
                rows = order[at : at + step]
                at, step = at + step, 2 * step  # the next test comes after twice as many
                rows = rows[ids[rows] != own[q]]
                best, score = np.append(best, rows), np.append(score, vectors[rows] @ queries[q])
                if repeated:
                    top = np.lexsort((ids[best], -score))
                    top = top[np.sort(np.unique(ids[best[top]], return_index=True)[1])]
                    best, score = best[top], score[top]
                if len(best) >= k:
                    top = np.lexsort((ids[best], -score))[:k]
                    best, score = best[top], score[top]
                    limit = min(limit, max(2 * norm**2 - 2 * scale[q] * score[-1], 0.0))
            out_q.append(np.full(len(best), q))
            out_row.append(best)
            out_score.append(score)
    if not out_q:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.concatenate(out_q), np.concatenate(out_row), np.concatenate(out_score)


FOUND = "query_id long, vec_id long, score double"


def nearest(rows: DataFrame, vector: str, every: int, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows of each row whose vec_id ``every`` divides: query_id, rank, vec_id, score."""
    spark = rows.sparkSession
    all_valid = valid(rows, vector)
    sizes = all_valid.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("m")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, count, norm = sizes[0]["d"], sizes[0]["n"], math.sqrt(sizes[0]["m"])
    data = all_valid.where(F.size("v") == size)
    sample = data.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    tree = grow(matrix_of(sample.column("v").combine_chunks()), norm, count)
    lows = ", ".join(f"p{i} double" for i in range(DIM))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = tree.points(matrix_of(batch.column("v")))
                yield from tables(iter([{"vec_id": batch.column("vec_id"), "v": batch.column("v"), "leaf": tree.leaf(p), **{f"p{i}": p[:, i] for i in range(DIM)}}]), arrow_schema(f"vec_id long, v array<double>, leaf int, {lows}"))

    placed = stage(data.mapInArrow(locate, f"vec_id long, v array<double>, leaf int, {lows}"), "placed")
    boxes = placed.groupBy("leaf").agg(F.count("*").alias("n"), *(f(f"p{i}").alias(f"{n}{i}") for i in range(DIM) for f, n in ((F.min, "lo"), (F.max, "hi")))).orderBy("leaf").collect()  # LEAVES rows at most
    blocks = {b["leaf"]: -(-b["n"] // BLOCK) for b in boxes}
    per_leaf = np.zeros(2**tree.depth, np.int64)
    per_leaf[list(blocks)] = list(blocks.values())
    leaf_box = np.array([[b[f"{n}{i}"] for n in ("lo", "hi") for i in range(DIM)] for b in boxes]).reshape(len(boxes), 2, DIM)
    names = np.array([b["leaf"] for b in boxes])
    queries = data.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    parts = max(1, -(-count // every // QUERIES))
    routed_schema = "query_id long, v array<double>, bound double, leaf int, block int, part int"

    def part_of(ids: np.ndarray) -> np.ndarray:
        return (mix(ids.view(np.uint64) + np.uint64(77)) % np.uint64(parts)).astype(np.int32)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ids = batch.column("vec_id").to_numpy()
                q = tree.targets(matrix_of(batch.column("v")))
                gap = ((np.maximum(leaf_box[:, 0][None] - q[:, None], 0) + np.maximum(q[:, None] - leaf_box[:, 1][None], 0)) ** 2).sum(2)
                leaf = names[np.argmin(gap, axis=1)]
                block = (mix(ids.view(np.uint64)) % per_leaf[leaf].astype(np.uint64)).astype(np.int32)
                yield from tables(iter([{"query_id": ids, "v": batch.column("v"), "bound": np.full(len(ids), np.inf), "leaf": leaf, "block": block, "part": part_of(ids)}]), arrow_schema(routed_schema))

    def away(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                some = batch.slice(a, 512)
                ids, bound = some.column("query_id").to_numpy(), some.column("bound").to_numpy()
                q = tree.targets(matrix_of(some.column("v")))
                gap = ((np.maximum(leaf_box[:, 0][None] - q[:, None], 0) + np.maximum(q[:, None] - leaf_box[:, 1][None], 0)) ** 2).sum(2)
                who, where = np.nonzero(chi2(gap / (bound + max(ROUNDING * norm**2, 1e-300))[:, None]) < STOP)
                times = per_leaf[names[where]]
                who, where = np.repeat(who, times), np.repeat(names[where], times)
                block = np.arange(len(who)) - np.repeat(np.cumsum(times) - times, times)
                new = ~((where == some.column("leaf").to_numpy()[who]) & (block == some.column("block").to_numpy()[who]))
                who, where, block = who[new], where[new], block[new]
                yield from tables(iter([{"query_id": ids[who], "v": some.column("v").take(pa.array(who)), "bound": bound[who], "leaf": where, "block": block, "part": part_of(ids)[who]}]), arrow_schema(routed_schema))

    number = F.element_at(F.create_map(*[F.lit(x) for leaf in blocks for x in (leaf, blocks[leaf])]), F.col("leaf"))
    chunk = F.pmod(F.xxhash64("vec_id"), number.cast("long")).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))) if parts > 1 else F.lit(0)
    stored = placed.select("vec_id", "v", "leaf", chunk.alias("block"), copies.alias("part"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return arrow_schema(FOUND).empty_table()
        x, ids = matrix_of(left.column("v").combine_chunks()), left.column("vec_id").to_numpy()
        order = np.lexsort((*x.T[::-1], ids))
        x, ids = x[order], ids[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1))
        x, ids = x[new], ids[new]
        q, own = matrix_of(right.column("v").combine_chunks()), right.column("query_id").to_numpy()
        who, row, score = search(tree.points(x), x, ids, tree.targets(q), q, own, right.column("bound").to_numpy(), norm, k)
        return pa.table({"query_id": own[who], "vec_id": ids[row], "score": score}, schema=arrow_schema(FOUND))

    def met(routed: DataFrame) -> DataFrame:
        keys = ["leaf", "block", "part"]
        return stored.groupBy(*keys).cogroup(routed.groupBy(*keys)).applyInArrow(meet, FOUND)

    first = stage(queries.mapInArrow(home, routed_schema), "home")
    seen = stage(met(first), "seen")
    # The k-th best distance so far (of one block, whose rows have different ids) bounds what other blocks have to beat; a query with fewer than k answers has no bound yet.
    kth = seen.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    bound = F.when(F.col("n") >= k, F.greatest(F.lit(2 * norm**2) - F.lit(2 * norm) * F.col("least") / length, F.lit(0.0))).otherwise(F.lit(float("inf")))
    bounded = first.drop("bound").join(kth, "query_id", "left").select("query_id", "v", bound.alias("bound"), "leaf", "block", "part")
    rest = met(bounded.mapInArrow(away, routed_schema))
    best = seen.union(rest).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
