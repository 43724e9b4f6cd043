"""Operator 8: near-duplicates by DartMinHash signatures, banded joining and exact checks.

A document is the weighted set of its runs of five words (lower case), weighted by how often they occur; one of one to four words has one
run. Random darts, a unit-rate Poisson process over (weight, rank) seeded by the run, fall on the regions below each weight up to a rank of
``darts / total weight``, so that all sets get about as many darts whatever their size. Each dart belongs to one of ``SIZE`` coordinates,
and a coordinate keeps its dart of lowest rank; if one stays empty, the set is thrown at again up to twice the rank. Two sets agree in a
coordinate with the probability of their weighted Jaccard similarity.

Texts of the same words are one node. Nodes that agree in all coordinates of a band are candidates. They are joined in stars, not in pairs:
each member of a band's bucket is checked, exactly, against a centre of the bucket; buckets that then lie in one component are done, and of
members of different components only such pairs are checked whose sizes and common elements allow a link. Classes are the components of the
checked links.

Defined cases: a null text is empty; texts without words form one class; null doc_ids are allowed, a class is named by its smallest
doc_id (null if it has none); rows that share a doc_id are separate documents; an empty table gives no rows; further columns are kept by
``first_of_each`` and not read by ``classes``. Nodes are 64-bit digests of the word sequence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from panelmill.llm.components import components
from panelmill.llm.storage import stage
from panelmill.llm.text import LOWER, arrow_schema, hashes, mix, owner, prefix, slices, tables, utf8, words

WORDS, SIMILARITY = 5, 0.8
#: Members of a bucket that meet in one task.
BLOCK = 256
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
DARTS = SIZE * np.log(SIZE) + 2 * SIZE


def uniform(key: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((mix(key) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def node_of(column: pa.Array) -> np.ndarray:
    """Digest of each text's sequence of words."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, bounds = words(data, offsets)
    return hashes(prefix(hashes(prefix(data), start, end)), bounds[:-1], bounds[1:])


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weighted sets of all texts: (element, weight, bounds per text), elements ascending within a text, and each text's node."""
    data, offsets = utf8(column)
    data = LOWER[data]
    start, end, bounds = words(data, offsets)
    h = hashes(prefix(data), start, end)
    text = owner(bounds)
    place = np.arange(len(h)) - bounds[:-1][text]
    key = np.zeros(len(h), np.uint64)
    for k in range(WORDS):
        inside = place + k < np.diff(bounds)[text]
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + np.where(inside, np.append(h[k:], np.zeros(min(k, len(h)), np.uint64)), np.uint64(0)))
    run = place <= np.maximum(np.diff(bounds)[text] - WORDS, 0)
    text, key = text[run], key[run]
    order = np.lexsort((key, text))
    text, key = text[order], key[order]
    first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (text[1:] != text[:-1]))) if len(key) else np.zeros(0, np.int64)
    weight = np.diff(np.append(first, len(key)))
    node = hashes(prefix(h), bounds[:-1], bounds[1:])
    return key[first], weight, np.searchsorted(text[first], np.arange(len(bounds))), node


def dart_signatures(element: np.ndarray, weight: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures (sets x SIZE dart ids) of weighted sets; zeros for an empty set. Weights may be any positive numbers."""
    sets = len(bounds) - 1
    out = np.zeros((sets, SIZE), np.uint64)
    total = np.add.reduceat(np.append(weight, 0.0), bounds[:-1])
    total[np.diff(bounds) == 0] = 0
    todo = np.flatnonzero(total > 0)
    reach = DARTS
    while len(todo):
        index = np.full(sets, -1)
        index[todo] = np.arange(len(todo))
        which = index[owner(bounds)]
        at = np.flatnonzero(which >= 0)
        slots, ranks, names = [], [], []
        low, high = 0.0, 1.0  # weights are cut at 1, 2, 4, ...; every piece has darts of its own
        piece = 0
        while len(at):
            live, limit = at, reach / total[todo[which[at]]]
            rank = np.zeros(len(at))
            n = 0
            while len(live):
                seed = mix(element[live] + np.uint64(((piece << 40) + n + 1) * 0xD1B54A32D192ED03 % 2**64))
                rank = rank - np.log(uniform(seed)) / (high - low)
                on = rank <= limit
                live, rank, limit, seed = live[on], rank[on], limit[on], seed[on]
                hit = low + (high - low) * uniform(seed ^ np.uint64(0xA5A5A5A5)) < weight[live]
                name = mix(seed ^ np.uint64(0x5C5C5C5C))[hit]
                slots.append(which[live[hit]] * SIZE + (name % np.uint64(SIZE)).astype(np.int64))
                ranks.append(rank[hit])
                names.append(name)
                n += 1
            at = at[weight[at] > high]
            low, high, piece = high, high * 2, piece + 1
        slot, rank, name = np.concatenate(slots), np.concatenate(ranks), np.concatenate(names)
        order = np.argsort((slot.astype(np.uint64) << np.uint64(32)) | rank.astype(np.float32).view(np.uint32).astype(np.uint64))
        slot, name = slot[order], name[order]
        first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.zeros(0, np.int64)
        found = np.zeros(len(todo) * SIZE, np.uint64)
        found[slot[first]] = name[first] | np.uint64(1)
        found = found.reshape(-1, SIZE)
        full = (found != 0).all(1)
        out[todo[full]] = found[full]
        todo = todo[~full]
        reach *= 2
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band and set, from the band's number and dart ids."""
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(signatures), BANDS)).copy()
    for k in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + signatures[:, k::ROWS])
    return key


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, node, bands) of every document; a text without words has no bands."""
    out = "doc_id long, node long, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            element, weight, bounds, node = shingles(batch.column("text"))
            keys = band_keys(dart_signatures(element, weight.astype(float), bounds))
            some = np.diff(bounds) > 0
            edge = np.concatenate(([0], np.cumsum(some * BANDS))).astype(np.int32)
            bands = pa.ListArray.from_arrays(edge, keys[some].ravel().view(np.int64))
            yield from tables(iter([{"doc_id": batch.column("doc_id"), "node": node.view(np.int64), "bands": bands}]), arrow_schema(out))

    return _texts(docs).mapInArrow(run, out)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def sketches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, elements, weights): the whole weighted set of each wanted (node, doc_id), from the document of that id with these words."""
    out = "node long, elements binary, weights binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            element, weight, bounds, node = shingles(batch.column("text"))
            asked = batch.column("node").to_numpy().view(np.uint64)
            keep = np.flatnonzero(asked == node)
            cut = [slice(bounds[k], bounds[k + 1]) for k in keep.tolist()]
            yield from tables(
                iter([{"node": node[keep].view(np.int64), "elements": [element[c].tobytes() for c in cut], "weights": [weight[c].astype("<u4").tobytes() for c in cut]}]), arrow_schema(out))

    texts = _texts(docs).withColumnRenamed("doc_id", "id")
    rows = texts.join(wanted, F.col("id").eqNullSafe(F.col("doc_id"))).select("node", "text").mapInArrow(run, out)
    return rows.dropDuplicates(["node"])


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Sum of smaller over sum of larger weights, of two sets with ascending elements."""
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    both = b[0][at] == a[0]
    shared = int(np.minimum(a[1][both], b[1][at[both]]).sum())
    return shared / (int(a[1].sum()) + int(b[1].sum()) - shared)


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets have at least SIMILARITY, checked exactly. A hot v is split by Spark's skew join."""
    out = "u long, v long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            e1, w1, e2, w2 = (batch.column(c) for c in ("e1", "w1", "e2", "w2"))
            load = lambda k, e, w: (np.frombuffer(e[k].as_buffer(), np.uint64), np.frombuffer(w[k].as_buffer(), "<u4"))
            keep = [k for k in range(batch.num_rows) if weighted_jaccard(load(k, e1, w1), load(k, e2, w2)) >= SIMILARITY]
            yield from tables(iter([{"u": batch.column("u").take(pa.array(keep, pa.int64())), "v": batch.column("v").take(pa.array(keep, pa.int64()))}]), arrow_schema(out))

    one = sets.select(F.col("node").alias("u"), F.col("elements").alias("e1"), F.col("weights").alias("w1"))
    two = sets.select(F.col("node").alias("v"), F.col("elements").alias("e2"), F.col("weights").alias("w2"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "e1", "w1", "e2", "w2").mapInArrow(run, out)


def shared_mass(sets: DataFrame, among: DataFrame) -> DataFrame:
    """(node, size, common): weight of each node of ``among``, and of its elements that other nodes of ``among`` have, too."""
    out = "node long, element long, weight long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                element = np.frombuffer(batch.column("elements")[k].as_buffer(), np.int64)
                weight = np.frombuffer(batch.column("weights")[k].as_buffer(), "<u4")
                yield from tables(iter([{"node": np.full(len(element), batch.column("node")[k].as_py()), "element": element, "weight": weight}]), arrow_schema(out))

    rows = sets.join(among, "node").select("node", "elements", "weights").mapInArrow(run, out)
    alone = rows.groupBy("element").agg(F.count("*").alias("n"), F.min("node").alias("node"), F.min("weight").alias("weight")).where("n = 1")
    single = alone.groupBy("node").agg(F.sum("weight").alias("alone"))
    size = rows.groupBy("node").agg(F.sum("weight").alias("size"))
    return size.join(single, "node", "left").select("node", "size", (F.col("size") - F.coalesce("alone", F.lit(0))).alias("common"))


def divided(members: DataFrame, label: DataFrame) -> DataFrame:
    """(key, node, label): members of the buckets that lie in more than one component."""
    spread = members.join(label, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = spread.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    return spread.join(mixed, "key")


def stars(rows: DataFrame, rank: Column) -> DataFrame:
    """Pairs (u, v) of every member of a bucket with the bucket's first member by ``rank``, unless they are of one component."""
    centre = rows.groupBy("key").agg(F.min(F.struct(rank.alias("r"), "node", "label")).alias("c"))
    pairs = rows.join(centre, "key").where("label <> c.label")
    return pairs.select(F.least("node", "c.node").alias("u"), F.greatest("node", "c.node").alias("v")).distinct()


def labels(docs: DataFrame, sign: DataFrame) -> DataFrame:
    """(node, label) of the nodes that have a link; ``sign`` is what ``signed`` gave.

    First all members of a bucket are checked with one of them, then those of divided buckets with their most central member, whose
    elements most others have; last come members of different components. Of these only pairs are checked that can reach SIMILARITY: with
    sizes a and b and at most m in common, m being the smaller common mass, a + b <= m (1 + 1 / SIMILARITY) must hold.
    """
    rows = sign.select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    members = stage(rows.join(shared, "key").distinct(), "members")
    wanted = sign.join(members.select("node").distinct(), "node").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    sets = stage(sketches(docs, wanted), "sets")
    tested = stage(stars(members.withColumn("label", F.col("node")), F.xxhash64("node")), "pairs")
    links = stage(similar(tested, sets), "links")
    label = components(links)
    open_rows = stage(divided(members, label), "divided")
    mass = stage(shared_mass(sets, open_rows.select("node").distinct()), "mass")
    second = stage(stars(open_rows.join(mass, "node"), -F.col("common") / F.col("size")).join(tested, ["u", "v"], "left_anti"), "pairs")
    more = stage(similar(second, sets), "links")
    if not more.isEmpty():
        links, tested = links.union(more), tested.union(second)
        label = components(links)
        open_rows = stage(divided(members, label), "divided")
    # What a node's partner may weigh at most; those that no member of their bucket can suit are left out first.
    reach = F.col("common") * (1 + 1 / SIMILARITY) - F.col("size") + 1e-6
    left = open_rows.join(mass, "node").withColumn("reach", reach)
    least = left.groupBy("key").agg(F.min("size").alias("least"), F.count("*").alias("n"))
    left = left.join(least, "key").where("reach >= least").select("key", "node", "label", "size", "reach", "n")
    last = stage(linked(left, sets, sign), "links")
    return label if last.isEmpty() else components(links.union(last))


def linked(left: DataFrame, sets: DataFrame, sign: DataFrame) -> DataFrame:
    """Links (u, v) between members of different components in the buckets of ``left`` (key, node, label, size, reach, n).

    A bucket is dealt into blocks of about BLOCK members, and each two blocks meet in a task, which checks the pairs that the bound allows
    and returns links only. A pair that shares several buckets is checked in that of the first band.
    """
    bands = sign.groupBy("node").agg(F.min("bands").alias("bands"))
    rows = left.join(sets, "node").join(bands, "node")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), blocks.cast("long")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))).withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")})
    out = "u long, v long"

    def meet(group: pa.Table) -> pa.Table:
        own, a, b = (group.column(c).to_numpy() for c in ("own", "a", "b"))
        node, label, size, reach = (group.column(c).to_numpy() for c in ("node", "label", "size", "reach"))
        band = group.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, BANDS)
        here = band[0] == group.column("key")[0].as_py()
        one, two = np.flatnonzero(own == a), np.flatnonzero(own == b)
        load = lambda k: (np.frombuffer(group.column("elements")[k].as_buffer(), np.uint64), np.frombuffer(group.column("weights")[k].as_buffer(), "<u4"))
        held = {k: load(k) for k in {*one.tolist(), *two.tolist()}}
        found = []
        for i in one.tolist():
            fits = (node[i] < node[two]) | ((a[0] != b[0]) & (node[i] != node[two]))
            fits &= (label[i] != label[two]) & (size[i] <= reach[two]) & (size[two] <= reach[i])
            where = two[fits]
            same = band[where] == band[i]
            where = where[here[same.argmax(1)]] if len(where) else where
            found += [(node[i], node[j]) for j in where.tolist() if weighted_jaccard(held[i], held[j]) >= SIMILARITY]
        u, v = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"u": u, "v": v}, schema=arrow_schema(out))

    return rows.select("key", "a", "b", "own", "node", "label", "size", "reach", "bands", "elements", "weights").groupBy("key", "a", "b").applyInArrow(meet, out)


def nodes(docs: DataFrame) -> DataFrame:
    """(doc_id, node, label): every document with its node and the label of its class."""
    sign = stage(signed(docs), "signed")
    found = stage(labels(docs, sign), "labels")
    return sign.select("doc_id", "node").join(found, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"))


def classes(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, class_id (smallest doc_id of its class) and class_size."""
    rows = nodes(docs)
    named = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(named, "label").select("doc_id", "class_id", "class_size")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each class: that of the smallest doc_id (null: last), of its equals any one."""
    rows = nodes(docs)
    best = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("b")).select("b.doc_id", "b.node")
    schema = docs.schema
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"))
    keep = best.select(F.col("doc_id").alias("keep_id"), F.col("node").alias("keep_node"))
    kept = packed.join(keep, F.col("id").eqNullSafe(F.col("keep_id"))).select("row", "keep_id", "keep_node", F.col("row.text").cast("string").alias("text"))

    def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            node = node_of(batch.column("text")).view(np.int64)
            on = pa.array(np.flatnonzero(node == batch.column("keep_node").to_numpy()))
            yield batch.select(["row", "keep_id", "keep_node"]).take(on)

    out = StructType([StructField("row", schema), StructField("keep_id", LongType()), StructField("keep_node", LongType())])
    found = kept.mapInArrow(same, out)
    if not rows.groupBy("doc_id", "node").agg(F.count("*").alias("n")).where("n > 1").isEmpty():  # only then can a kept document come twice
        found = found.dropDuplicates(["keep_id", "keep_node"])
    return found.select("row.*")
