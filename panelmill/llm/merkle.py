"""Operator 12: Merkle manifest of a dataset by a nested-struct rollup, with a proof for every row.

A leaf is the sha256 of a row's fields, each written as its length in bytes, a colon and its value. The rows of a source, ranked by doc_id,
are cut into blocks of 16^3. Within a block the rank's hexadecimal digits are grouped away one after another, the last first: 16 nodes
become an array of structs in their parent, whose hash is the sha256 of theirs, so that after three groupings (of one shuffle) a block is one
row that nests all its nodes. Hashes of blocks are ranked nodes again and rolled up in the same way until a source is one row; sources,
in their order, form the tree above. Downwards, ``transform`` gives each node of a run the hashes on its left and right, and ``explode`` lets
it go, three times a block; a block's row and the proof above it come together by one more grouping, not a join. A task holds one block.

Ranks: rows are range-partitioned by source, doc_id and leaf and numbered where they stand; a source's numbers are shifted by the
counts of the partitions before, a few numbers for each partition. A source that holds most rows takes part in many partitions and blocks.

Defined cases: a null field is written ``-``; null sources are one source, which comes first; null doc_ids come first in their source; rows of
one doc_id are ordered by leaf, equal rows have equal leaves and all stay; a source of one row has its leaf as subroot, one source alone
has its subroot as root; a proof without siblings is empty; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.storage import stage

#: Levels of a block; a node has 16 children.
LEVELS = 3
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "struct<left:string,right:string>"


def leaf(**changed: Column) -> Column:
    """Hash of a row of documents; ``changed`` replaces fields."""

    def field(name: str) -> Column:
        value = changed.get(name, F.col(name))
        value = value.cast("long").cast("string") if name in ("doc_id", "n_chars") else value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.sha2(F.concat(*map(field, FIELDS)), 256)


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def ranked(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with ``rank``, from 0 in their group by ``order``, and ``size``, the rows of the group."""
    keys = [F.col(group).asc_nulls_first(), *order]
    # Equal rows are dealt over partitions by their number, as any order of them will do.
    dealt = rows.withColumn("deal", F.monotonically_increasing_id()).repartitionByRange(*keys, "deal")
    placed = stage(dealt.sortWithinPartitions(*keys, "deal").drop("deal").withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "placed")
    runs = placed.groupBy(group, "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(group)
    runs = runs.select(F.col(group).alias("of"), F.col("part").alias("in"), F.sum("n").over(whole).alias("size"), (F.sum("n").over(whole.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"))
    joined = placed.join(runs, placed[group].eqNullSafe(runs["of"]) & (placed["part"] == runs["in"]))
    return joined.withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "of", "in", "shift")


def rollup(nodes: DataFrame, group: str, above: int) -> DataFrame:
    """Blocks (group, size, block, hash, kids) of ``nodes`` (group, size, rank, hash, item), which stand ``above`` levels over the leaves.

    ``kids`` nests LEVELS arrays of (digit, hash, kids), the innermost ending in ``item``. A level above which the group has one node only
    adds no hash.
    """
    digits = [F.shiftright("rank", 4 * j).bitwiseAND(15).cast("int").alias(f"d{j}") for j in range(LEVELS)]
    rows = nodes.select(group, "size", F.shiftright("rank", 4 * LEVELS).alias("block"), *digits, "hash", F.col("item").alias("kids")).repartition(group, "block")
    for j in range(LEVELS):
        keys = [group, "size", "block", *(f"d{k}" for k in range(j + 1, LEVELS))]
        rows = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(f"d{j}").alias("digit"), "hash", "kids"))).alias("kids"))
        run = F.array_join(F.col("kids.hash"), "")
        rows = rows.withColumn("hash", F.when(F.col("size") > 16 ** (above + j), F.sha2(run, 256)).otherwise(F.col("kids")[0]["hash"]))
    return rows


def opened(blocks: DataFrame, above: int) -> DataFrame:
    """The nodes that ``rollup`` put into ``blocks``: all further columns, ``rank``, ``hash``, ``item``, and ``path`` run on from the node.

    ``path`` (array of left and right, one entry for each level that hashes) of a block leads from the block to the root.
    """
    rows = blocks.withColumn("rank", F.col("block"))
    for j in reversed(range(LEVELS)):
        others = [c for c in rows.columns if c not in ("kids", "rank", "path", "hash", "block")]

        def beside(k: Column, i: Column) -> Column:
            run = F.col("kids.hash")
            left, right = F.array_join(F.slice(run, F.lit(1), i), ""), F.array_join(F.slice(run, i + 2, F.size(run)), "")
            return F.struct(k["digit"].alias("digit"), k["hash"].alias("hash"), k["kids"].alias("kids"), left.alias("left"), right.alias("right"))

        each = rows.select(*others, "rank", "path", F.explode(F.transform("kids", beside)).alias("k"))
        longer = F.concat(F.array(F.struct("k.left", "k.right")), "path")
        path = F.when(F.col("size") > 16 ** (above + j), longer).otherwise(F.col("path"))
        rows = each.select(*others, (F.col("rank") * 16 + F.col("k.digit")).alias("rank"), path.alias("path"), "k.hash", "k.kids", F.lit(0).alias("block"))
    return rows.drop("block").withColumnRenamed("kids", "item")


def grown(nodes: DataFrame, group: str) -> list[DataFrame]:
    """Blocks of all rounds, written; in the last round each group is one row."""
    most = nodes.agg(F.max("size")).first()[0] or 0
    rounds = [stage(rollup(nodes, group, 0), "blocks")]
    while most > 16 ** (LEVELS * len(rounds)):
        tops = rounds[-1].select(group, "size", F.col("block").alias("rank"), "hash", F.lit(None).cast("string").alias("item"))
        rounds.append(stage(rollup(tops, group, LEVELS * len(rounds)), "blocks"))
    return rounds


def descended(rounds: list[DataFrame], group: str, tops: DataFrame) -> DataFrame:
    """Nodes at the foot of ``rounds`` with their paths; ``tops`` (group, path and further columns) has one row for each group."""
    further = [c for c in tops.columns if c not in (group, "path")]
    over = tops.withColumn("block", F.lit(0).cast("long"))
    for k in reversed(range(len(rounds))):
        both = rounds[k].drop("hash").unionByName(over, allowMissingColumns=True)
        met = both.groupBy(group, "block").agg(*[F.first(c, ignorenulls=True).alias(c) for c in ["size", "kids", "path", *further]])
        over = opened(met, LEVELS * k)
        if k:
            over = over.select(group, F.col("rank").alias("block"), "path", *further)
    return over


def manifest(docs: DataFrame, **carried: Column) -> DataFrame:
    """One row per row of ``docs``: source, leaf, subroot, root, path, and the columns ``carried``, which are computed from ``docs``.

    ``path`` is the proof: for each level from the leaf to the root the hashes on the left and on the right, in hexadecimal.
    """
    rows = docs.select(F.col("source").cast("string").alias("source"), F.col("doc_id").cast("long").alias("doc_id"), leaf().alias("hash"), F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[c.alias(n) for n, c in carried.items()]).alias("item"))
    placed = ranked(stage(rows, "leaves"), "source", F.col("doc_id").asc_nulls_first(), F.col("hash"))
    placed = stage(placed.drop("doc_id"), "ranked")
    trees = grown(placed, "source")
    subroots = trees[-1].select(F.lit(0).alias("all"), "hash", F.col("source").alias("item"))
    forest = grown(ranked(stage(subroots, "subroots"), "all", F.col("item").asc_nulls_first()), "all")
    top = forest[-1].select("all", F.col("hash").alias("root"), F.array().cast(f"array<{STEP}>").alias("path"))
    sources = descended(forest, "all", top).select(F.col("item").alias("source"), F.col("hash").alias("subroot"), "root", "path")
    out = descended(trees, "source", sources)
    return out.select("source", F.col("hash").alias("leaf"), "subroot", "root", "path", "item.*")


def folded(start: Column, path: Column) -> Column:
    """Root that follows from the leaf ``start`` and the hashes beside its path."""
    return F.aggregate(path, start, lambda node, s: F.sha2(F.concat(s["left"], node, s["right"]), 256))


def siblings(path: Column) -> Column:
    """All hashes of a proof, level by level and from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def verification(docs: DataFrame) -> DataFrame:
    """Checks every row's proof after A-Z of the texts of some rows (a fifth, by the crc32 of doc_id) have become lower-case."""
    tampered = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 5 == 0
    rows = manifest(docs, changed=F.when(tampered, leaf(text=lowered(F.col("text").cast("string")))))
    rows = rows.withColumn("folded_root", folded(F.coalesce("changed", "leaf"), F.col("path")))
    proof = F.sha2(siblings(F.col("path")), 256).alias("proof_sha256")
    return rows.select("doc_id", "leaf", "subroot", "root", proof, "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def sql(documents: str = "documents", levels: int = 5) -> str:
    """The rows of ``verification`` as SQL for DuckDB, for up to 16^levels rows a source and as many sources."""
    field = lambda v: f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(v) for v in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    bits = "list_reduce(list_concat([xor(c, b)], range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)), lambda c, b: xor(c >> 8, {bits.replace('xor(c, b)', 'xor(c, b) & 255')}))"
    out = f"""WITH leaves AS (SELECT doc_id, coalesce('s' || source, '') AS grp, {hashed('text')} AS leaf,
  CASE WHEN xor({crc}, 4294967295) % 5 = 0 THEN {hashed(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {hashed('text')} END AS given FROM {documents}),
a0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, leaf AS hash FROM leaves)"""
    for tree, keys in (("a", "grp"), ("b", "one")):
        if tree == "b":
            out += f",\nb0 AS (SELECT 1 AS one, grp, hash, row_number() OVER (ORDER BY grp) - 1 AS pos FROM a{levels} ORDER BY grp)"
        for j in range(levels):
            out += f""",
{tree}{j + 1} AS (SELECT {keys}, pos // 16 AS pos, CASE WHEN any_value(more) THEN sha256(string_agg(hash, '' ORDER BY pos)) ELSE any_value(hash) END AS hash
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) > 1 AS more FROM {tree}{j}) GROUP BY {keys}, pos // 16),
{tree}beside{j} AS (SELECT {keys}, pos, more, coalesce(string_agg(hash, '') OVER (l ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(hash, '') OVER (l ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r
  FROM (SELECT *, count(*) OVER (PARTITION BY {keys}) > 1 AS more FROM {tree}{j}) WINDOW l AS (PARTITION BY {keys}, pos // 16 ORDER BY pos))"""
    # Fold up both trees: a row's place at a level is its rank without the lower digits.
    fold = "f.doc_id, f.grp, f.leaf, f.place, f.home"
    out += ",\nf0 AS (SELECT a0.doc_id, a0.grp, a0.leaf, a0.pos AS place, b0.pos AS home, given AS node, '' AS proof FROM a0 JOIN b0 USING (grp))"
    n = 0
    for tree, place, on in (("a", "place", "s.grp = f.grp AND "), ("b", "home", "")):
        for j in range(levels):
            out += f""",
f{n + 1} AS (SELECT {fold}, CASE WHEN more THEN sha256(l || node || r) ELSE node END AS node, proof || l || r AS proof
  FROM f{n} f JOIN {tree}beside{j} s ON {on}s.pos = f.{place} // {16**j})"""
            n += 1
    return out + f"""
SELECT f.doc_id, f.leaf, s.hash AS subroot, t.hash AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.hash AS verified
FROM f{n} f JOIN a{levels} s ON s.grp = f.grp CROSS JOIN b{levels} t"""
