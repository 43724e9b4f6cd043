"""Operator 9 [native]: mixing sources to target weights by hierarchical budgets, with DataFrame functions only.

The leaves of the tree domain - language - source hold the documents' tokens (runs of non-space characters). A token budget starts at the
root. At each node it is shared among the children by their weights, but none gets more than its capacity (tokens times the epochs allowed,
summed over its leaves): what one child cannot use goes to its siblings, in proportion to their weights, and only what the whole node cannot
use has gone to the node's own siblings, one level up. A share is the least of capacity and weight times a common level, and the level comes
from running sums over the children in order of capacity / weight.

A leaf with a share of s tokens and t tokens of its own takes every document ``floor(s / t)`` times, and once more the longest prefix that
fits the rest, in the order of md5(seed, epoch, doc_id). The cut is found without sorting a leaf: documents are counted into ranges of their
hash, a running sum over the ranges finds the one in which the rest ends, and only its documents are ordered.

Defined cases: a null text is empty and has no tokens; documents without tokens are taken whenever the prefix reaches
their place; null
language, source or doc_id stand for ''; rows of one doc_id share a place in the order and are taken together or not at all; an empty table
gives no rows; unknown sources belong to the domain that the rule gives them; ``mixed`` keeps all columns of the documents.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelmill.llm.storage import stage

LEVELS = ["domain", "lang", "source"]
#: Most leaves whose plan is broadcast.
BROADCAST = 50_000


@dataclass(frozen=True)
class Mix:
    """Budget as a share of all tokens, epochs allowed per leaf, seed, number of domains, and weights of tree nodes that differ from 1.

    A node's weight stands under its name, such as "d1", "d1/en" or "d1/en/src3".
    """

    share: float = 0.9
    epochs: int = 2
    seed: int = 11
    domains: int = 4
    weights: tuple[tuple[str, float], ...] = (("d0", 2.0),)


def place(mix: Mix, epoch: Column, doc_id: Column) -> Column:
    """Position of a document in a leaf's order of an epoch: 32 hexadecimal digits."""
    return F.md5(F.concat_ws("|", F.lit(str(mix.seed)), epoch.cast("string"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def number(text: Column) -> Column:
    """The first 32 bits of a text's md5."""
    return F.conv(F.substring(text, 1, 8), 16, 10).cast("long")


def leaf_of(mix: Mix, row: str = "") -> list[Column]:
    """Tree nodes of a document: the domain follows from the source by a hash."""
    source = F.coalesce(F.col(f"{row}source").cast("string"), F.lit(""))
    domain = F.concat(F.lit("d"), (number(F.md5(source)) % mix.domains).cast("string"))
    return [domain.alias("domain"), F.coalesce(F.col(f"{row}lang").cast("string"), F.lit("")).alias("lang"), source.alias("source")]


def located(docs: DataFrame, mix: Mix) -> DataFrame:
    """doc_id, the tree nodes and the tokens of every document."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # Runs of non-space characters: after every run of spaces has become one space, one more than the spaces between words.
    squeezed = F.trim(F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " "))
    tokens = F.when(squeezed == "", 0).otherwise(F.length(squeezed) - F.length(F.translate(squeezed, " ", "")) + 1).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *leaf_of(mix), tokens.alias("n_tokens"))


def weight(mix: Mix, depth: int) -> Column:
    """Weight of the node at this depth, from the parameters."""
    name = F.concat_ws("/", *LEVELS[: depth + 1])
    out = F.lit(1.0)
    for node, value in mix.weights:
        out = F.when(name == node, F.lit(float(value))).otherwise(out)
    return out


def shared(children: DataFrame, parents: list[str], mix: Mix) -> DataFrame:
    """Each child's share of its parent's ``budget``: least of capacity and weight * level, the level being what uses up the budget.

    In order of capacity / weight, the first children are filled. A child is filled if the budget that is left when all before it are filled
    is enough to give it and all after it its own ratio.
    """
    depth = len(parents)
    order = Window.partitionBy(*parents).orderBy("ratio", LEVELS[depth]) if parents else Window.orderBy("ratio", LEVELS[depth])
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), (Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0)))
    rows = children.withColumn("weight", weight(mix, depth)).withColumn("ratio", F.col("capacity") / F.col("weight"))
    rows = rows.withColumn("used", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn("passed", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("level", (F.col("budget") - F.col("used")) / (F.sum("weight").over(whole) - F.col("passed")))
    rows = rows.withColumn("filled", F.col("ratio") <= F.col("level") + 1e-9)
    rows = rows.withColumn("rest", F.max(F.when(~F.col("filled"), F.col("level"))).over(whole))
    share = F.when(F.col("filled"), F.col("capacity").cast("double")).otherwise(F.col("weight") * F.col("rest"))
    return rows.select(*parents, LEVELS[depth], "capacity", share.alias("share"))


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """(domain, lang, source, tokens, share) of every leaf of ``leaves`` (domain, lang, source, tokens); share in whole tokens."""
    rows = leaves.withColumn("capacity", F.col("tokens") * mix.epochs)
    root = leaves.agg((F.sum("tokens") * F.lit(float(mix.share))).alias("budget"))
    given = None
    for depth in range(len(LEVELS)):
        children = rows.groupBy(*LEVELS[: depth + 1]).agg(F.sum("capacity").alias("capacity"))
        children = children.crossJoin(F.broadcast(root)) if given is None else children.join(given, LEVELS[:depth])
        found = shared(children, LEVELS[:depth], mix)
        given = found.select(*LEVELS[: depth + 1], F.col("share").alias("budget"))
    return leaves.join(given, LEVELS).select(*LEVELS, "tokens", F.floor(F.col("budget") + 1e-6).cast("long").alias("share"))


def plan(docs: DataFrame, mix: Mix) -> DataFrame:
    """One row per leaf: its share, the whole epochs it takes (``full``) and the last position taken in the next epoch (``cut``, null: none).

    ``located`` columns of the documents are read twice, once for the leaves' totals and once for the ranges; both are summed within tasks.
    """
    rows = stage(located(docs, mix), "located")
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    leaves = stage(leaves, "leaves")
    given = stage(budgets(leaves.select(*LEVELS, "tokens"), mix).join(leaves.select(*LEVELS, "docs"), LEVELS)
        .withColumn("full", F.when(F.col("tokens") > 0, F.least(F.floor(F.col("share") / F.col("tokens")), F.lit(mix.epochs))).otherwise(1).cast("long"))
        .withColumn("rest", F.col("share") - F.col("full") * F.col("tokens"))
        .withColumn("ranges", F.ceil(F.col("docs") / 2048.0).cast("long")), "given")
    part = rows.join(given.where("rest > 0").select(*LEVELS, "full", "rest", "ranges"), LEVELS).withColumn("place", place(mix, F.col("full"), F.col("doc_id")))
    # A range of the order: the first 8 hexadecimal digits, scaled to the leaf's number of ranges.
    part = part.withColumn("range", F.shiftright(number(F.col("place")) * F.col("ranges"), 32))
    by_range = part.groupBy(*LEVELS, "range", "rest").agg(F.sum("n_tokens").alias("n"), F.max("place").alias("last"))
    running = by_range.withColumn("done", F.sum("n").over(Window.partitionBy(*LEVELS).orderBy("range")))
    whole = running.where("done <= rest").groupBy(*LEVELS).agg(F.max("last").alias("whole"), F.max("done").alias("whole_n"))
    edge = running.where("done > rest").groupBy(*LEVELS).agg(F.min(F.struct("range", (F.col("done") - F.col("n")).alias("before"))).alias("e")).select(*LEVELS, "e.range", "e.before")
    ordered = part.join(edge, [*LEVELS, "range"]).withColumn("done", F.col("before") + F.sum("n_tokens").over(Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, 0)))
    inner = ordered.where("done <= rest").groupBy(*LEVELS).agg(F.max("place").alias("inner"))
    return given.join(whole, LEVELS, "left").join(inner, LEVELS, "left").select(*LEVELS, "tokens", "share", "full", F.greatest("whole", "inner").alias("cut"))


def taken(mix: Mix) -> Column:
    """How often a document of a leaf is taken."""
    again = F.coalesce((place(mix, F.col("full"), F.col("doc_id")) <= F.col("cut")).cast("long"), F.lit(0))
    return F.col("full") + again


def with_plan(rows: DataFrame, docs: DataFrame, mix: Mix) -> DataFrame:
    """``rows`` with their leaf's plan and the number of times they are taken. Up to BROADCAST leaves go to the workers; more are joined."""
    leaves = stage(plan(docs, mix), "plan")
    few = leaves.count() <= BROADCAST
    return rows.join(F.broadcast(leaves) if few else leaves, LEVELS).withColumn("times", taken(mix)).where("times > 0")


def selection(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """One row per document and epoch in which it is taken: doc_id, epoch, domain, lang, source, n_tokens, leaf_tokens, leaf_share."""
    rows = with_plan(located(docs, mix), docs, mix)
    epoch = F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)).alias("epoch")
    return rows.select("doc_id", epoch, *LEVELS, "n_tokens", F.col("tokens").alias("leaf_tokens"), F.col("share").alias("leaf_share"))


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """``docs`` with all columns, each row as often as it is taken. The plan has one row per leaf; texts aren't sorted or shuffled."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    keyed = packed.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), *leaf_of(mix, "row."))
    return with_plan(keyed, docs, mix).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("row.*")


def sql(mix: Mix = Mix(), documents: str = "documents") -> str:
    """The rows of ``selection`` as SQL for DuckDB."""
    hexed = "('0x' || substr({}, 1, 8))::BIGINT"
    place_of = lambda epoch: f"md5('{mix.seed}|' || {epoch}::VARCHAR || '|' || coalesce(doc_id::VARCHAR, ''))"
    out = f"""WITH located AS (
  SELECT doc_id, 'd' || ({hexed.format("md5(coalesce(source, ''))")} % {mix.domains})::VARCHAR AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM {documents}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM located GROUP BY ALL),
given_0 AS (SELECT (sum(tokens) * {float(mix.share)!r}::DOUBLE) AS budget FROM leaves)"""
    for depth in range(3):
        keys, parents = ", ".join(LEVELS[: depth + 1]), ", ".join(LEVELS[:depth])
        node = " || '/' || ".join(LEVELS[: depth + 1])
        weigh = "CASE " + " ".join(f"WHEN {node} = '{n}' THEN {float(w)!r}::DOUBLE" for n, w in mix.weights) + " ELSE 1.0::DOUBLE END" if mix.weights else "1.0::DOUBLE"
        over = f"PARTITION BY {parents}" if parents else ""
        up_to = f"OVER ({over} ORDER BY ratio, {LEVELS[depth]} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        out += f""",
child_{depth} AS (SELECT *, capacity / weight AS ratio FROM (
  SELECT c.*, budget, {weigh} AS weight FROM (SELECT {keys}, sum(tokens)::BIGINT * {mix.epochs} AS capacity FROM leaves GROUP BY ALL) c
  {f"JOIN given_{depth} USING ({parents})" if parents else f"CROSS JOIN given_{depth}"})),
level_{depth} AS (SELECT *, (budget - coalesce(sum(capacity) {up_to}, 0)) / (sum(weight) OVER ({over}) - coalesce(sum(weight) {up_to}, 0)) AS level FROM child_{depth}),
filled_{depth} AS (SELECT *, ratio <= level + 1e-9 AS filled FROM level_{depth}),
given_{depth + 1} AS (SELECT {keys}, CASE WHEN filled THEN capacity::DOUBLE ELSE weight * max(CASE WHEN NOT filled THEN level END) OVER ({over}) END AS budget FROM filled_{depth})"""
    out += f""",
planned AS (SELECT domain, lang, source, tokens, floor(budget + 1e-6)::BIGINT AS share FROM leaves JOIN given_3 USING (domain, lang, source)),
full_of AS (SELECT *, CASE WHEN tokens > 0 THEN least(share // greatest(tokens, 1), {mix.epochs}) ELSE 1 END AS full FROM planned),
placed AS (SELECT l.*, f.tokens, f.share, f."full", f.share - f."full" * f.tokens AS rest, {place_of('f."full"')} AS place FROM located l JOIN full_of f USING (domain, lang, source)),
summed AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS done FROM placed),
times AS (SELECT *, "full" + CASE WHEN rest > 0 AND done <= rest THEN 1 ELSE 0 END AS times FROM summed)
SELECT doc_id, unnest(range(0, times))::BIGINT AS epoch, domain, lang, source, n_tokens, tokens AS leaf_tokens, share AS leaf_share FROM times WHERE times > 0"""
    return out.replace("AS full", 'AS "full"')
