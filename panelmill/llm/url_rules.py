"""Operator 11: verdicts on urls from host and path rules, by a sort-merge range join of canonical keys.

The canonical key of a host and a path is the host's labels in reverse order, joined by dots, then a slash, then the path. A rule fits a url
if its key is a prefix of the key that the url has with the rule's number of host labels, so each rule is the interval of keys
[key, key + 0xFF), and of two rules one holds the other or they are apart. A url has one key for each number of labels that hosts of rules have
(a few numbers, whatever the number of rules).

Keys and intervals are dealt into ranges between cuts. A range gets the keys in it and the rules that reach into it, sorts both together, and
sweeps over them with a stack of the rules that are still open; the top of the stack is the longest rule that fits. A task holds one stack
and one batch. Of a url's fitting rules the longest (host and path together, then the host) decides.

The cuts come from a bounded sample of keys (``PER_CUT`` for each range), which only decides how even the ranges are. A key that fills several
ranges repeats among the cuts, and its rows are dealt evenly over them. A rule is copied to each range that it reaches into: at most as
many copies for each cut as rules nest.

Defined cases: a null url, or one without ``://``, has an empty host and path, which no rule fits; a url that no rule fits gets
``default``; an empty path does not start with "/"; of equal rules with different verdicts the one that comes last by name decides; rules without a
verdict are left out, a rule's null host or path is empty; equal rows, null and repeated page_ids are judged one by one and all kept; an empty table
gives no rows; without rules all get ``default``; further columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm.storage import stage
from panelmill.llm.text import arrow_schema

RULES = "host string, path string, verdict string"
HITS = "page_id long, host string, path string, size int, host_size int, rule string, verdict string"
#: Rows of a range, the most ranges (more rows make them longer, not wrong), and sampled keys for each cut.
PER_RANGE, MOST, PER_CUT = 1 << 16, 1 << 14, 16
#: Bytes of a key that a cut keeps.
CUT = 256
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a url."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    found = [F.regexp_extract(text, "://([^/?#]*)([^?#]*)", k) for k in (1, 2)]
    return F.translate(found[0], UPPER, LOWER), found[1]


def labels(host: Column) -> Column:
    """Labels of a host from the last to the first."""
    return F.reverse(F.split(host, "\\."))


def key(host_labels: Column, path: Column) -> Column:
    """Canonical key; hosts hold no slash, so the first one ends the host."""
    return F.concat(F.array_join(host_labels, "."), F.lit("/"), path).cast("binary")


def rules_of(spark: SparkSession, lines: list[tuple[str, str]]) -> DataFrame:
    """Rules from (verdict, "host/path") pairs."""
    cut = [(verdict, *text.partition("/")) for verdict, text in lines]
    return spark.createDataFrame([(host, slash + path, verdict) for verdict, host, slash, path in cut], RULES)


def _keyed_rules(rules: DataFrame) -> DataFrame:
    clean = [F.translate(F.coalesce(F.col("host"), F.lit("")), UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"]
    rows = rules.where("verdict is not null").select(*clean).distinct()
    return rows.select(key(labels(F.col("host")), F.col("path")).alias("key"), F.size(labels(F.col("host"))).alias("depth"), F.concat("host", "path").alias("rule"), F.length("host").alias("host_size"), "verdict")


def cuts_of(keys: DataFrame, rows: int) -> list[bytes]:
    """Ascending cuts between ranges, from the ``PER_CUT`` keys a range that come first by a hash of key and page_id."""
    ranges = max(keys.sparkSession.sparkContext.defaultParallelism, min(MOST, -(-rows // PER_RANGE)))
    sample = keys.select(F.substring("key", 1, CUT).alias("key"), F.xxhash64("key", "page_id").alias("h")).orderBy("h").limit(ranges * PER_CUT)
    found = sorted(bytes(r.key) for r in sample.select("key").toLocalIterator())
    return [found[len(found) * i // ranges] for i in range(1, ranges)] if found else []


def _range_of(cuts: list[bytes]):
    """Range of a key; where it repeats among the cuts, one of its ranges by ``deal``."""

    @F.pandas_udf("int")
    def place(keys: pd.Series, deal: pd.Series) -> pd.Series:
        out = []
        for k, d in zip(keys, deal):
            lo, hi = bisect_left(cuts, k), bisect_right(cuts, k)
            out.append(hi if hi - lo < 2 else lo + 1 + d % (hi - lo))
        return pd.Series(out, dtype="int32")

    return place


def _ranges_of(cuts: list[bytes]):
    """First and last range that hold keys starting with a rule's key."""

    @F.pandas_udf("array<int>")
    def reach(keys: pd.Series) -> pd.Series:
        return pd.Series([[bisect_left(cuts, k), bisect_left(cuts, k + b"\xff")] for k in map(bytes, keys)])

    return reach


def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hits of sorted events: rules (no page, ``rule`` set) open an interval, keys of urls take the innermost open one."""
    schema = arrow_schema(HITS)
    at, stack = None, []
    for batch in batches:
        rows, found = [], []
        columns = [batch.column(c).to_pylist() for c in ("range", "key", "rule", "host_size", "verdict")]
        for i, (number, k, rule, host_size, verdict) in enumerate(zip(*columns)):
            if number != at:
                at, stack = number, []
            while stack and not k.startswith(stack[-1][0]):
                stack.pop()
            if rule is not None:
                stack.append((k, len(rule), host_size, rule, verdict))
            elif stack:
                rows.append(i)
                found.append(stack[-1][1:])
        if rows:
            pages = [batch.column(c).take(pa.array(rows)) for c in ("page_id", "host", "path")]
            hits = [pa.array(c, schema.field(3 + j).type) for j, c in enumerate(zip(*found))]
            yield pa.RecordBatch.from_arrays(pages + hits, schema=schema)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """One row per row of ``pages`` (page_id, url): page_id, host, path, rule (null: none fits) and verdict, by ``rules`` (RULES)."""
    spark = pages.sparkSession
    host, path = parts(F.col("url"))
    judged = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    opened = stage(_keyed_rules(rules), "rules")
    depths = sorted(r.depth for r in opened.select("depth").distinct().toLocalIterator())
    win = "struct<size:int,host_size:int,rule:string,verdict:string>"
    rows = judged.select("*", F.lit(1).alias("n"), F.lit(None).cast(win).alias("win"))
    if depths:
        each = F.explode(F.filter(F.lit(depths), lambda d: d <= F.size("labels"))).alias("depth")
        probes = judged.withColumn("labels", labels(F.col("host"))).select("page_id", "host", "path", "labels", each)
        probes = probes.select("page_id", "host", "path", key(F.slice("labels", F.lit(1), F.col("depth")), F.col("path")).alias("key"))
        cuts = cuts_of(probes, pages.count() * len(depths))
        deal = F.pmod(F.xxhash64("page_id", F.monotonically_increasing_id()), F.lit(1 << 30))
        probes = probes.select("*", _range_of(cuts)(F.substring("key", 1, CUT), deal).alias("range"))
        reach = opened.withColumn("reach", _ranges_of(cuts)(F.substring("key", 1, CUT)))
        reach = reach.select("key", "rule", "host_size", "verdict", F.explode(F.sequence(F.col("reach")[0], F.col("reach")[1])).alias("range"))
        # A rule stands before the urls that have the same key.
        events = probes.withColumn("is_url", F.lit(True)).unionByName(reach.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
        events = events.repartition(len(cuts) + 1, "range").sortWithinPartitions("range", "key", "is_url", "verdict")
        hits = events.select("range", "key", "rule", "host_size", "verdict", "page_id", "host", "path").mapInArrow(sweep, HITS)
        rows = rows.unionByName(hits.select("page_id", "host", "path", F.lit(0).alias("n"), F.struct("size", "host_size", "rule", "verdict").alias("win")))
    out = rows.groupBy("page_id", "host", "path").agg(F.sum("n").alias("n"), F.max("win").alias("win"))
    out = out.select("page_id", "host", "path", F.col("win.rule").alias("rule"), F.coalesce("win.verdict", F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    return out.drop("col")


def sql(lines: list[tuple[str, str]], default: str = "allow", pages: str = "pages") -> str:
    """The rows of ``judge`` as SQL for DuckDB, every rule tried on every url."""
    values = ", ".join("('{}', '{}', '{}')".format(verdict, text.partition("/")[0], "/" + text.partition("/")[2]) for verdict, text in lines)
    return f"""WITH rules(verdict, rule_host, rule_path) AS (VALUES {values}),
judged AS (SELECT row_number() OVER () AS line, page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
  regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path FROM {pages}),
fits AS (SELECT j.*, rule_host || rule_path AS rule, verdict, row_number() OVER (PARTITION BY line ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM judged j LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, host, path, rule, coalesce(verdict, '{default}') AS verdict FROM fits WHERE k = 1"""
