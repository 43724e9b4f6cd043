"""Readers and writers of contract tables, key-restricted scans, bundles and manifests."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelmill.functions import nan_to_null


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``; where it is unset, a local master gets a folder of its own."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="spark-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and lost executors don't lose it."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_contract(spark: SparkSession, path: str, contract: str | None = None) -> DataFrame:
    """Read a Parquet table with NaN as missing; with a contract, raise when it breaks a rule."""
    df = nan_to_null(spark.read.parquet(path))
    return checked(df, contract) if contract else df


def write_contract(df: DataFrame, path: str, contract: str | None = None, *, partition_by: Sequence[str] = (), mode: str = "error") -> None:
    writer = (checked(df, contract) if contract else df).write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def checked(df: DataFrame, contract: str) -> DataFrame:
    """The same frame, after one aggregate pass found no violation."""
    from panelmill.operators.quality import violations

    broken = violations(df, contract).collect()  # one row per rule and column of the contract
    if broken:
        raise ValueError(f"{contract}: " + "; ".join(f"{r['rule']}({r['column']})={r['n']}" for r in broken))
    return df


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """CSV (gzip by suffix) with declared types: malformed rows fail, unused columns are not parsed."""
    df = spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("nullValue", "").csv(path)
    return df.select(*columns) if columns else df


def restrict_to_keys(big: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of the big table whose key is requested. Spark broadcasts the key side only below its size limit."""
    return big.join(keys.select(*on).distinct(), list(on), "left_semi")


BUNDLE = ("universe", "signals", "signal_meta", "targets", "states", "cost_inputs")


@dataclass(frozen=True)
class Bundle:
    universe: DataFrame
    signals: DataFrame
    signal_meta: DataFrame
    targets: DataFrame
    states: DataFrame
    cost_inputs: DataFrame


def load_bundle(spark: SparkSession, root: str, *, country: str | None = None, validate: bool = False) -> Bundle:
    """Six lazy tables under one root; a country filter reaches the partition listing."""
    tables = {}
    for name in BUNDLE:
        df = read_contract(spark, f"{root}/{name}", name if validate else None)
        if country and "country" in df.columns:
            df = df.filter(F.col("country") == country)
        tables[name] = df
    return Bundle(**tables)


def panel(bundle: Bundle, columns: Sequence[str] | None = None) -> DataFrame:
    """Members with signals, targets and costs on the shared key."""
    k = ["date", "permno"]
    out = bundle.universe.join(bundle.signals, k, "left").join(bundle.targets, k, "left").join(bundle.cost_inputs.drop("country"), k, "left")
    return out.select(*k, *columns) if columns else out


def pool(frames: Mapping[str, DataFrame], *, id: str = "permno", mode: str = "pooled") -> DataFrame:
    """Union of country frames with ``country`` and a composite ``gid``.

    Modes: ``pooled`` unions all, ``within`` also keeps ids country-qualified for per-country work, or one country code.
    """
    if mode not in ("pooled", "within", *frames):
        raise ValueError(f"unknown panel mode {mode}")
    chosen = {mode: frames[mode]} if mode in frames else frames
    parts = [f.withColumn("country", F.lit(c)).withColumn("gid", F.concat_ws(":", F.lit(c), F.col(id).cast("string"))) for c, f in chosen.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.withColumn(id, F.col("gid")) if mode == "within" else out


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    return existing.unionByName(new, allowMissingColumns=True)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The newest row of each key; ``max_by`` keeps one row per key map-side, where a rank would sort every group."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__r")).select(*keys, *[F.col(f"__r.{c}").alias(c) for c in rest])


def gate(df: DataFrame, date: str, lo: str, hi: str) -> DataFrame:
    """A closed date window; the filter is pushed into the scan."""
    return df.filter(F.col(date).between(F.lit(lo).cast("date"), F.lit(hi).cast("date")))


def missing_partitions(spark: SparkSession, requested: DataFrame, cached: str, *, column: str, schema: T.StructType) -> DataFrame:
    """Requested partition values not cached yet; a cache with another schema counts as absent."""
    try:
        have = spark.read.parquet(cached)
    except Exception:  # nothing has been written yet
        return requested
    want = {f.name: f.dataType for f in schema.fields}
    found = {f.name: f.dataType for f in have.schema.fields if f.name in want}
    if found != want:
        return requested
    return requested.join(have.select(column).distinct(), column, "left_anti")


def write_partitions(df: DataFrame, path: str, column: str) -> None:
    """Write only the partitions present in ``df``. Rows are rebalanced by ``column``: small values share a task, a large one is split over several."""
    df.hint("rebalance", F.col(column)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)


def extract_years(
    source: DataFrame, features: Callable[[DataFrame], DataFrame], requested: DataFrame, path: str, *, date: str, year: str = "year", look_back: int = 62,
) -> list[int]:
    """Add the requested years that ``path`` lacks, each from its own rows and those of the ``look_back`` days before it; returns these years.

    ``features`` gets the rows with the year they are read for in column ``year``, keeps years apart (``year`` is one of its window keys) and
    returns ``date`` and ``year``; a year's look-back rows feed its windows and are not written. All missing years are read in one pass, a row
    being sent at most once for its own year and once for each later year within reach of it. Windows over rows, not days, equal those over all rows as long as the look-back
    holds as many rows of each key as a window looks back on. An interrupted run leaves whole years or none, as years are overwritten one by one.
    """
    tagged = source.withColumn(year, F.year(date))
    todo = [r[0] for r in missing_partitions(source.sparkSession, requested.select(year).distinct(), path, column=year, schema=features(tagged).schema).collect()]  # years
    if not todo:
        return []
    begin = lambda y: F.make_date(F.lit(y), F.lit(1), F.lit(1))
    reads = [(F.col(date) >= F.date_sub(begin(y), look_back)) & (F.col(date) < begin(y + 1)) for y in sorted(todo)]
    wanted = reduce(lambda a, b: a | b, reads)  # constant ranges, which reach the scan of the source
    targets = F.filter(F.array(*[F.when(r, F.lit(y)) for r, y in zip(reads, sorted(todo))]), lambda y: y.isNotNull())
    out = features(source.filter(wanted).withColumn(year, F.explode(targets)))
    write_partitions(out.filter(F.year(date) == F.col(year)), path, year)
    return sorted(todo)


def checked_join(left: DataFrame, right: DataFrame, on: Sequence[str], *, how: str = "left", expect: str = "one_to_one") -> DataFrame:
    """Inner or left join that fails while it runs where a key repeats: on the right (``many_to_one``) or on either side (``one_to_one``).

    A side is guarded by a grouping on the join keys, whose shuffle the join uses too. Rows with a null key match nothing and may repeat.
    """
    if how not in ("inner", "left") or expect not in ("one_to_one", "many_to_one"):
        raise ValueError(f"no check of a {how} join that is {expect}")
    on = list(on)
    clash = sorted(set(left.columns) & set(right.columns) - set(on))
    if clash:
        raise ValueError(f"columns of both sides: {', '.join(clash)}")
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])

    def unique(df: DataFrame, side: str) -> DataFrame:
        rest = F.struct(F.lit(1).alias("__"), *[c for c in df.columns if c not in on])
        many = F.raise_error(F.concat(F.lit(f"{side} side repeats the key "), F.concat_ws(", ", *[F.col(k).cast("string") for k in on])))
        rows = df.filter(whole).groupBy(*on).agg(F.any_value(rest).alias("__r"), F.count(F.lit(1)).alias("__n"))
        rows = rows.withColumn("__r", F.when(F.col("__n") > 1, many.cast(rows.schema["__r"].dataType)).otherwise(F.col("__r")))
        return rows.select(*[c if c in on else F.col(f"__r.{c}").alias(c) for c in df.columns])

    if expect == "many_to_one":
        return left.join(unique(right, "right"), on, how)
    out = unique(left, "left").join(unique(right, "right"), on, how)
    return out if how == "inner" else out.unionByName(left.filter(~whole), allowMissingColumns=True)


def file_digests(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """SHA-256 of every file (each below 2 GB, as one binary row)."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", F.sha2("content", 256).alias("sha256"))


def manifest_verify(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Every file of either side with its status against the recorded digest."""
    m = manifest.select("file", F.col("sha256").alias("recorded"))
    status = (
        F.when(F.col("recorded").isNull(), "unlisted").when(F.col("sha256").isNull(), "missing")
        .when(F.col("sha256") == F.col("recorded"), "ok").otherwise("changed")
    )
    return found.join(m, "file", "full_outer").select("file", "length", status.alias("status"))
