"""Sources and sinks: nested JSON, idempotent appends, replacements, upserts, reports and result caches."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BLOCK, TRUTH, WORD
from . import versions
from .shared import settled

Keys = list[str]


def _documents(spark: SparkSession, path: str, lines: bool) -> DataFrame:
    """file, value: the text of each file, or of each line."""
    return spark.read.text(path, wholetext=not lines).select(F.input_file_name().alias("file"), "value")


def read_words(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """file, position, text, start_us, end_us out of JSON arrays of words, one a file or (lines) one a line; position is the place in the array."""
    words = F.from_json("value", f"array<struct<{WORD.replace(' ', ':').replace(',:', ',')}>>")
    us = lambda c: F.round(F.col(f"w.{c}") * 1_000_000).cast("long").alias(f"{c}_us")
    return _documents(spark, path, lines).select("file", F.posexplode(words).alias("position", "w")).select("file", "position", "w.text", us("start"), us("end"))


def read_truth(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """The nested record of each file or line; a bare list stands for its blocks, and effect types for either of two names."""
    bare = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<struct<{BLOCK.replace(' ', ':').replace(',:', ',')}>>"))
    df = _documents(spark, path, lines).select("file", F.from_json("value", TRUTH).alias("t"), bare.alias("bare")).select("file", "bare", "t.*")
    df = df.withColumn("blocks", F.coalesce("bare", "blocks")).drop("bare")
    return df.withColumn("effects", F.expr("transform(effects, e -> named_struct('effect_type', coalesce(e.effect_type, e.type), 'source_start', e.source_start, 'source_end', e.source_end, 'is_false_positive', coalesce(e.is_false_positive, false)))"))


def truth_blocks(truth: DataFrame) -> DataFrame:
    """A row for each block; without blocks the retained intervals stand in."""
    kept = F.expr("transform(retained_intervals, r -> named_struct('source_start', r.source_start, 'source_end', r.source_end, 'edit_start', cast(null as double), 'edit_end', cast(null as double), 'speed_ratio', 1D, 'is_manual_override', false, 'label', cast(null as string)))")
    return truth.select("file", F.explode_outer(F.coalesce("blocks", kept)).alias("b")).select("file", "b.*")


def write_idempotent(df: DataFrame, path: str, key: str, compact_after: int = 16) -> DataFrame:
    """Append the rows whose key is not stored yet, as one delta; returns what is stored then.

    Appends leave a folder each; every `compact_after` of them become one snapshot (see versions).
    """
    spark = df.sparkSession
    new, old = df.dropDuplicates([key]), versions.read_current(spark, path)
    if old is not None:
        new = new.join(old.select(key), key, "left_anti")
    number = versions.next_number(spark, path)
    versions.write_delta(new, path, number)
    if number % compact_after == compact_after - 1:
        versions.compact(spark, path, lambda rows: rows)
    return versions.read_current(spark, path)


def replace_asset(df: DataFrame, path: str, by: str, buckets: int = 64) -> DataFrame:
    """Replace all rows of the keys in df by df's, and leave the others; returns what is stored then.

    The table is parted by a hash of the key, so that its files do not follow the number of keys; only parts that hold
    keys of df are written again. A null key is a key of its own.
    """
    spark = df.sparkSession
    new = df.withColumn("part", F.pmod(F.xxhash64(by), F.lit(buckets)).cast("int"))
    try:
        old = spark.read.schema(new.schema).parquet(path)
    except AnalysisException:
        old = None
    if old is not None:
        new = settled(new, "incoming")
        keys = new.select(F.col(by).alias("_key"), F.col("part").alias("_part")).distinct()
        same = old.join(keys.select("_part").distinct(), F.col("part") == F.col("_part"), "left_semi")
        same = same.join(keys, F.col(by).eqNullSafe(F.col("_key")), "left_anti")
        new = settled(new.unionByName(same), "parts")  # a table is not read while it is written
    new.hint("rebalance", F.col("part")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    return spark.read.schema(new.schema).parquet(path).select(*df.columns)


def upsert_latest(old: DataFrame, new: DataFrame, keys: Keys, version: str) -> DataFrame:
    """The row of the highest version of each key; the new side on ties."""
    every = old.withColumn("_n", F.lit(0)).unionByName(new.withColumn("_n", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc(version), F.desc("_n"))
    return every.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k", "_n")


def sync_tables(source: dict[str, DataFrame], path: str, keys: dict[str, Keys], parents: dict[str, list[tuple[str, Keys]]], version: str, buckets: int = 64) -> dict[str, DataFrame]:
    """Bring the tables under `path` up to date with `source`, parents first; returns all tables as they are then.

    keys: of each table; parents: (parent table, columns here that hold its key, in the order of its key). A row goes in
    if its key is new or its version higher, and if all its parents are there by then; rows without a parent stay
    out. Tables are parted by a hash of their key, and only parts with changed keys are written again.
    """
    spark = next(iter(source.values())).sparkSession
    out: dict[str, DataFrame] = {}
    todo = list(source)
    while todo:
        ready = [t for t in todo if all(p in out or p not in source for p, _ in parents.get(t, []))]
        if not ready:
            raise ValueError(f"tables that depend on each other: {todo}")
        for name in ready:
            new, key, at = source[name], keys[name], f"{path}/{name}"
            for parent, columns in parents.get(name, []):
                held = out[parent] if parent in out else spark.read.parquet(f"{path}/{parent}")
                new = new.join(held.select(*[F.col(k).alias(c) for k, c in zip(keys[parent], columns, strict=True)]).distinct(), columns, "left_semi")
            new = upsert_latest(new.limit(0), new, key, version).withColumn("part", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
            try:
                old = spark.read.parquet(at).select(*new.columns)
            except AnalysisException:
                old = None
            if old is not None:
                known = old.select(*key, F.col(version).alias("_v"))
                new = new.join(known, key, "left").where(F.col("_v").isNull() | (F.col(version) > F.col("_v"))).drop("_v")
                new = settled(new, f"{name}-changed")
                same = old.join(new.select("part").distinct(), "part", "left_semi").join(new.select(*key), key, "left_anti")
                new = settled(new.unionByName(same.select(*new.columns)), f"{name}-parts")  # a table is not read while it is written
            new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(at)
            out[name] = spark.read.parquet(at)
            todo.remove(name)
    return {name: df.drop("part") for name, df in out.items()}


def cached_results(keys: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """Every key with its cached result and whether there was one."""
    return keys.join(cache.withColumn("hit", F.lit(True)), key, "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def write_report(df: DataFrame, path: str) -> None:
    """One JSON document a row."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
