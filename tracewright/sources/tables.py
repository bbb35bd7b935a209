"""Listings that are kept up to date: tables in buckets by key, versions told by commits, and manifests of files.

A table is a folder: data/v=N/bucket=K holds bucket K as batch N left it, commits/n=N which version of each bucket
counts after it. A batch reads and writes the buckets that its keys fall into, and no others; its commit comes last.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in its form."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def numbers(spark: SparkSession, path: str) -> list[int]:
    """Of the folders n=... below a path those that were written whole, in order."""
    system, at = files(spark, path)
    if not system.exists(at):
        return []
    names = [s.getPath() for s in system.listStatus(at)]
    return sorted(int(p.getName()[2:]) for p in names if p.getName().startswith("n=") and system.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def versions(spark: SparkSession, path: str, before: int | None = None) -> dict[int, int]:
    """The version of each bucket after the last commit (before a number). One row for each bucket, at most."""
    done = [n for n in numbers(spark, f"{path}/commits") if before is None or n < before]
    return {r["bucket"]: r["v"] for r in spark.read.parquet(f"{path}/commits/n={done[-1]}").collect()} if done else {}


def current(spark: SparkSession, path: str, *, before: int | None = None, only: list[int] | None = None) -> DataFrame | None:
    """The table after its last commit; None where there is none. only: some buckets."""
    found = [f"{path}/data/v={v}/bucket={b}" for b, v in sorted(versions(spark, path, before).items()) if only is None or b in only]
    return spark.read.parquet(*found) if found else None


def merge(spark: SparkSession, path: str, batch: DataFrame, key: str, number: int, *, buckets: int = 256) -> None:
    """Rows of the batch take the place of those with their key. A key may stand once in a batch; a null key is a key."""
    if number in numbers(spark, f"{path}/commits"):
        return
    rows = batch.withColumn("bucket", bucket_of(key, buckets)).persist()
    try:
        touched = sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())
        if not touched:
            return
        after = versions(spark, path, number)
        if after and max(after) >= buckets:
            raise ValueError(f"the table at {path} has more than {buckets} buckets")
        old = current(spark, path, before=number, only=touched)
        new = rows
        if old is not None:
            kept = old.withColumn("bucket", bucket_of(key, buckets)).alias("o").join(rows.select(F.col(key).alias("_k"), F.col("bucket").alias("_b")), F.expr(f"o.bucket = _b and o.`{key}` <=> _k"), "left_anti")
            new = rows.unionByName(kept)
        # A version that broke off is written over. One bucket is one task's rows, and one file.
        new.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/v={number}")
        told = [(b, number if b in touched else after[b]) for b in sorted({*touched, *after})]
        spark.createDataFrame(told, "bucket int, v long").coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/n={number}")
    finally:
        rows.unpersist()


def vacuum(spark: SparkSession, path: str, *, keep: int = 2) -> None:
    """Deletes commits but the last few, and versions of buckets that none of those names."""
    done = numbers(spark, f"{path}/commits")
    named = {(b, v) for n in done[-keep:] for b, v in versions(spark, path, n + 1).items()}
    system, data = files(spark, f"{path}/data")
    for version in system.listStatus(data) if done else []:
        v = int(version.getPath().getName()[2:])
        own = list(system.listStatus(version.getPath()))
        gone = [s.getPath() for s in own if s.getPath().getName().startswith("bucket=") and (int(s.getPath().getName()[7:]), v) not in named]
        if v <= done[-1]:  # a later one is being written
            for p in gone:
                system.delete(p, True)
    for n in done[:-keep]:
        system.delete(files(spark, f"{path}/commits/n={n}")[1], True)


def listed(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size, changed of each file below root; nothing of the files is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(root)
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("changed"))


def refreshed(spark: SparkSession, root: str, state: str, summary: Callable[[DataFrame], DataFrame], *, glob: str = "*") -> DataFrame:
    """The listing of the logs below root: path, size, changed and what `summary` tells of each.

    The last listing lies at `state` as its manifest. Files that stand there with the same size and time keep their row;
    only the others are read: summary gets their lines (path, line_no, text) and gives a row for each path. Files that
    are gone leave, and so do empty ones (Spark doesn't list these)."""
    done = numbers(spark, state)
    now = listed(spark, root, glob)
    before = spark.read.parquet(f"{state}/n={done[-1]}") if done else None
    changed = now if before is None else now.join(before.select("path", "size", "changed"), ["path", "size", "changed"], "left_anti")
    changed = changed.persist()
    paths = [r["path"] for r in changed.select("path").collect()]
    parts = []
    if paths:
        text = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.struct("_metadata.file_block_start", F.monotonically_increasing_id()).alias("line_no"), F.col("value").alias("text"))
        told = summary(text)
        # Spark names a file with or without empty authority, by the reader.
        plain = F.regexp_replace("path", "^file:/+", "file:/")
        parts.append(changed.withColumn("_p", plain).join(told.withColumn("_p", plain).drop("path"), "_p", "left").drop("_p"))
    if before is not None:
        parts.append(before.join(now, ["path", "size", "changed"], "left_semi"))
    if not parts:
        raise FileNotFoundError(f"no files below {root}")
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)
    out.write.mode("overwrite").parquet(f"{state}/n={(done[-1] if done else -1) + 1}")
    changed.unpersist()
    return spark.read.parquet(f"{state}/n={(done[-1] if done else -1) + 1}")
