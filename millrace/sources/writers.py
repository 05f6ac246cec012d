"""Sinks: samples, metrics, repositories, reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, append: bool = False, gzip: bool = False) -> None:
    """JSON lines in UTF-8, nulls left out; replaces what is at ``path`` unless ``append``."""
    writer = df.write.mode("append" if append else "overwrite")
    (writer.option("compression", "gzip") if gzip else writer).json(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A result of a few rows as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


#: Names the version of the manifest that holds.
CURRENT = "CURRENT"


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop
    return hadoop, hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())


def repos_version(spark: SparkSession, path: str) -> str | None:
    """The version that was committed last; None before the first."""
    hadoop, files = _files(spark, path)
    place = hadoop.fs.Path(path, CURRENT)
    return spark.read.text(str(place)).first()[0] if files.exists(place) else None


def _next(version: str | None) -> str:
    """A name after ``version`` that no other write has."""
    number = int(version[1:10]) if version else 0
    return f"v{number + 1:09d}-{uuid.uuid4().hex[:8]}"


def _commit(spark: SparkSession, path: str, version: str) -> None:
    """Second phase: one rename puts the new version in the old one's place, so a reader sees either."""
    hadoop, files = _files(spark, path)
    new, place = hadoop.fs.Path(path, f".{CURRENT}.{version}"), hadoop.fs.Path(path, CURRENT)
    out = files.create(new, True)
    out.write(bytearray(version.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = spark._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(place.toUri() if place.toUri().getScheme() else files.getUri(), spark._jsc.hadoopConfiguration()).rename(new, place, options)


def read_picks(spark: SparkSession, path: str) -> DataFrame:
    """What is picked now, with the column ``version`` of the write that holds each repository's files."""
    version = repos_version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no repositories were written to {path}")
    return spark.read.parquet(f"{path}/manifests/{version}")


def read_repos(spark: SparkSession, path: str) -> DataFrame:
    """The files of all picked repositories, each from the write that its pick names; other writes' folders are not opened."""
    picks = read_picks(spark, path).select("repo_name", "version")
    versions = [r[0] for r in picks.select("version").distinct().collect()]
    folders = [f"{path}/files/version={v}" for v in versions]
    if not folders:
        return spark.read.option("basePath", f"{path}/files").parquet(f"{path}/files").limit(0).drop("version")
    files = spark.read.option("basePath", f"{path}/files").parquet(*folders).withColumn("version", F.col("version").cast("string"))
    return files.join(picks, ["repo_name", "version"], "left_semi").drop("version")


def write_repos(files: DataFrame, picks: DataFrame, path: str) -> str:
    """Write picked repositories' files, by repository, and what was picked and why. Repositories written before are replaced, others stay; the new version.

    In two phases: files and a manifest, the picks of all repositories with the write that holds each, go to folders of their own, and
    then one rename makes the manifest the one that holds. A write that fails before it leaves all as it was, and may be run again.
    Concurrent writers are not merged: the last rename holds.
    """
    spark = files.sparkSession
    before = repos_version(spark, path)
    version = _next(before)
    kept = files.join(picks.select("repo_name"), "repo_name", "left_semi")
    kept.write.mode("overwrite").partitionBy("repo_name").parquet(f"{path}/files/version={version}")
    manifest = picks.withColumn("version", F.lit(version))
    if before:
        manifest = manifest.unionByName(read_picks(spark, path).join(picks.select("repo_name"), "repo_name", "left_anti"), allowMissingColumns=True)
    manifest.write.mode("overwrite").parquet(f"{path}/manifests/{version}")
    _commit(spark, path, version)
    return version


def drop_repos(spark: SparkSession, names: DataFrame | list[str], path: str) -> str:
    """Take back repositories that :func:`write_repos` wrote and that failed afterwards, by a manifest without them; the new version.

    Nothing is collected, overwritten or deleted; :func:`vacuum_repos` deletes what no manifest needs any more.
    """
    if isinstance(names, list):
        names = spark.createDataFrame([(n,) for n in names], "repo_name string")
    version = _next(repos_version(spark, path))
    read_picks(spark, path).join(names.select("repo_name"), "repo_name", "left_anti").write.mode("overwrite").parquet(f"{path}/manifests/{version}")
    _commit(spark, path, version)
    return version


def vacuum_repos(spark: SparkSession, path: str) -> None:
    """Delete manifests but the current one, and writes that it does not name."""
    hadoop, files = _files(spark, path)
    keep = {repos_version(spark, path), *(f"version={r[0]}" for r in read_picks(spark, path).select("version").distinct().collect())}
    for folder in ("manifests", "files"):
        for status in files.listStatus(hadoop.fs.Path(path, folder)):
            if status.getPath().getName() not in keep:
                files.delete(status.getPath(), True)


def write_results(results: DataFrame, path: str) -> None:
    """Results by mode; other modes' results stay."""
    results.withColumn("mode", F.coalesce("mode", F.lit("none"))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("mode").json(path)
