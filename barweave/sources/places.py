"""Folders of any file system that Spark can reach."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _opened(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _opened(spark, path)
    return system.exists(place)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it does not exist."""
    place, system = _opened(spark, path)
    if not system.exists(place):
        return []
    return sorted(status.getPath().getName() for status in system.listStatus(place))


def versions(spark: SparkSession, path: str, prefix: str) -> list[int]:
    """Numbers of the completely written folders `<prefix><n>`, the newest first."""
    return sorted((int(name.removeprefix(prefix)) for name in folders(spark, path)
                   if name.startswith(prefix) and exists(spark, f"{path}/{name}/_SUCCESS")),
                  reverse=True)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own, and all in it."""
    place, system = _opened(spark, path)
    system.delete(place, True)
