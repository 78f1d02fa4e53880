"""Paths on any file system that Spark reads, through Hadoop's API."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _fs(spark, path)
    return fs.exists(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = _fs(spark, path)
    fs.delete(where, True)


def touch(spark: SparkSession, path: str) -> None:
    """An empty file."""
    fs, where = _fs(spark, path)
    fs.create(where, True).close()


def listing(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a glob."""
    fs, where = _fs(spark, pattern)
    return [str(s.getPath()) for s in fs.globStatus(where) or []]


def members_below(spark: SparkSession, folder: str, name: str) -> list[str]:
    """All files of a name in a folder and the folders below it, in order."""
    fs, where = _fs(spark, folder)
    if not fs.exists(where):
        raise ValueError(f"{folder} doesn't exist")
    found, each = [], fs.listFiles(where, True)
    while each.hasNext():
        path = each.next().getPath()
        if path.getName() == name:
            found.append(str(path))
    return sorted(found, key=natural)


def natural(text: str) -> list:
    """A sort key in which part_2 stands before part_10."""
    return [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", text)]


def discover_parts(spark: SparkSession, source: str | list[str]) -> list[str]:
    """All siblings of '..._part_N.zip' in numeric order; a list, or any other source, as it is."""
    if not isinstance(source, str):
        return list(source)
    found = re.match(r"(.*_part_)\d+(\.zip)$", source)
    return sorted(listing(spark, f"{found[1]}*{found[2]}"), key=natural) if found else [source]
