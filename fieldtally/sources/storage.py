"""Folders of stored tables: partitions listed by their names, folders removed, and pointer files.

Everything goes through Hadoop's file system, so any store that Spark reads will do. Listing reads no file; its cost is the
number of partitions. A pointer is a small file that is written under another name and then renamed to a higher number than
all before: readers see the old or the new one, never half of one.
"""

from __future__ import annotations

import json
import time
import uuid
from typing import NamedTuple

from pyspark.sql import SparkSession


class Folder(NamedTuple):
    path: str
    value: str


def _open(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder in order; none if there is no such folder."""
    fs, where = _open(spark, path)
    return sorted(entry.getPath().getName() for entry in fs.listStatus(where)) if fs.exists(where) else []


def partitions(spark: SparkSession, path: str, column: str) -> list[Folder]:
    """Folders ``column=value`` of a table, also those of its deltas ``batch_id=n``."""
    out = []
    for name in children(spark, path):
        if name.startswith(f"{column}="):
            out.append(Folder(f"{path}/{name}", name.split("=", 1)[1]))
        elif name.startswith("batch_id="):
            out += partitions(spark, f"{path}/{name}", column)
    return out


def remove(spark: SparkSession, paths: list[str]) -> int:
    """Delete folders with all they hold; those that are gone already don't count."""
    gone = 0
    for path in paths:
        fs, where = _open(spark, path)
        gone += bool(fs.delete(where, True))
    return gone


def complete_batches(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the deltas below a table whose writing came to its end."""
    found = [name for name in children(spark, path) if name.startswith("batch_id=")]
    return sorted(int(name.split("=", 1)[1]) for name in found if "_SUCCESS" in children(spark, f"{path}/{name}"))


def set_times(spark: SparkSession, paths: list[str], apart_s: int = 1) -> None:
    """Give files times of writing in the order given, for readers that go by them; the last one is now."""
    for i, path in enumerate(paths):
        fs, where = _open(spark, path)
        fs.setTimes(where, int(time.time() - (len(paths) - 1 - i) * apart_s) * 1000, -1)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    return sorted(int(name[len("at-") :]) for name in children(spark, folder) if name.startswith("at-"))


def read_pointer(spark: SparkSession, folder: str) -> dict | None:
    """The newest value of a pointer, if it was ever written."""
    versions = _versions(spark, folder)
    if not versions:
        return None
    fs, where = _open(spark, f"{folder}/at-{versions[-1]}")
    stream = fs.open(where)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_pointer(spark: SparkSession, folder: str, value: dict) -> None:
    """Make ``value`` the pointer's newest one. Of two writers at a time one fails, as its name is taken."""
    versions = _versions(spark, folder)
    fs, draft = _open(spark, f"{folder}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    try:
        stream.write(bytearray(json.dumps(value).encode()))
    finally:
        stream.close()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/at-{versions[-1] + 1 if versions else 0}")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"the pointer {folder} was moved by another writer")
    remove(spark, [f"{folder}/at-{n}" for n in versions[:-1]])  # the one before stays for readers that just found it
