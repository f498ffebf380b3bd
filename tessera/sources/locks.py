"""One writer at a time, by a lock file in the folder's own file system."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Locked(RuntimeError):
    """Another writer holds the lock."""


def _read(spark: SparkSession, fs, path) -> str:
    stream = fs.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _claim(fs, path, owner: str) -> bool:
    try:
        stream = fs.create(path, False)
    except Exception:  # the name is taken
        return False
    stream.write(bytearray(owner.encode()))
    stream.close()
    return True


@contextmanager
def exclusive(spark: SparkSession, path: str, *, stale_seconds: float = 3600) -> Iterator[str]:
    """Hold the lock file `path` for a block; `Locked` if another writer has it.

    The file is created only where there is none. One older than `stale_seconds` is that of a
    writer that died: it is moved away under a name of its own, which one of several finders
    can do, and put back if the one moved turns out to be another, fresh one. A block that takes
    longer than `stale_seconds` may lose its lock.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path
    lock = at(path)
    fs = lock.getFileSystem(spark._jsc.hadoopConfiguration())
    if lock.getParent() is not None:
        fs.mkdirs(lock.getParent())
    owner = uuid.uuid4().hex
    if not _claim(fs, lock, owner):
        try:
            held, since = _read(spark, fs, lock), fs.getFileStatus(lock).getModificationTime()
        except Exception as error:  # it has just been given up
            raise Locked(path) from error
        if time.time() * 1000 - since < stale_seconds * 1000:
            raise Locked(path)
        aside = at(f"{path}.stale-{owner}")
        if not fs.rename(lock, aside):
            raise Locked(path)
        if _read(spark, fs, aside) != held:
            fs.rename(aside, lock)
            raise Locked(path)
        fs.delete(aside, False)
        if not _claim(fs, lock, owner):
            raise Locked(path)
    try:
        yield owner
    finally:
        if fs.exists(lock) and _read(spark, fs, lock) == owner:
            fs.delete(lock, False)
