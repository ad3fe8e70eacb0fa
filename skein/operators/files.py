"""Small files and folders of a lake, through the file system that Spark has for its path."""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..schema import LakeError


def place(spark: SparkSession, path: str):
    """(file system, path) of Hadoop."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = place(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = place(spark, path)
    fs.delete(p, True)


def read_json(spark: SparkSession, path: str):
    fs, p = place(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def write_json(spark: SparkSession, path: str, value, replace: bool = True) -> None:
    """A whole file at once: written beside its place, then renamed; without replace, an existing file is an error of Hadoop's."""
    fs, p = place(spark, path)
    data = bytearray((json.dumps(value) + "\n").encode())
    if not replace:  # creation is atomic: one of several callers succeeds
        stream = fs.create(p, False)
        stream.write(data)
        stream.close()
        return
    _, new = place(spark, f"{path}.{uuid.uuid4().hex}.new")
    stream = fs.create(new, True)
    stream.write(data)
    stream.close()
    fs.delete(p, False)
    if not fs.rename(new, p):
        raise LakeError(f"cannot replace {path}")


@contextmanager
def locked(spark: SparkSession, path: str, verb: str, hours: float = 6.0) -> Iterator[None]:
    """One batch verb (compact, rebuild, export) at a time on a lake. The lock is a file that only one caller can create; it names
    its owner and expires, so what a killed job leaves behind holds nobody for longer."""
    file = f"{path}/.lock"
    owner = {"verb": verb, "host": socket.gethostname(), "pid": os.getpid(), "id": uuid.uuid4().hex, "until": time.time() + hours * 3600}
    for attempt in range(2):
        try:
            write_json(spark, file, owner, replace=False)
            break
        except Exception as e:
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            held = read_json(spark, file)
            if attempt or held["until"] > time.time():
                raise LakeError(f"{path} is locked by {held['verb']} of {held['host']}, process {held['pid']}") from None
            delete(spark, file)
    try:
        yield
    finally:
        if exists(spark, file) and read_json(spark, file)["id"] == owner["id"]:
            delete(spark, file)
