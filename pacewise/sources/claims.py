"""Claims: which of several drivers works on something, told by a file that only one of them can create.

A claim keeps others from doing the same work at the same time. It cannot be what results rest on: a driver that is
taken for dead may only be slow. Work under a claim therefore goes to a folder of its own attempt, and readers tell by
the records which attempt counts.
"""

from __future__ import annotations

import os
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from pacewise.sources.files import delete, resolve

#: A claim older than this is taken for a dead driver's.
EXPIRY_SECONDS = 3_600


def create_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file ``path`` with ``text`` unless it is there; whether this call did. One step of the file system."""
    fs, p = resolve(spark, path)
    fs.mkdirs(p.getParent())
    if fs.getUri().getScheme() == "file":  # Hadoop's local file system looks first and creates then
        try:
            handle = os.open(p.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            return False
        with os.fdopen(handle, "w") as f:
            f.write(text)
        return True
    try:
        out = fs.create(p, False)
    except Py4JJavaError as e:
        if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()) and not fs.exists(p):
            raise
        return False
    out.write(bytearray(text.encode()))
    out.close()
    return True


class Claim:
    """A claim on ``path`` that this driver holds; use it as a context."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def __enter__(self) -> Claim:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.path)


def claim(spark: SparkSession, path: str, expiry: float = EXPIRY_SECONDS) -> Claim | None:
    """The claim on ``path``, or None where another driver holds it.

    A claim older than ``expiry`` seconds is put aside by a rename, which one of those who try brings off.
    """
    fs, p = resolve(spark, path)
    if create_new(spark, path, uuid.uuid4().hex):
        return Claim(spark, path)
    try:
        age = time.time() - fs.getFileStatus(p).getModificationTime() / 1000
    except Py4JJavaError:  # given up this moment
        age = 0.0
    if age <= expiry:
        return None
    aside = f"{path}-expired-{uuid.uuid4().hex}"
    try:
        moved = fs.rename(p, resolve(spark, aside)[1])
    except Py4JJavaError:
        moved = False
    if not moved:
        return None
    delete(spark, aside)
    return Claim(spark, path) if create_new(spark, path, uuid.uuid4().hex) else None


def wait_for(spark: SparkSession, path: str, expiry: float = EXPIRY_SECONDS, pause: float = 0.5) -> Claim:
    """The claim on ``path`` as soon as nobody else holds it."""
    while True:
        held = claim(spark, path, expiry)
        if held:
            return held
        time.sleep(pause)
