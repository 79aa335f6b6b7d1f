"""Small files next to tables, on any file system that Spark can write to."""

from __future__ import annotations

import fcntl
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from ..errors import LockConflict, StorageError


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def names(self, folder: str = "") -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(at)) if self.fs.exists(at) else []

    def read(self, name: str) -> str:
        try:
            stream = self.fs.open(self._path(name))
        except Py4JJavaError as e:
            raise StorageError(f"{name} can't be opened: {e.java_exception}") from e
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        except Py4JJavaError as e:
            raise StorageError(f"{name} is damaged: {e.java_exception}") from e
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Write a file that must not exist yet; it appears whole or not at all."""
        at, temp = self._path(name), self._path(f".{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(temp, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.fs.mkdirs(at.getParent())
        if self.fs.exists(at) or not self.fs.rename(temp, at):
            self.fs.delete(temp, False)
            raise LockConflict(f"{name} was published by another writer")

    def make(self, folder: str) -> None:
        self.fs.mkdirs(self._path(folder))

    def lock(self) -> object | None:
        """The only writer's hold on a local root, which ends with the process; None where another one has it.

        File systems without such locks give a hold to everyone; ``publish`` still refuses the second writer of a name.
        """
        path = self._path(".lock").toUri()
        if path.getScheme() not in (None, "file") or self.fs.getUri().getScheme() != "file":
            return self
        os.makedirs(os.path.dirname(path.getPath()), exist_ok=True)
        held = open(path.getPath(), "a")  # noqa: SIM115
        try:
            fcntl.flock(held, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            held.close()
            return None
        return held

    def delete(self, name: str) -> None:
        self.fs.delete(self._path(name), True)
