"""Versions of a folder: data is written beside the older ones, an empty commit file makes it the newest at one stroke."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Versions:
    """Numbered versions below ``path``.

    A version is a folder that nobody reads before its commit file exists; the file is empty, so it is there or not.
    Readers take the newest commit. A write that fails leaves no commit, and the newest version stays what it was. Of
    two writers at once both versions are whole, and readers take the one with the higher number and label.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.path = path.rstrip("/")
        self._new = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._new(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def committed(self) -> list[str]:
        """Names of all versions, the newest last."""
        folder = self._new(f"{self.path}/_commits")
        if not self._files.exists(folder):
            return []
        return sorted(x.getPath().getName() for x in self._files.listStatus(folder))

    def newest(self) -> str | None:
        return (self.committed() or [None])[-1]

    def folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    @staticmethod
    def number(name: str | None) -> int:
        return int(name.split("-")[0]) if name else -1

    def fresh(self, number: int | None = None) -> str:
        """A name of its own for the next version, or for one of a given number."""
        number = self.number(self.newest()) + 1 if number is None else number
        return f"{number:012d}-{uuid.uuid4().hex}"

    def commit(self, name: str) -> None:
        self._files.create(self._new(f"{self.path}/_commits/{name}"), False).close()

    def drop(self, name: str) -> None:
        """Take a version back: first its commit, so that nobody starts to read it, then its folder."""
        self._files.delete(self._new(f"{self.path}/_commits/{name}"), False)
        self._files.delete(self._new(self.folder(name)), True)

    def keep_newest(self, n: int) -> None:
        """Drop all but the ``n`` newest versions; readers of one of those are not disturbed."""
        for name in self.committed()[:-n]:
            self.drop(name)

    def remove(self, below: str) -> None:
        """Remove a folder or file below the path."""
        self._files.delete(self._new(f"{self.path}/{below}"), True)

    def names(self, below: str = "") -> list[str]:
        folder = self._new(f"{self.path}/{below}") if below else self._new(self.path)
        return sorted(x.getPath().getName() for x in self._files.listStatus(folder)) if self._files.exists(folder) else []
