"""Numbered versions of a folder's state, so that readers see one whole state and writers can't overtake each other.

A version is a small JSON file. It is written under another name and renamed to
its number, which fails if that number exists: of several writers that start
from the same version one succeeds and the others begin again. The shared
folder's ``rename`` must not replace files (HDFS and its like; on a local disk
a lock keeps the writers of one process apart).
"""

from __future__ import annotations

import json
import threading
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import SparkSession

_LOCK = threading.Lock()
_WIDTH = 12


class Conflict(RuntimeError):
    """Another writer has published the version that this one wanted."""


class Versions:
    """The versions of ``path``; ``keep`` older ones stay readable."""

    def __init__(self, spark: SparkSession, path: str, keep: int = 100):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._text = spark._jvm.org.apache.hadoop.io.IOUtils
        self._buffer = spark._jvm.java.io.ByteArrayOutputStream
        self._folder = f"{path}/_versions"
        self._files = self._path(self._folder).getFileSystem(spark._jsc.hadoopConfiguration())
        self._keep = keep

    def _name(self, number: int):
        return self._path(f"{self._folder}/{number:0{_WIDTH}d}.json")

    def numbers(self) -> list[int]:
        """The published versions, oldest first."""
        folder = self._path(self._folder)
        if not self._files.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._files.listStatus(folder)]
        return sorted(int(n[:_WIDTH]) for n in names if n.endswith(".json") and n[:_WIDTH].isdigit())

    def read(self, number: int) -> dict[str, Any]:
        stream, held = self._files.open(self._name(number)), self._buffer()
        self._text.copyBytes(stream, held, 4096, True)
        return json.loads(bytes(held.toByteArray()).decode())

    def current(self, empty: dict[str, Any]) -> tuple[int, dict[str, Any]]:
        """The newest version and its number; ``empty`` and 0 before the first one."""
        numbers = self.numbers()
        return (numbers[-1], self.read(numbers[-1])) if numbers else (0, dict(empty))

    def publish(self, number: int, state: dict[str, Any]) -> None:
        """Make ``state`` version ``number``, or raise ``Conflict`` if there is one already."""
        draft = self._path(f"{self._folder}/.draft-{uuid.uuid4().hex}")
        out = self._files.create(draft, True)
        out.write(json.dumps(state).encode())
        out.close()
        with _LOCK:
            won = not self._files.exists(self._name(number)) and self._files.rename(draft, self._name(number))
        if not won:
            self._files.delete(draft, False)
            raise Conflict(f"version {number} of {self._folder} exists")
        for old in self.numbers()[: -self._keep]:
            self._files.delete(self._name(old), False)

    def update(self, empty: dict[str, Any], change: Callable[[dict[str, Any]], dict[str, Any]], tries: int = 100) -> dict[str, Any]:
        """Publish ``change`` of the newest version; starts again whenever another writer was first."""
        for _ in range(tries):
            number, state = self.current(empty)
            changed = change(state)
            try:
                self.publish(number + 1, changed)
                return changed
            except Conflict:
                continue
        raise Conflict(f"{self._folder}: {tries} attempts were overtaken")
