"""Folders whose contents change by commits: data files are written first, and a numbered manifest, which names those that hold, last."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Manifest:
    """Small JSON documents by number below ``root/_manifest``, in any file system that Spark reads.

    Who commits a number again replaces it, so a batch that is run again after a loss ends as if it had run once. Readers see the newest manifest, whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.root, self._hadoop = root.rstrip("/"), spark._jvm.org.apache.hadoop
        self._io = spark._jvm.org.apache.commons.io.IOUtils
        self._fs = self._path("_manifest").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):  # noqa: ANN202
        return self._hadoop.fs.Path(f"{self.root}/{name}")

    def children(self, name: str) -> list[str]:
        """The names in a folder below the root; none if there is no such folder."""
        path = self._path(name)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def numbers(self) -> list[int]:
        return sorted(int(n) for n in self.children("_manifest") if n.isdigit())

    def read(self, below: int | None = None) -> dict | None:
        """The newest manifest, or the newest of a lower number; None before there is one."""
        found = [n for n in self.numbers() if below is None or n < below]
        if not found:
            return None
        stream = self._fs.open(self._path(f"_manifest/{found[-1]}"))
        try:
            return json.loads(self._io.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, number: int, content: dict) -> None:
        """Writes the manifest aside and renames it, which file systems do whole."""
        aside, final = self._path(f"_manifest/.{number}"), self._path(f"_manifest/{number}")
        out = self._fs.create(aside, True)
        try:
            self._io.write(json.dumps(content, sort_keys=True), out, "UTF-8")
        finally:
            out.close()
        if self._fs.exists(final):
            self._fs.delete(final, False)
        if not self._fs.rename(aside, final):
            raise OSError(f"{final} was not committed")

    def remove(self, name: str) -> None:
        """A file or folder below the root, with all that is in it."""
        self._fs.delete(self._path(name), True)

    def forget(self, keep: int) -> list[dict]:
        """Removes all manifests but the newest ``keep``, and returns those."""
        numbers = self.numbers()
        for n in numbers[: max(0, len(numbers) - keep)]:
            self.remove(f"_manifest/{n}")
        return [m for m in (self.read(n + 1) for n in numbers[-keep:]) if m is not None]
