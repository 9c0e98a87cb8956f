"""Small metadata files in any Hadoop file system, committed by exclusive creation."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class CommitConflict(RuntimeError):
    """Another writer committed this version first."""


class VersionedFile:
    """``<root>/<name>-<n>.json``: the greatest readable n is current, and creating n + 1 is the commit."""

    def __init__(self, spark: SparkSession, root: str, name: str = "catalog"):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.root, self.name = root.rstrip("/"), name

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.root).getFileSystem(self._conf)

    def versions(self) -> list[int]:
        fs, root = self._fs(), self._path(self.root)
        if not fs.exists(root):
            return []
        out = []
        for status in fs.listStatus(root):
            base = status.getPath().getName()
            if base.startswith(f"{self.name}-") and base.endswith(".json"):
                out.append(int(base[len(self.name) + 1 : -5]))
        return sorted(out)

    def read(self) -> tuple[int, dict]:
        """(version, content) of the newest whole version; version 0 is empty."""
        for version in reversed(self.versions()):
            try:
                return version, self.at(version)
            except ValueError:  # its writer died while it was being written
                continue
        return 0, {}

    def at(self, version: int) -> dict:
        """The content of one version."""
        stream = self._fs().open(self._path(f"{self.root}/{self.name}-{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, version: int, content: dict) -> None:
        """Create version ``version``; fails if it exists."""
        fs = self._fs()
        fs.mkdirs(self._path(self.root))
        try:
            stream = fs.create(self._path(f"{self.root}/{self.name}-{version}.json"), False)
        except Exception as e:
            raise CommitConflict(f"version {version} of the catalog was committed by another writer") from e
        try:
            stream.write(bytearray(json.dumps(content, sort_keys=True).encode()))
        finally:
            stream.close()

    def folders(self, root: str) -> list[str]:
        """Folders two levels below ``root``: one per part of a dataset or view."""
        fs, top = self._fs(), self._path(root)
        if not fs.exists(top):
            return []
        below = [p.getPath().getName() for p in fs.listStatus(top)]
        return [f"{root}/{name}/{part.getPath().getName()}" for name in below for part in fs.listStatus(self._path(f"{root}/{name}"))]

    def remove(self, path: str) -> None:
        self._fs().delete(self._path(path), True)
