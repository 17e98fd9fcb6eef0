"""Result cache in Parquet, keyed by a hash of the normalised request, in a directory the engine owns.

Paths may lie in any file system that Spark reads; all access goes through Hadoop's file system.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from .. import __version__

MARKER = "_fieldloom_cache"


def cache_key(request: dict[str, Any]) -> str:
    """A hash of a request; coordinates count to seven digits, the package's version too."""
    plain = {k: round(v, 7) if k in ("longitude", "latitude") and isinstance(v, float) else v for k, v in request.items()}
    return hashlib.sha256(json.dumps([__version__, plain], sort_keys=True, default=str).encode()).hexdigest()


def safe_label(path: str) -> str:
    """A path or address that may be shown: without query, fragment, user and password."""
    text = re.sub(r"[?#].*$", "", path)
    return re.sub(r"^([A-Za-z][\w+.-]*://)[^/@]*@", r"\1", text)


def source_id(spark: SparkSession, path: str) -> str:
    """A hash of a file's or folder's place, sizes and times, for keys of what was made from it; a change of the file changes it."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        raise FileNotFoundError(safe_label(path))
    found = [(x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in files.listStatus(root)]
    return hashlib.sha256(json.dumps([safe_label(path), sorted(found)]).encode()).hexdigest()


@dataclass
class ResultCache:
    spark: SparkSession
    folder: str
    most: int = 200

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder.rstrip("/"), *parts]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def own(self) -> None:
        """Make the directory ours; one with other content is refused."""
        fs, root = self._files(), self._path()
        if fs.exists(self._path(MARKER)):
            return
        if fs.exists(root) and len(fs.listStatus(root)):
            raise ValueError(f"{self.folder} holds files that are not a cache's")
        fs.mkdirs(root)
        fs.create(self._path(MARKER)).close()

    def entries(self) -> list[tuple[int, str]]:
        """(last use in milliseconds, key) of complete entries, the oldest first."""
        fs = self._files()
        if not fs.exists(self._path(MARKER)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(self._path()) if s.isDirectory() and s.getPath().getName().startswith("key=")]
        found = [(self._path(n, "_SUCCESS"), n) for n in names]
        return sorted((fs.getFileStatus(p).getModificationTime(), n[4:]) for p, n in found if fs.exists(p))

    def read(self, key: str) -> DataFrame | None:
        """The entry, or None if it is missing or can't be read."""
        fs, done = self._files(), self._path(f"key={key}", "_SUCCESS")
        if not fs.exists(done):
            return None
        try:
            out = self.spark.read.parquet(self._path(f"key={key}").toString())
            out.schema  # noqa: B018  a damaged footer shows here
        except Exception:
            return None
        fs.setTimes(done, int(time.time() * 1000), -1)
        return out

    def write(self, key: str, result: DataFrame) -> DataFrame:
        """Store and reread; the entry appears whole or not at all, the least used ones beyond the limit go."""
        self.own()
        fs, temporary = self._files(), self._path(f".{uuid.uuid4().hex}")
        result.write.parquet(temporary.toString())
        final = self._path(f"key={key}")
        fs.delete(final, True)
        fs.rename(temporary, final)
        old = self.entries()
        for _, other in old[: max(0, len(old) - self.most)]:
            if other != key:
                fs.delete(self._path(f"key={other}"), True)
        return self.spark.read.parquet(final.toString())

    def get(self, request: dict[str, Any], make) -> DataFrame:
        key = cache_key(request)
        found = self.read(key)
        return found if found is not None else self.write(key, make())

    def clear(self) -> int:
        """Delete the entries of an owned directory; nothing else."""
        fs, gone = self._files(), 0
        for _, key in self.entries():
            gone += bool(fs.delete(self._path(f"key={key}"), True))
        return gone
