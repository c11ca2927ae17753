"""Small files beside Parquet folders, on any file system that Spark's Hadoop client reads."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A folder on a shared file system."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    def _fs(self):
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def exists(self) -> bool:
        place, fs = self._fs()
        return fs.exists(place)

    def names(self, folders: bool | None = None) -> list[str]:
        """Names within, hidden ones left out; only folders or only files, if asked."""
        place, fs = self._fs()
        if not fs.exists(place):
            return []
        found = [(s.getPath().getName(), s.isDirectory()) for s in fs.listStatus(place)]
        return sorted(n for n, is_folder in found if not n.startswith((".", "_")) and folders in (None, is_folder))

    def matching(self, pattern: str) -> list[str]:
        """Paths within that match a glob, whole."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{pattern}")
        found = place.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(place)
        return sorted(s.getPath().toString() for s in found or [])

    def delete(self) -> None:
        place, fs = self._fs()
        fs.delete(place, True)

    def read(self) -> dict | None:
        """The JSON object in this file; None if there is none."""
        place, fs = self._fs()
        if not fs.exists(place):
            return None
        stream = fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, value: dict) -> bool:
        """Makes this file, unless it is there already: of several writers one succeeds."""
        place, fs = self._fs()
        if fs.exists(place):
            return False
        try:
            stream = fs.create(place, False)
        except Exception as e:
            if "already exists" in str(e).lower() or "FileAlreadyExists" in str(e):
                return False
            raise
        self._fill(stream, value)
        return True

    def replace(self, value: dict) -> None:
        """Writes beside this file, then renames onto it: readers see the old or the new one."""
        place, fs = self._fs()
        aside = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}.new")
        self._fill(fs.create(aside, True), value)
        fs.delete(place, False)
        if not fs.rename(aside, place):
            raise OSError(f"can't write {self.path}")

    @staticmethod
    def _fill(stream, value: dict) -> None:
        try:
            stream.write(bytearray(json.dumps(value, default=str).encode()))
        finally:
            stream.close()
