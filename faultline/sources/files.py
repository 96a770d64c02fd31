"""Small files next to the tables, in whatever store the session reads."""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import SparkSession


class Folder:
    """Numbered JSON files of one folder; each appears at once and is never written over."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._path = self._jvm.org.apache.hadoop.fs.Path
        self.path = path.rstrip("/")
        self._fs = self._path(self.path).getFileSystem(
            spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """Numbers of the files there are, rising."""
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{self.path}/{number}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)))
        finally:
            stream.close()

    def write(self, number: int, value: dict, replace: bool = False) -> None:
        """The file is complete before it gets its name; a name that is taken is refused."""
        target = self._path(f"{self.path}/{number}.json")
        if replace:
            self._fs.delete(target, False)
        draft = self._path(f"{self.path}/.{number}-{uuid.uuid4().hex}.draft")
        stream = self._fs.create(draft, True)
        try:
            stream.write(json.dumps(value).encode())
        finally:
            stream.close()
        try:
            taken = self._fs.exists(target) or not self._named(draft, target)
        finally:
            self._fs.delete(draft, False)
        if taken:
            raise FileExistsError(f"{self.path}/{number}.json was written meanwhile")

    def _named(self, draft, target) -> bool:
        """Gives the draft its name unless that is taken. On a local disk a rename would replace a
        file that another writer has just named; a link does not."""
        if self._fs.getScheme() != "file":
            return self._fs.rename(draft, target)
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        except OSError:  # a disk without links
            return self._fs.rename(draft, target)
        return True

    def remove(self, number: int) -> None:
        self._fs.delete(self._path(f"{self.path}/{number}.json"), False)

    def folders(self, path: str) -> list[str]:
        """Names of the folders below ``path``."""
        where = self._path(path)
        if not self._fs.exists(where):
            return []
        return sorted(f.getPath().getName() for f in self._fs.listStatus(where) if f.isDirectory())

    def delete_folder(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
