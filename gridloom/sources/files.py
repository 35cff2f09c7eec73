"""Small files in a shared folder, published so that nobody sees half of one."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class VersionConflict(RuntimeError):
    """Somebody else published the version this writer was about to publish."""


class Folder:
    """A folder, through the file system Spark itself uses."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self.path = path
        self._fs = self._hadoop(path).getFileSystem(self._conf)

    def _hadoop(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, below: str) -> list[str]:
        path = self._hadoop(f"{self.path}/{below}")
        if not self._fs.exists(path):
            return []
        return [s.getPath().getName() for s in self._fs.listStatus(path)]

    def size(self, below: str) -> int:
        """Bytes of all files below a folder."""
        return self._fs.getContentSummary(self._hadoop(f"{self.path}/{below}")).getLength()

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._hadoop(f"{self.path}/{name}"))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._hadoop(f"{self.path}/{name}"))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> None:
        """Publish a file that must not exist yet.

        It is written whole under another name and then renamed without overwriting, so a
        writer that stops on the way leaves nothing a reader would take for a version.
        """
        target = self._hadoop(f"{self.path}/{name}")
        draft = self._hadoop(f"{self.path}/_drafts/{uuid.uuid4().hex}")
        stream = self._fs.create(draft, False)
        try:
            stream.write(bytearray(text, "utf-8"))
        finally:
            stream.close()
        try:
            self._rename(draft, target)
        except Exception as error:
            self._fs.delete(draft, False)
            if self._fs.exists(target):
                raise VersionConflict(name) from error
            raise

    def _rename(self, draft, target) -> None:
        self._fs.mkdirs(target.getParent())
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri(), self._conf)
        kind = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename")
        files.rename(
            self._fs.makeQualified(draft),
            self._fs.makeQualified(target),
            self._gateway.new_array(kind, 0),
        )

    def numbers(self, below: str) -> list[int]:
        """The numbers n of all ``<n>.json``, the largest first."""
        found = [n[:-5] for n in self.names(below) if n.endswith(".json")]
        return sorted((int(n) for n in found if n.isdigit()), reverse=True)

    def latest(self, below: str) -> int:
        """The highest ``<n>.json`` there is, 0 when there is none."""
        return max(self.numbers(below), default=0)
