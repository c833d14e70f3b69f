"""Small files and folders on the file systems Spark can reach."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """The few file operations needed, on whatever file system the path names."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def names(self, path: str) -> list[str]:
        folder = self._path(path)
        return [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []

    def size(self, path: str) -> int:
        """Bytes in a file or folder."""
        return self._fs.getContentSummary(self._path(path)).getLength()

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_new(self, path: str, text: str) -> bool:
        """Write a file that must not exist yet; False when somebody else wrote it first."""
        target = self._path(path)
        draft = self._path(f"{path[: path.rindex('/')]}/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        # The rename shows the file whole or not at all.
        if self._fs.exists(target) or not self._fs.rename(draft, target):
            self._fs.delete(draft, False)
            return False
        return True

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)
