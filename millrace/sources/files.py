"""Listing, reading and atomic writing of small control files on any file system that Spark reaches."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """A thin wrapper of Hadoop's file system API, so paths of any store work alike."""

    def __init__(self, spark: SparkSession):
        self._jvm = spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    def glob(self, pattern: str) -> list[str]:
        """Matching paths in order; none if the folder is missing."""
        found = self._fs(pattern).globStatus(self._path(pattern))
        return sorted(s.getPath().toString() for s in found) if found else []

    def name(self, path: str) -> str:
        """A file's name as Spark's ``_metadata.file_name`` has it, with escapes."""
        return self._path(path).toUri().getRawPath().rsplit("/", 1)[-1]

    def size(self, path: str) -> int:
        return self._fs(path).getFileStatus(self._path(path)).getLen()

    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Write beside the place, then rename: readers see all of it or nothing."""
        fs, temporary = self._fs(path), self._path(path + ".tmp")
        fs.mkdirs(self._path(path).getParent())
        stream = fs.create(temporary, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.move(path + ".tmp", path)

    def move(self, source: str, target: str) -> None:
        fs = self._fs(target)
        if fs.exists(self._path(target)):
            fs.delete(self._path(target), True)
        fs.mkdirs(self._path(target).getParent())
        if not fs.rename(self._path(source), self._path(target)):
            raise OSError(f"could not rename {source} to {target}")

    def copy(self, source: str, target: str) -> None:
        """Copy beside the place, then rename."""
        util = self._jvm.org.apache.hadoop.fs.FileUtil
        self._fs(target).mkdirs(self._path(target).getParent())
        if not util.copy(self._fs(source), self._path(source), self._fs(target), self._path(target + ".tmp"), False, True, self._conf):
            raise OSError(f"could not copy {source}")
        self.move(target + ".tmp", target)

    def passing(self, path: str) -> None:
        """Make a folder that goes when the application ends."""
        fs, where = self._fs(path), self._path(path)
        fs.mkdirs(where)
        fs.deleteOnExit(where)

    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
