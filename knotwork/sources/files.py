"""Small files and folders in any store that Spark opens, by its Hadoop file systems."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class Folder:
    """A folder by a local path or a URI; its names are relative to it."""

    def __init__(self, spark: SparkSession, path: str | os.PathLike):
        path = os.fspath(path)
        self.uri = (path if "://" in path else f"file://{os.path.abspath(path)}").rstrip("/")
        self._jvm, self._gateway = spark._jvm, spark.sparkContext._gateway
        self._fs = self._path().getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(self.at(name))

    def at(self, name: str = "") -> str:
        return f"{self.uri}/{name}" if name else self.uri

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode("utf-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """Replace a file: written beside it, then renamed."""
        other = self._path(f"{name}.new")
        stream = self._fs.create(other, True)
        try:
            data = text.encode("utf-8")
            for i in range(0, len(data), 1 << 20):
                stream.write(bytearray(data[i : i + (1 << 20)]))
        finally:
            stream.close()
        self._replace(other, name)

    def head(self, name: str, most: int) -> bytes:
        """The first bytes of a file."""
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readNBytes(most))
        finally:
            stream.close()

    def parts(self, name: str = "") -> list[tuple[str, int]]:
        """Names and sizes of the part files of a table, in the order of its partitions, without empty ones."""
        found = [(f"{name}/{f.getPath().getName()}" if name else f.getPath().getName(), f.getLen()) for f in self._fs.listStatus(self._path(name))]
        return sorted((n, size) for n, size in found if n.rpartition("/")[2].startswith("part-") and size)

    def _unpacked(self, name: str):
        """The stream of a file, by gzip if it is named so."""
        stream = self._fs.open(self._path(name))
        return self._jvm.java.util.zip.GZIPInputStream(stream) if name.endswith(".gz") else stream

    def unpacked_size(self, name: str) -> int:
        stream = self._unpacked(name)
        try:
            return self._jvm.org.apache.commons.io.IOUtils.consume(stream)
        finally:
            stream.close()

    def join(self, name: str, pieces: list[str | tuple[Folder, str, int]]) -> None:
        """Replace a file by texts and first bytes (folder, name, number; all bytes by -1) of other files, which are unpacked and copied by the
        file systems, a buffer at a time."""
        other = self._path(f"{name}.new")
        out = self._fs.create(other, True)
        try:
            for piece in pieces:
                if isinstance(piece, str):
                    out.write(bytearray(piece.encode("utf-8")))
                    continue
                folder, part, size = piece
                stream = folder._unpacked(part)
                try:
                    self._jvm.org.apache.commons.io.IOUtils.copyLarge(stream, out, 0, size)
                finally:
                    stream.close()
        finally:
            out.close()
        self._replace(other, name)

    def _replace(self, other, name: str) -> None:
        """One rename over the old file, which stores with such a rename do at once, so readers find the old or the new one."""
        over = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        how = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        how[0] = over
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        context.rename(other, self._path(name), how)

    def delete(self, name: str = "") -> bool:
        return self._fs.delete(self._path(name), True)

    def count(self, suffix: str, name: str = "") -> int:
        """Files below with this suffix."""
        if not self.exists(name):
            return 0
        found, n = self._fs.listFiles(self._path(name), True), 0
        while found.hasNext():
            n += found.next().getPath().getName().endswith(suffix)
        return n
