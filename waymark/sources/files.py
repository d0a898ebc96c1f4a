"""Files and folders through Hadoop's file systems, so that layouts may lie wherever Spark can read and write."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import SparkSession


class Entry(NamedTuple):
    path: str
    name: str
    is_dir: bool
    size: int


class Files:
    """What layouts need of a file system; paths are strings, and a rename is atomic as far as the file system has it so."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._fs = self._path(root).getFileSystem(self._conf)

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def qualified(self, path: str) -> str:
        return self._fs.makeQualified(self._path(path)).toString()

    def exists(self, path: str) -> bool:
        return self._fs.exists(self._path(path))

    def list(self, path: str) -> list[Entry]:
        """Entries of a folder by name, without those that begin with a dot; none if there is no such folder."""
        if not self.exists(path):
            return []
        found = [Entry(f"{path.rstrip('/')}/{s.getPath().getName()}", s.getPath().getName(), s.isDirectory(), s.getLen()) for s in self._fs.listStatus(self._path(path))]
        return sorted((e for e in found if not e.name.startswith(".")), key=lambda e: e.name)

    def rename(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot rename {source} to {target}")

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def make(self, path: str) -> None:
        self._fs.mkdirs(self._path(path))

    def read_text(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write_text(self, path: str, text: str) -> None:
        """Write beside the target and rename, so that no reader sees half a file."""
        part = f"{path}.part"
        stream = self._fs.create(self._path(part), True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if self.exists(path):
            self.remove(path)
        self.rename(part, path)
        folder, name = path.rsplit("/", 1)
        self.remove(f"{folder}/.{name}.crc")  # so that the text may be edited by hand

    def rows_in_footers(self, folder: str) -> dict[str, int]:
        """Rows of each Parquet file in a folder, from the footers alone."""
        out = {}
        reader = self._jvm.org.apache.parquet.hadoop.ParquetFileReader
        for e in self.list(folder):
            if e.name.endswith(".parquet") and not e.is_dir:
                source = self._jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(self._path(e.path), self._conf)
                opened = reader.open(source)
                out[e.path] = int(opened.getRecordCount())
                opened.close()
        return out
