"""Small files and folders on whatever file system Hadoop knows, from the driver."""

from __future__ import annotations

from pyspark.sql import SparkSession

from docmill.errors import Conflict


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def create(self, path: str, text: str) -> None:
        """Write a file that must not exist yet; if it does, another writer was first.

        Creation is exclusive; where a file only appears when it is closed, as in object stores, that is asked of the
        close. Text may be there in part until then: readers of JSON take what does not parse as not there yet.
        """
        fs, p = self._at(path)
        try:
            out = fs.createFile(p).overwrite(False).recursive().opt("fs.option.create.conditional.overwrite", "true").build()
            out.write(text.encode())
            out.close()
        except Exception as e:
            if fs.exists(p):
                raise Conflict(f"{path} exists already") from e
            raise

    def replace(self, path: str, text: str) -> None:
        fs, p = self._at(path)
        out = fs.create(p, True)
        out.write(text.encode())
        out.close()

    def read(self, path: str) -> str | None:
        fs, p = self._at(path)
        if not fs.exists(p):
            return None
        stream = fs.open(p)
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def age(self, path: str) -> float:
        """Seconds since a file was written."""
        fs, p = self._at(path)
        return self.jvm.System.currentTimeMillis() / 1000 - fs.getFileStatus(p).getModificationTime() / 1000

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def remove(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
