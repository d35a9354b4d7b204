"""Small files through Spark's file systems, so a path may be in any store that Spark reads."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def _at(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        system, path = self._at(name)
        return system.exists(path)

    def read_text(self, name: str) -> str | None:
        """The file's text; None if there is none."""
        system, path = self._at(name)
        if not system.exists(path):
            return None
        stream = system.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
        except Py4JJavaError as error:
            raise OSError(f"can't read {self.path(name)}") from error
        finally:
            stream.close()

    def write_text(self, name: str, text: str) -> None:
        """The whole file or none of it: written beside its place, then renamed."""
        system, path = self._at(name)
        _, draft = self._at(f"_{name}.tmp")
        stream = system.create(draft, True)
        stream.write(bytearray(text.encode("utf-8")))
        stream.close()
        if system.exists(path):
            system.delete(path, False)
        if not system.rename(draft, path):
            raise OSError(f"can't rename to {self.path(name)}")

    def clear(self) -> None:
        system, path = self._at("")
        system.delete(path, True)
