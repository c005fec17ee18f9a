"""The few file operations that tables need beside reading and writing, in any store Spark knows."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class HadoopFiles:
    """Names and moves in the store of ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._gateway = spark.sparkContext._gateway
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        self._store = self._path(root).getFileSystem(configuration)
        self._context = self._hadoop.FileContext.getFileContext(self._store.getUri(), configuration)

    def _path(self, name: str):
        return self._hadoop.Path(name)

    def names(self, folder: str, ending: str) -> list[str]:
        """The files of a folder with that ending, which is made of few files."""
        found = (status.getPath().getName() for status in self._store.listStatus(self._path(folder)))
        return sorted(name for name in found if name.endswith(ending))

    def stamps(self, path: str) -> list[tuple[str, int, int]]:
        """(name, length, time of modification) of a file, or of all files under a folder."""
        found, out = self._store.listFiles(self._path(path), True), []
        while found.hasNext():
            status = found.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
        return out

    def make_folder(self, folder: str) -> None:
        self._store.mkdirs(self._path(folder))

    def renamed(self, old: str, new: str) -> bool:
        """Whether ``old`` could be moved to ``new``; never over a file that is there."""
        options = self._gateway.new_array(getattr(self._hadoop, "Options$Rename"), 0)
        qualified = (self._store.makeQualified(self._path(name)) for name in (old, new))
        try:
            self._context.rename(*qualified, options)
        except Py4JJavaError as error:
            if error.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                raise
            return False
        return True
