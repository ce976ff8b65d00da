"""Files by Hadoop's file system API, so that a path may be on any store that the cluster reads."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from typing import Any

from pyspark.sql import SparkSession


_LOCAL: dict[str, str] = {}  # by application


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: the one of spark.checkpoint.dir, in local mode a temporary one of the application if that is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, _LOCAL[app], ignore_errors=True)
    return _LOCAL[app]


class Files:
    def __init__(self, spark: SparkSession) -> None:
        self.jvm: Any = spark.sparkContext._jvm
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str) -> tuple[Any, Any]:
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """The file is either the old or the new one at any time, where the store renames atomically."""
        fs, p = self._at(path)
        new = self.jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.new")  # readers of the folder don't see it
        stream = fs.create(new, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 1)
        options[0] = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        context.rename(new, p, options)

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def temporary(self, path: str) -> str:
        """Makes a folder that goes when the application ends."""
        fs, p = self._at(path)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        return path

    def move(self, path: str, to: str) -> None:
        fs, p = self._at(path)
        target = self.jvm.org.apache.hadoop.fs.Path(to)
        fs.mkdirs(target.getParent())
        if not fs.rename(p, target):
            raise OSError(f"{path} can't be moved to {to}")
