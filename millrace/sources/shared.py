"""The folder that all executors share, files in it through Spark's own file systems, and written intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_shipped: set[str] = set()


def ship(spark: SparkSession | None = None) -> None:
    """Sends the package's source to the executors' Python workers, once for each Spark application."""
    sc = (spark or SparkSession.getActiveSession()).sparkContext
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    folder = tempfile.mkdtemp(prefix="millrace-code-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/millrace_code.zip", "w") as z:
        for d, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    z.write(f"{d}/{name}", os.path.relpath(f"{d}/{name}", os.path.dirname(top)))
    sc.addPyFile(f"{folder}/millrace_code.zip")
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset on a single machine, a temporary folder of this process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="millrace-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        spark.sparkContext.setCheckpointDir(_own[0])
    return f"file://{_own[0]}"


def new_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/millrace-{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df written once and read back: cuts lineage and survives lost executors."""
    path = new_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Files:
    """Small text files below a folder of any Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark._jvm
        self.root = root
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def create(self, name: str, text: str) -> None:
        """Fails if the file is there already."""
        if self._fs.exists(self._path(name)):
            raise FileExistsError(name)
        part = self._path(f"{name}.{uuid.uuid4().hex}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if not self._fs.rename(part, self._path(name)):
            self._fs.delete(part, False)
            raise FileExistsError(name)

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
