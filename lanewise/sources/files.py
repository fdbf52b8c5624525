"""Small files beside the log (owners, checkpoints, commit markers, attachments) on any file system that Spark reaches,
and the folder that all executors share."""

from __future__ import annotations

import json
import re
import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

SCHEMES = ("file", "hdfs", "abfss", "viewfs")


def scheme_of(root: str) -> str | None:
    """The scheme of a URI; None for a plain path, a drive letter included."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]+):", root)
    return found[1].lower() if found else None


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where all runs on one machine."""
    context = spark.sparkContext
    if named := context.getConf().get("spark.checkpoint.dir"):
        return named
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="spark-shared-")


def checkpointed(df: DataFrame) -> DataFrame:
    """df, written to the shared folder, with its lineage cut."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


class Files:
    """Create-once files under a root; the root's scheme chooses the file system."""

    def __init__(self, spark: SparkSession, root: str):
        if not isinstance(root, str):
            raise TypeError(f"the root is a path or URI, not {type(root).__name__}")
        scheme = scheme_of(root) or "file"
        if scheme not in SCHEMES:
            hint = "; object stores without a rename that fails if there is such a file can't keep leases" if scheme in ("s3", "s3a", "gs") else ""
            raise ValueError(f"{root!r}: the scheme must be one of {SCHEMES}, or none for a local folder{hint}")
        self.jvm, self.root = spark._jvm, root.rstrip("/")
        #: How many names have been listed so far.
        self.listed = 0
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self._path("").getFileSystem(self.conf)
        self.local = self.fs.getUri().getScheme() == "file"
        # FileContext's rename refuses a name that is taken, in one step where the file system has one
        self.context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        self.never = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)

    def _path(self, name: str):
        if name.startswith("/") or ".." in name.split("/"):
            raise ValueError(f"not a name under the root: {name!r}")
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def create(self, name: str, data: bytes) -> bool:
        """False if there is such a file already; that is the only condition writers need. Others see the whole file
        or none: it is written beside and renamed."""
        path = self._path(name)
        if self.fs.exists(path):
            return False
        beside = self._path(f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}".lstrip("/"))
        out = self.fs.create(beside, False)
        out.write(bytearray(data))
        out.close()
        try:
            if self.local:  # whose rename would replace a file that has come in between; a link doesn't
                nio = self.jvm.java.nio.file
                one, two = (nio.Paths.get(self.fs.makeQualified(x).toUri()) for x in (path, beside))
                nio.Files.createLink(one, two)
            else:
                self.context.rename(beside, path, self.never)
            return True
        except Exception as error:
            if self.fs.exists(path):  # another was faster
                return False
            raise error
        finally:
            if self.fs.exists(beside):
                self.fs.delete(beside, False)

    def read(self, name: str) -> bytes | None:
        if not self.fs.exists(self._path(name)):
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def names(self, folder: str) -> list[str]:
        """Sorted names right under a folder, but hidden ones."""
        path = self._path(folder)
        found = [x.getPath().getName() for x in self.fs.listStatus(path)] if self.fs.exists(path) else []
        self.listed += len(found)
        return sorted(x for x in found if not x.startswith("."))

    def missing(self, names: list[str]) -> list[str]:
        """Those of some names that don't exist, asked for side by side."""
        with ThreadPoolExecutor(16) as pool:
            return [name for name, there in zip(names, pool.map(lambda name: self.fs.exists(self._path(name)), names)) if not there]

    def any(self, folder: str) -> bool:
        """Whether there is anything under a folder; its names aren't listed."""
        path = self._path(folder)
        return self.fs.exists(path) and self.fs.listStatusIterator(path).hasNext()

    def delete(self, name: str) -> bool:
        return self.fs.delete(self._path(name), True)

    def load(self, name: str) -> dict | None:
        data = self.read(name)
        return None if data is None else json.loads(data)

    def save(self, name: str, record: dict) -> bool:
        return self.create(name, json.dumps(record, sort_keys=True).encode())
