"""Small files in any file system that Spark reads, through its own file system layer."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

#: Folder of intermediate tables where a local session names none.
LOCAL = "file:///tmp/palimpsest-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (driver and executors are one process) gets a local folder; a cluster's session
    is an error, as each machine would write to its own disk.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = LOCAL
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: Folders of intermediate tables that this process has made and not yet released, oldest first.
_MADE: list[str] = []


def scratch(spark: SparkSession, name: str = "") -> str:
    """A new path for an intermediate table in the shared folder; release() deletes it."""
    at = f"{shared_dir(spark)}/palimpsest/{uuid.uuid4().hex}"
    _MADE.append(at)
    return f"{at}/{name}" if name else at


def mark() -> int:
    """The number of intermediate folders so far, for release()."""
    return len(_MADE)


def release(spark: SparkSession, since: int = 0, but: tuple[str, ...] = ()) -> int:
    """Deletes the intermediate folders made from ``since`` (a mark()) on, apart from the paths ``but``; returns how many.

    Call it when the results that read them have been written.
    """
    files, gone = Files(spark), 0
    kept = {p for p in _MADE[since:] if any(b.startswith(p) for b in but)}
    for path in _MADE[since:]:
        if path not in kept:
            files.delete(path)
            gone += 1
    _MADE[since:] = [p for p in _MADE[since:] if p in kept]
    return gone


class Files:
    def __init__(self, spark: SparkSession):
        self.spark, self._jvm = spark, spark.sparkContext._jvm

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def names(self, path: str) -> list[str]:
        """Names in a folder, sorted; none if there is no such folder."""
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def size(self, path: str) -> int:
        """Bytes of a file or of all files below a folder; 0 if there is none."""
        fs, p = self._at(path)
        return int(fs.getContentSummary(p).getLength()) if fs.exists(p) else 0

    def modified(self, path: str) -> float:
        """Seconds since 1970 of the last change; now if the path is gone."""
        fs, p = self._at(path)
        return fs.getFileStatus(p).getModificationTime() / 1000 if fs.exists(p) else time.time()

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        stream = fs.open(p)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str, overwrite: bool = False) -> None:
        """Writes a file; an existing one is an error (FileExistsError) unless ``overwrite``."""
        fs, p = self._at(path)
        if not overwrite and fs.exists(p):
            raise FileExistsError(path)
        stream = fs.create(p, overwrite)
        stream.write(bytearray(text.encode()))
        stream.close()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)
