"""Small metadata files on any Hadoop file system, by the driver."""

from __future__ import annotations

import random
import re
import tempfile
import time
from collections.abc import Callable
from functools import wraps

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

# Tries of a call that fails for a while, and the first and the longest wait between them in seconds.
TRIES, FIRST_S, MOST_S = 5, 0.1, 10.0
_LASTING = re.compile(r"FileNotFound|NoSuchFile|AlreadyExists|AccessControl|AccessDenied|Forbidden|NotDirectory|IllegalArgument", re.IGNORECASE)


def passing(error: Exception) -> bool:
    """Whether the same call may succeed later: any failed I/O but missing or taken names and refused access."""
    text = str(error.java_exception.toString()) if isinstance(error, Py4JJavaError) else f"{type(error).__name__}: {error}"
    return ("IOException" in text or "Timeout" in text or "Connect" in text or "SdkClient" in text or isinstance(error, OSError)) and not _LASTING.search(text)


def retried(call: Callable, sleep: Callable[[float], None] = time.sleep) -> Callable:
    """`call`, which must be safe to repeat, with waits that double, less a random part up to half."""

    @wraps(call)
    def often(*args, **named):
        for i in range(TRIES):
            try:
                return call(*args, **named)
            except Exception as e:
                if i == TRIES - 1 or not passing(e):
                    raise
                sleep(min(MOST_S, FIRST_S * 2**i) * random.uniform(0.5, 1.0))

    return often


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only where that is unset and all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and spark.sparkContext.master.partition("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return base or tempfile.mkdtemp(prefix="eventlake-")


class Files:
    """Reads and deletions are tried again when the store fails for a while; `create` isn't, since its rename tells who was first."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, path: str):
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self, path: str):
        return self._path(path).getFileSystem(self._conf)

    @retried
    def exists(self, path: str) -> bool:
        return self._fs(path).exists(self._path(path))

    @retried
    def list(self, path: str) -> list[str]:
        """Names in a directory; nothing if there is none."""
        return sorted(s.getPath().getName() for s in self._fs(path).listStatus(self._path(path))) if self.exists(path) else []

    @retried
    def read(self, path: str) -> str:
        stream = self._fs(path).open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    @retried
    def read_bytes(self, path: str) -> bytes:
        stream = self._fs(path).open(self._path(path))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    @retried
    def write(self, path: str, raw: bytes) -> None:
        """A file under a name that nobody else uses; a second try replaces a part of the first."""
        stream = self._fs(path).create(self._path(path), True)
        try:
            for i in range(0, len(raw), 1 << 20):
                stream.write(bytearray(raw[i : i + (1 << 20)]))
        finally:
            stream.close()

    def create(self, path: str, text: str, scratch: str) -> bool:
        """Writes the file whole, under its own name only when complete; False if the name is taken."""
        fs, temp, final = self._fs(path), self._path(f"{path}.{scratch}.tmp"), self._path(path)
        stream = fs.create(temp, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(temp.toUri(), self._conf)
            none = getattr(self._jvm, "org.apache.hadoop.fs.Options$Rename").NONE
            many = self._jvm.java.lang.reflect.Array.newInstance(none.getClass(), 1)
            many[0] = none
            context.rename(fs.makeQualified(temp), fs.makeQualified(final), many)
            return True
        except Py4JJavaError as e:
            fs.delete(temp, False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise

    @retried
    def delete(self, path: str) -> None:
        self._fs(path).delete(self._path(path), True)
