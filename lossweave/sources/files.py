"""Small files and renames through the file system that Spark itself uses, so that paths may be local or shared."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: str | None = None


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name beneath spark.checkpoint.dir; a folder of this machine only in a local session without that setting."""
    global _own
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if _own is None:
            _own = tempfile.mkdtemp(prefix="lossweave-")
            atexit.register(shutil.rmtree, _own, True)
        root = f"file://{_own}"
    return f"{root.rstrip('/')}/lossweave/{uuid.uuid4().hex}/{name}"


class Files:
    """Paths of any Hadoop file system, from the driver."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        fs, at = self._at(path)
        return fs.exists(at)

    def names(self, path: str) -> list[str] | None:
        """Names in a folder, sorted; None for what is no folder."""
        fs, at = self._at(path)
        if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
            return None
        return sorted(s.getPath().getName() for s in fs.listStatus(at))

    def fingerprint(self, path: str) -> dict[str, object]:
        """Path, bytes and time of the last change; of a folder, of its files."""
        fs, at = self._at(path)
        status = fs.getFileStatus(at)
        every = list(fs.listStatus(at)) if status.isDirectory() else [status]
        return {"path": path, "size": sum(s.getLen() for s in every), "mtime_ns": max([s.getModificationTime() for s in every], default=0) * 1_000_000}

    def read(self, path: str) -> str:
        fs, at = self._at(path)
        stream = fs.open(at)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def write(self, path: str, text: str) -> None:
        """Written beside, then swapped in: readers see all or nothing."""
        fs, at = self._at(f"{path}.tmp")
        stream = fs.create(at, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        self.swap(f"{path}.tmp", path)

    def delete(self, path: str) -> None:
        fs, at = self._at(path)
        fs.delete(at, True)

    def rename(self, a: str, b: str) -> None:
        fs, at = self._at(a)
        if not fs.rename(at, self._at(b)[1]):
            raise OSError(f"cannot rename {a} to {b}")

    def swap(self, new: str, path: str) -> None:
        """Put ``new`` in place of ``path``; the old one goes only after that, and comes back if it fails."""
        old = f"{path}.old"
        if self.exists(path):
            self.delete(old)
            self.rename(path, old)
        try:
            self.rename(new, path)
        except Exception:
            self.recover(path)
            raise
        self.delete(old)

    def recover(self, path: str) -> None:
        """Bring back what a swap that was cut off has set aside."""
        if not self.exists(path) and self.exists(f"{path}.old"):
            self.rename(f"{path}.old", path)

    def join(self, folder: str, path: str) -> None:
        """One file from a folder's parts in the order of their names."""
        fs, at = self._at(f"{path}.tmp")
        out = fs.create(at, True)
        try:
            for name in self.names(folder) or ():
                if name.startswith("part-"):
                    source, part = self._at(f"{folder}/{name}")
                    stream = source.open(part)
                    try:
                        self._jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, 1 << 20, False)
                    finally:
                        stream.close()
        finally:
            out.close()
        self.swap(f"{path}.tmp", path)
