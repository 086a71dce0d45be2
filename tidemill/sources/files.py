"""Small files on any Hadoop file system: atomic texts, exclusive locks, listings."""

from __future__ import annotations

from pyspark.sql import SparkSession


class Files:
    """Paths may be local or any URI that Spark reads."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return p.getFileSystem(self._conf), p

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def read(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Creates a file unless it exists."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception as e:  # a Py4J error that wraps the file system's own
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def write(self, path: str, text: str) -> None:
        """Replaces a file by renaming a complete one to its name."""
        fs, p = self._at(path)
        temporary = f"{path}.tmp"
        _, t = self._at(temporary)
        out = fs.create(t, True)
        out.write(bytearray(text.encode()))
        out.close()
        if not fs.rename(t, p):  # file systems whose rename doesn't replace
            fs.delete(p, False)
            if not fs.rename(t, p):
                raise OSError(f"can't write {path}")

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        _, q = self._at(new)
        fs.mkdirs(q.getParent())
        if not fs.rename(p, q):
            raise OSError(f"can't rename {old} to {new}")

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def walk(self, path: str, suffix: str) -> list[str]:
        fs, p = self._at(path)
        if not fs.exists(p):
            return []
        found, it = [], fs.listFiles(p, True)
        while it.hasNext():
            x = it.next().getPath().toString()
            if x.endswith(suffix):
                found.append(x)
        return sorted(found)

    def sha256(self, path: str) -> str:
        """Digest of a file's bytes, streamed."""
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return self._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def copy(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        to, q = self._at(f"{new}.tmp")
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, p, to, q, False, True, self._conf)
        _, final = self._at(new)
        if to.exists(final):
            to.delete(final, False)
        to.rename(q, final)
