"""Small files on any file system that Hadoop knows: manifests, logs and their atomic publication."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def local_path(uri: str) -> str | None:
    """The path of a local URI, None for another file system's."""
    u = urlparse(uri)
    return u.path if u.scheme == "file" else None


class Files:
    """A folder and what stands in it. Paths without a scheme are those of the session's default file system."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        path = self.jvm.org.apache.hadoop.fs.Path(root)
        self.fs = path.getFileSystem(self.conf)
        self.root = self.fs.makeQualified(path).toString().rstrip("/")
        if self.root.startswith("file:/") and not self.root.startswith("file:///"):
            self.root = "file://" + self.root[len("file:") :]
        self.fs.mkdirs(self.at(""))

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}"

    def read(self, name: str) -> str | None:
        """The text of a file, None where there is none."""
        try:
            s = self.fs.open(self.at(name))
        except Exception as e:  # noqa: BLE001 - a Java exception
            if "FileNotFoundException" in str(e) or "NoSuchFile" in str(e):
                return None
            raise
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode("utf-8")
        finally:
            s.close()

    def _temporary(self, name: str, text: str) -> str:
        tmp = f"{name}.{uuid.uuid4().hex}.tmp"
        s = self.fs.create(self.at(tmp), True)
        try:
            s.write(bytearray(text, "utf-8"))
            s.hsync()
        finally:
            s.close()
        return tmp

    def _rename(self, old: str, new: str, over: bool) -> None:
        fs = self.jvm.org.apache.hadoop.fs
        how = self.gateway.new_array(fs.Options.Rename, 1)
        how[0] = fs.Options.Rename.OVERWRITE if over else fs.Options.Rename.NONE
        fs.FileContext.getFileContext(self.at("").toUri(), self.conf).rename(self.at(old), self.at(new), how)

    def publish(self, name: str, text: str) -> None:
        """Replaces a file: readers see the old or the new one."""
        tmp = self._temporary(name, text)
        self._rename(tmp, name, True)

    def claim(self, name: str, text: str) -> bool:
        """Creates a file with all its text, or gives False where another writer has created it."""
        tmp = self._temporary(name, text)
        try:
            here = local_path(self.root)
            if here is not None:  # a local rename looks before it writes, a link doesn't need to
                os.link(os.path.join(here, tmp), os.path.join(here, name))
                return True
            self._rename(tmp, name, False)
            return True
        except FileExistsError:
            return False
        except Exception as e:  # noqa: BLE001 - a Java exception
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        finally:
            self.fs.delete(self.at(tmp), False)

    def names(self, folder: str = "") -> list[tuple[str, int]]:
        """(name, time of change in ms) of what stands in a folder."""
        if not self.fs.exists(self.at(folder)):
            return []
        return [(s.getPath().getName(), s.getModificationTime()) for s in self.fs.listStatus(self.at(folder))]

    def remove(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def now(self) -> int:
        return self.jvm.java.lang.System.currentTimeMillis()


def arrow_filesystem(uri: str):
    """(file system, path) for pyarrow."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
