"""Small files and folders in whatever storage Spark reaches, through Hadoop's file system API."""

from __future__ import annotations

import json
import re
import time
import uuid
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

from granary.errors import LockError

#: Seconds after which a lock counts as left behind by a writer that died; a live one holds it only while it renames a file.
LOCK_AGE = 300.0


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self.root = self.qualified(root)

    def located(self, name: str):
        """The file system and path of an absolute path, or of a name below the root."""
        absolute = name.startswith("/") or re.match(r"[A-Za-z][\w+.-]*:", name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name if absolute or name == self.root else f"{self.root}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def qualified(self, name: str) -> str:
        """A path with its scheme and authority; a relative root is taken from the working directory once and for all."""
        fs, path = self.located(name)
        return fs.makeQualified(path).toString().rstrip("/")

    def uri(self, name: str) -> str:
        """A path the way Spark reports those of files: qualified and URL-encoded."""
        fs, path = self.located(name)
        return fs.makeQualified(path).toUri().toString().rstrip("/")

    def exists(self, name: str = "") -> bool:
        fs, path = self.located(name or self.root)
        return fs.exists(path)

    def create(self, name: str, text: str) -> bool:
        """Write a new file; False if it is there already."""
        fs, path = self.located(name)
        if fs.exists(path):
            return False
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text, "utf-8"))
        out.close()
        return True

    def publish(self, name: str, text: str) -> bool:
        """A new file that comes into sight whole: written aside, then renamed without overwriting. False if the name is taken.

        The rename is atomic on HDFS and local disks. A store without one, such
        as an object store, relies on the writer's lock around this.
        """
        aside = f".{name}.{uuid.uuid4().hex}"
        self.create(aside, text)
        fs, source = self.located(aside)
        jvm = self.spark._jvm
        files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self.spark._jsc.hadoopConfiguration())
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            files.rename(source, self.located(name)[1], none)
        except Py4JJavaError as e:
            self.delete(aside)
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def read(self, name: str) -> str:
        fs, path = self.located(name)
        stream = fs.open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def names(self, folder: str = "") -> list[str]:
        fs, path = self.located(folder or self.root)
        return [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []

    def size(self, name: str) -> int:
        fs, path = self.located(name)
        return fs.getContentSummary(path).getLength() if fs.exists(path) else 0

    def age(self, name: str) -> float:
        """Seconds since a file was written; 0 if it is gone."""
        fs, path = self.located(name)
        return time.time() - fs.getFileStatus(path).getModificationTime() / 1000 if fs.exists(path) else 0.0

    def delete(self, name: str) -> None:
        fs, path = self.located(name)
        fs.delete(path, True)

    def folder(self, table: str) -> str:
        """A fresh name, below the root, for a table's rows."""
        return f"data/{re.sub('[^a-z0-9_]', '_', table.lower())}-{uuid.uuid4().hex}"

    def versions(self) -> list[int]:
        return sorted(int(n[9:-5]) for n in self.names() if n.startswith("manifest-") and n.endswith(".json") and n[9:-5].isdigit())

    def manifest(self, version: int) -> dict:
        return json.loads(self.read(f"manifest-{version}.json"))

    def commit(self, version: int, manifest: dict) -> bool:
        """Publish a version: readers see all of it or nothing, and of two writers one fails."""
        return self.publish(f"manifest-{version}.json", json.dumps(manifest))

    @contextmanager
    def lock(self, timeout: float = 5.0, respect: bool = True, stale: float = LOCK_AGE):
        """One writer at a time, by a file beside the manifests that holds its writer's token. Only that writer removes it, or one that finds it older than `stale` seconds."""
        token, until, ours = uuid.uuid4().hex, time.time() + timeout, False
        while not (ours := self.create("writer.lock", token)):
            if not respect:
                break
            if self.age("writer.lock") > stale:
                self.delete("writer.lock")
                continue
            if time.time() > until:
                raise LockError(f"{self.root} is locked by another writer")
            time.sleep(0.05)
        try:
            yield
        finally:
            if ours and self.exists("writer.lock") and self.read("writer.lock") == token:
                self.delete("writer.lock")
