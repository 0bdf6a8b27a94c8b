"""Small files on any file system that Spark can reach."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.sc, self.jvm, self.root = spark.sparkContext, spark.sparkContext._jvm, root.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def names(self, folder: str) -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.path(folder))) if self.exists(folder) else []

    def stamp(self) -> tuple:
        """What changes when a file, or a file of a folder, is written again."""
        at = self.path("")
        return tuple(sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in self.fs.listStatus(at)))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Writes a new file, whole or not at all; False if there is one of that name. Of two writers one succeeds: by a link on local disks, by a rename that
        doesn't replace on HDFS, and by a create that doesn't replace elsewhere."""
        jvm, target = self.jvm, self.path(name)
        self.fs.mkdirs(target.getParent())
        kind = self.fs.getUri().getScheme()
        if kind not in ("file", "hdfs", "viewfs"):
            try:
                self._write(target, text, False)
                return True
            except Py4JJavaError as e:
                if "AlreadyExists" in str(e.java_exception) or "PreconditionFailed" in str(e.java_exception):
                    return False
                raise
        whole = self.path(name + ".new" + jvm.java.util.UUID.randomUUID().toString())
        self._write(whole, text, True)
        try:
            if kind == "file":
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(target), local(whole))
            else:
                none = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
                options = self.sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
                options[0] = none
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri()).rename(whole, target, options)
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        finally:
            self.fs.delete(whole, False)

    def _write(self, path, text: str, replace: bool) -> None:
        stream = self.fs.create(path, replace)
        stream.write(bytearray(text.encode()))
        stream.close()

    def modified(self, name: str) -> float:
        """Seconds since 1970 at which a file or folder was last written."""
        return self.fs.getFileStatus(self.path(name)).getModificationTime() / 1000

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)
