"""A root folder on any Hadoop file system: small JSON objects, exclusive creation, Parquet tables."""

from __future__ import annotations

import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..errors import EngineError

#: File systems on which creating an object without overwriting is one atomic step.
SCHEMES = ("file", "hdfs", "viewfs", "abfs", "abfss", "gs")


def check_url(url: str) -> str:
    """``url`` where its scheme is one of SCHEMES or none."""
    m = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):", url)
    if m and m[1].lower() not in SCHEMES:
        raise EngineError("CONFIG", f"scheme not supported: {m[1]}", {"schemes": list(SCHEMES)})
    if not url.strip():
        raise EngineError("CONFIG", "an empty location")
    return url.rstrip("/")


class Storage:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, check_url(root)
        if not re.match(r"[a-z0-9]+:", self.root):
            self.root = os.path.abspath(self.root)
        self._jvm = spark._jvm
        self._local = self.root.removeprefix("file://") if self.root.startswith(("/", "file:///")) else None

    def path(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def _hadoop(self, name: str):
        at = self._jvm.org.apache.hadoop.fs.Path(self.path(name))
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def exists(self, name: str) -> bool:
        fs, at = self._hadoop(name)
        return fs.exists(at)

    def read(self, name: str) -> Any:
        fs, at = self._hadoop(name)
        if not fs.exists(at):
            return None
        if self._local:
            with open(f"{self._local}/{name}", encoding="utf-8") as f:
                return json.load(f)
        stream = fs.open(at)
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def _create(self, name: str, value: Any, overwrite: bool) -> None:
        fs, at = self._hadoop(name)
        stream = fs.create(at, overwrite)
        try:
            stream.write(json.dumps(value, ensure_ascii=False).encode())
        finally:
            stream.close()

    def put(self, name: str, value: Any) -> None:
        """Replace an object; on a local folder by renaming a whole file."""
        if not self._local:
            self._create(name, value, True)
            return
        os.makedirs(os.path.dirname(f"{self._local}/{name}"), exist_ok=True)
        with open(f"{self._local}/{name}.new", "w", encoding="utf-8") as f:
            json.dump(value, f, ensure_ascii=False)
        os.replace(f"{self._local}/{name}.new", f"{self._local}/{name}")

    def put_if_absent(self, name: str, value: Any) -> bool:
        """Publish an object once; False where it is there already."""
        if self._local:
            target = f"{self._local}/{name}"
            os.makedirs(os.path.dirname(target), exist_ok=True)
            part = f"{target}.{os.getpid()}.{id(value)}"
            with open(part, "w", encoding="utf-8") as f:
                json.dump(value, f, ensure_ascii=False)
            try:
                os.link(part, target)  # atomic, and never seen half written
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        if self.exists(name):
            return False
        try:
            self._create(name, value, False)
        except Exception as e:
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def list(self, name: str) -> list[str]:
        fs, at = self._hadoop(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def delete(self, name: str) -> None:
        fs, at = self._hadoop(name)
        fs.delete(at, True)

    def copy_to(self, name: str, other: Storage, target: str) -> None:
        fs, at = self._hadoop(name)
        fs2, at2 = other._hadoop(target)
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, at, fs2, at2, False, self.spark._jsc.hadoopConfiguration())

    def promote(self, target: Storage) -> None:
        """Rename this root to ``target``, whose old content goes last."""
        fs, at = self._hadoop("")
        _, to = target._hadoop("")
        old = self._jvm.org.apache.hadoop.fs.Path(target.root + ".old")
        if fs.exists(to):
            fs.rename(to, old)
        fs.rename(at, to)
        fs.delete(old, True)

    def write_rows(self, df: DataFrame, name: str) -> list[str]:
        """Write Parquet below ``name``; the files, relative to the root."""
        df.write.mode("overwrite").parquet(self.path(name))
        return [f"{name}/{x}" for x in self.list(name) if x.endswith(".parquet")]

    def read_rows(self, files: list[str], schema: T.StructType) -> DataFrame:
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*map(self.path, files))
