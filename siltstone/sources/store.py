"""Small files in any file system: the driver goes through Hadoop's, tasks through Arrow's."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

import pyarrow.fs as afs
from pyspark.sql import SparkSession


def encode(value: Any) -> bytes:
    return (json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False, allow_nan=False) + "\n").encode()


class Store:
    """Documents, renames and listings on the driver, in whatever file system a path names."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        p = self._jvm.org.apache.hadoop.fs.Path(str(path))
        return p.getFileSystem(self._conf), p

    def qualified(self, path: str) -> str:
        fs, p = self._at(path)
        return fs.makeQualified(p).toString()

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def size(self, path: str) -> int:
        fs, p = self._at(path)
        return fs.getFileStatus(p).getLen()

    def delete(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def rename(self, old: str, new: str) -> None:
        fs, p = self._at(old)
        if self.exists(new) or not fs.rename(p, self._at(new)[1]):
            raise RuntimeError(f"{old} can't become {new}")

    def read(self, path: str) -> bytes:
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def last_byte(self, path: str) -> int | None:
        """The last byte of a file, without reading the rest; None for an empty one."""
        n = self.size(path)
        if not n:
            return None
        fs, p = self._at(path)
        stream = fs.open(p)
        try:
            stream.seek(n - 1)
            return stream.read()
        finally:
            stream.close()

    def load(self, path: str) -> Any:
        return json.loads(self.read(path))

    def save(self, path: str, value: Any) -> bool:
        """Writes a document beside its place and renames it; the same bytes are left alone (False)."""
        data = encode(value)
        if self.exists(path):
            if self.read(path) == data:
                return False
        fs, p = self._at(path)
        temp = self._jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex}.part")
        out = fs.create(temp, True)
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        self._replace(temp, p)
        return True

    def _replace(self, old, new) -> None:
        """A rename over what is there, in one step where the file system can do that (local ones and Hadoop's can)."""
        how = getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
        options = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
        options[0] = how
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(old.toUri(), self._conf).rename(old, new, options)


def file_system(folder: str) -> tuple[afs.FileSystem, str]:
    """File system and path for a task; a path without a scheme is a local one."""
    if folder.startswith("file:"):
        return afs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    if "://" in folder:
        return afs.FileSystem.from_uri(folder)
    return afs.LocalFileSystem(), os.path.abspath(folder)


def write_whole(folder: str, name: str, data: bytes) -> None:
    """Writes a file beside its place and moves it there, so that a task that is run again leaves whole files."""
    fs, root = file_system(folder)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/.{name}.{uuid.uuid4().hex}.part"
    with fs.open_output_stream(temp) as f:
        f.write(data)
    fs.move(temp, f"{root}/{name}")
