"""Manifests: which files make up a store. Versions are written beside each other and renamed into place; readers take
the newest whose checksum holds, else the one before."""

from __future__ import annotations

import json
import zlib

from pyspark.sql import SparkSession


class Folder:
    """A folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm = spark._jvm
        self.path = path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._at(name))) if self.exists(name) else []

    def make(self, name: str = "") -> None:
        self.fs.mkdirs(self._at(name))

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)

    def write(self, name: str, data: bytes) -> None:
        out = self.fs.create(self._at(name), True)
        out.write(bytearray(data))
        out.close()

    def read(self, name: str) -> bytes:
        source = self.fs.open(self._at(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(source))
        finally:
            source.close()

    def rename(self, old: str, new: str) -> bool:
        return self.fs.rename(self._at(old), self._at(new))


def commit(folder: Folder, manifest: dict) -> None:
    """Publishes manifest['version'] and keeps the version before; older ones go."""
    body = json.dumps(manifest, sort_keys=True).encode()
    name = f"manifest/{manifest['version']:012d}.json"
    folder.write(name + ".tmp", str(zlib.crc32(body)).encode() + b"\n" + body)
    if not folder.rename(name + ".tmp", name):
        raise OSError(f"version {manifest['version']} of the manifest exists already")
    for old in [n for n in folder.names("manifest") if n.endswith(".json")][:-2]:
        folder.delete(f"manifest/{old}")


def all_whole(folder: Folder) -> list[dict]:
    """The kept manifests whose checksum holds, the newest first."""
    out = []
    for name in reversed([n for n in folder.names("manifest") if n.endswith(".json")]):
        mark, _, body = folder.read(f"manifest/{name}").partition(b"\n")
        if mark.isdigit() and int(mark) == zlib.crc32(body):
            out.append(json.loads(body))
    return out


def load(folder: Folder) -> dict | None:
    """The newest manifest that is whole; None if there is none."""
    return next(iter(all_whole(folder)), None)
