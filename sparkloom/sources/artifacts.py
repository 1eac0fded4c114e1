"""JSON artifacts and files on any file system that Spark reads, with a local cache."""

from __future__ import annotations

import hashlib
import json
import os
import time
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def split_uri(uri: str) -> tuple[str, str]:
    """(container, key) of a URI with a scheme; an error for anything else."""
    parsed = urlparse(uri)
    if not parsed.scheme or not parsed.path.strip("/") and not parsed.netloc:
        raise ValueError(f"not a URI of the form scheme://container/key: {uri!r}")
    return parsed.netloc, parsed.path.lstrip("/")


class Artifacts:
    """Loads and saves small artifacts. The cache is of the driver alone."""

    def __init__(self, spark: SparkSession, cache_dir: str | None = None, ttl_hours: float = 24.0):
        self.spark, self.cache_dir, self.ttl = spark, cache_dir, ttl_hours * 3600

    def _fs(self, uri: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(uri)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _cached(self, uri: str) -> str | None:
        return self.cache_dir and os.path.join(self.cache_dir, hashlib.sha256(uri.encode()).hexdigest())

    def cache_valid(self, local: str | None) -> bool:
        """Whether a cached file is young enough; a ttl of 0 or less keeps it for good."""
        if not local or not os.path.exists(local):
            return False
        return self.ttl <= 0 or time.time() - os.path.getmtime(local) < self.ttl

    def exists(self, uri: str) -> bool:
        fs, path = self._fs(uri)
        return fs.exists(path)

    def save_json(self, data, uri: str) -> None:
        fs, path = self._fs(uri)
        out = fs.create(path, True)
        try:
            out.write(bytearray(json.dumps(data, sort_keys=True).encode()))
        finally:
            out.close()

    def save_versioned(self, data, folder: str, name: str, version: str) -> list[str]:
        """The artifact under its version and as the latest one."""
        paths = [f"{folder}/{name}_{v}.json" for v in (version, "latest")]
        for p in paths:
            self.save_json(data, p)
        return paths

    def load_json(self, uri: str, use_cache: bool = True):
        """The artifact; from the cache while that is young, and from a stale cache where reading fails."""
        local = self._cached(uri)
        if use_cache and self.cache_valid(local):
            with open(local) as f:
                return json.load(f)
        try:
            text = "\n".join(r[0] for r in self.spark.read.text(uri, wholetext=True).collect())
            data = json.loads(text)
        except Exception:
            if use_cache and local and os.path.exists(local):
                with open(local) as f:
                    return json.load(f)
            raise
        if local:
            os.makedirs(self.cache_dir, exist_ok=True)
            with open(local, "w") as f:
                f.write(text)
        return data

    def upload(self, local: str, uri: str) -> None:
        fs, path = self._fs(uri)
        fs.copyFromLocalFile(False, True, self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), path)

    def download(self, uri: str, local: str) -> str:
        fs, path = self._fs(uri)
        fs.copyToLocalFile(False, path, self.spark._jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(local)}"), True)
        return local
