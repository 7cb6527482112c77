"""Versioned tables on plain Parquet: data files first, an atomically renamed pointer last; readers pin a version."""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class UnknownDataset(LookupError):
    """Nothing was ever committed under this path."""


class Conflict(RuntimeError):
    """Another writer committed first."""


@dataclass
class Table:
    """A table below `path`: v=<n>/ folders of Parquet files and _versions/<n>.json manifests.

    A version lists the folders that make it up, so appends write only new rows, column swaps replace one folder, and a reader
    that resolved a version keeps seeing exactly its rows while writers go on. A manifest is written under a temporary name and
    renamed without overwriting, which also makes it the writers' lock: of two, one fails with Conflict. Folders that no version
    names (a writer died) are invisible and removed by `recover`.
    """

    spark: SparkSession
    path: str

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, rest: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{rest}")

    def versions(self) -> list[int]:
        """Committed versions, ascending."""
        _, fs = self._fs()
        d = self._p("_versions")
        names = [s.getPath().getName() for s in fs.listStatus(d)] if fs.exists(d) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """The manifest of a version, by default the last."""
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise UnknownDataset(f"{self.path}, version {version}")
        jvm, fs = self._fs()
        stream = fs.open(self._p(f"_versions/{known[-1] if version is None else version}.json"))
        try:
            return json.loads(bytes(b & 255 for b in jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        """Rows of one version: every folder that its manifest names."""
        m = self.manifest(version)
        return self.spark.read.option("basePath", self.path).schema(m["schema"]).parquet(*[f"{self.path}/{d}" for d in m["folders"]])

    def _commit(self, base: int, folders: list[str], schema: str, note: dict) -> int:
        version = base + 1
        jvm, fs = self._fs()
        body = json.dumps({"version": version, "folders": folders, "schema": schema, "updated": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), **note}, sort_keys=True)
        tmp, final = self._p(f"_versions/.{uuid.uuid4().hex}.tmp"), self._p(f"_versions/{version}.json")
        fs.mkdirs(self._p("_versions"))
        if fs.exists(final):
            raise Conflict(f"version {version} of {self.path} exists")
        out = fs.create(tmp, False)
        out.write(bytearray(body.encode()))
        out.close()
        if not fs.rename(tmp, final):
            fs.delete(tmp, False)
            raise Conflict(f"version {version} of {self.path} exists")
        return version

    def _write(self, df: DataFrame, version: int) -> str:
        folder = f"v={version}-{uuid.uuid4().hex[:8]}"
        df.write.option("compression", "zstd").parquet(f"{self.path}/{folder}")
        return folder

    def create(self, df: DataFrame, note: dict | None = None) -> int:
        """First version."""
        if self.versions():
            raise Conflict(f"{self.path} exists")
        return self._commit(0, [self._write(df, 1)], _ddl(df), note or {})

    def append(self, df: DataFrame, key: str, dim: tuple[str, int] | None = None, note: dict | None = None) -> int:
        """Adds rows whose key is new; a key repeated within the rows, or a vector of wrong length, refuses the whole append."""
        last = self.manifest()
        bad = df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        if bad:
            raise ValueError(f"{key} repeats within the appended rows")
        if dim and df.where(F.size(dim[0]) != dim[1]).limit(1).count():
            raise ValueError(f"{dim[0]} must hold {dim[1]} values")
        fresh = df.join(self.read(last["version"]).select(key), key, "left_anti").select(df.columns)
        return self._commit(last["version"], [*last["folders"], self._write(fresh, last["version"] + 1)], last["schema"], note or {})

    def rewrite(self, df: DataFrame, note: dict | None = None) -> int:
        """A version made of new rows only (column swap, recount, overwrite)."""
        last = self.manifest()
        return self._commit(last["version"], [self._write(df, last["version"] + 1)], _ddl(df), note or {})

    def recover(self) -> list[str]:
        """Removes folders that no version names; returns their names."""
        _, fs = self._fs()
        named = {f for v in self.versions() for f in self.manifest(v)["folders"]}
        if not fs.exists(self._p("")) and not named:
            return []
        stray = [s.getPath().getName() for s in fs.listStatus(self._p("")) if s.getPath().getName().startswith("v=")]
        gone = sorted(n for n in stray if n not in named)
        for n in gone:
            fs.delete(self._p(n), True)
        return gone


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
