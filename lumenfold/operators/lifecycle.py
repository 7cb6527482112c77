"""Stored tracks, job status and data sets on versioned tables: column swap, recount, upsert, create, rename, reindex, delete."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.calib import band
from lumenfold.functions.vector import rows_of
from lumenfold.operators.store import Table, UnknownDataset


@dataclass
class TrackStore:
    """Track scores in one folder a category: a column is swapped by replacing its folder, the others' files are kept."""

    table: Table

    def create(self, tracks: DataFrame) -> int:
        """First version: the rows of tracks, dealt into folders by category in one write."""
        t = self.table
        folder = f"v=1-{'c'}"
        tracks.write.partitionBy("category").parquet(f"{t.path}/{folder}")
        _, fs = t._fs()
        names = sorted(s.getPath().getName() for s in fs.listStatus(t._p(folder)) if s.getPath().getName().startswith("category="))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tracks.schema.fields)
        return t._commit(0, [f"{folder}/{n}" for n in names], schema, {"columns": {n.split("=", 1)[1]: f"{folder}/{n}" for n in names}})

    def read(self) -> DataFrame:
        """All tracks, with their category."""
        m = self.table.manifest()
        out = None
        for name in m["columns"]:
            part = self.column(name)
            out = part if out is None else out.unionByName(part)
        return out

    def column(self, category: str) -> DataFrame:
        """The rows of one track."""
        m = self.table.manifest()
        if category not in m["columns"]:
            raise UnknownDataset(f"track {category}")
        rows = self.table.spark.read.parquet(f"{self.table.path}/{m['columns'][category]}")
        return rows.withColumn("category", F.lit(category))

    def swap(self, category: str, rows: DataFrame) -> int:
        """A version in which the track's rows are these; a new track is added. The old files stay for pinned readers."""
        m = self.table.manifest()
        folder = self.table._write(rows.drop("category"), m["version"] + 1)
        columns = m["columns"] | {category: folder}
        keep = {k: v for k, v in m.items() if k in ("counts",)}
        return self.table._commit(m["version"], sorted(columns.values()), m["schema"], {"columns": columns, **keep})

    def recount(self, taus: list[tuple[str, float]]) -> int:
        """Derives tiers from the stored scores and writes the counts (a few numbers a track) into a new version."""
        m = self.table.manifest()
        got = self.read().groupBy("category", band(F.col("p"), taus).alias("tier")).agg(F.count("*").alias("n")).collect()
        counts: dict[str, dict[str, int]] = {}
        for r in got:
            counts.setdefault(r["category"], {})[r["tier"]] = r["n"]
        return self.table._commit(m["version"], m["folders"], m["schema"], {"columns": m["columns"], "counts": counts})

    def counts(self) -> DataFrame:
        """(category, tier, n) as last written."""
        rows = [(c, t, n) for c, of in self.table.manifest().get("counts", {}).items() for t, n in of.items()]
        return self.table.spark.createDataFrame(rows, "category string, tier string, n long")


@dataclass
class JobStatus:
    """Latest snapshot of every job; a batch of snapshots is merged in, older ones change nothing."""

    table: Table

    def write(self, snapshots: DataFrame) -> int:
        if self.table.versions():
            snapshots = snapshots.unionByName(self.table.read().select(snapshots.columns))
        order = [F.desc_nulls_last("updated_at"), F.desc_nulls_last("done_n"), F.desc(F.coalesce("total_n", F.lit(-1)))]
        last = snapshots.withColumn("__r", F.row_number().over(Window.partitionBy("job_id").orderBy(*order))).where("__r = 1").drop("__r")
        return self.table.rewrite(last) if self.table.versions() else self.table.create(last)

    def read(self) -> DataFrame:
        return self.table.read()


@dataclass
class Library:
    """Data sets below one folder, each a versioned table."""

    spark: SparkSession
    path: str

    def _fs(self):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _dir(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        fs, p = self._fs()
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def open(self, name: str) -> Table:
        t = Table(self.spark, f"{self.path}/{name}")
        t.manifest()  # raises UnknownDataset
        return t

    def create(self, name: str, rows: DataFrame) -> int:
        return Table(self.spark, f"{self.path}/{name}").create(rows)

    def reindex(self, name: str, rows: DataFrame) -> int:
        return self.open(name).rewrite(rows)

    def rename(self, old: str, new: str) -> None:
        """Refuses a name that is taken."""
        self.open(old)
        fs, _ = self._fs()
        if fs.exists(self._dir(new)) or not fs.rename(self._dir(old), self._dir(new)):
            raise FileExistsError(new)

    def delete(self, name: str, force: bool = False) -> None:
        """Refuses a data set that has rows, unless forced."""
        if not force and not self.open(name).read().isEmpty():
            raise ValueError(f"{name} has rows; force its deletion")
        self._fs()[0].delete(self._dir(name), True)

    def listing(self) -> DataFrame:
        """(dataset, version, n) of every data set, by name."""
        out = self.spark.createDataFrame([], "dataset string, version int, n long")
        for n in self.names():
            t = self.open(n)
            out = out.unionByName(t.read().agg(F.count("*").alias("n")).select(F.lit(n).alias("dataset"), F.lit(t.manifest()["version"]).alias("version"), "n"))
        return out


def pack_half(df: DataFrame, vec: str) -> DataFrame:
    """The vector as base64 of half floats."""
    others = [c for c in df.columns if c != vec]

    def run(batches):
        for b in batches:
            if b.num_rows:
                x = rows_of(b.column(len(others))).astype("<f2")
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array([r.tobytes() for r in x], pa.binary())], names=[*others, vec])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in others)
    return df.where(F.col(vec).isNotNull()).select(*others, vec).mapInArrow(run, f"{kinds}, {vec} binary").withColumn(vec, F.base64(vec))


def unpack_half(df: DataFrame, vec: str) -> DataFrame:
    """The inverse: an array of floats, with the precision of half floats."""
    others = [c for c in df.columns if c != vec]

    def run(batches):
        for b in batches:
            if b.num_rows:
                rows = [np.frombuffer(v, "<f2").astype(np.float32) for v in b.column(len(others)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(others)], pa.array(rows, pa.list_(pa.float32()))], names=[*others, vec])

    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in others)
    return df.withColumn(vec, F.unbase64(vec)).select(*others, vec).mapInArrow(run, f"{kinds}, {vec} array<float>")
