"""Session helpers: scratch tables in the cluster's shared folder, sized broadcasts, table readers."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Upper bound on the rows of a side that may be broadcast; beyond it the join shuffles (AQE splits skewed keys).
BROADCAST_ROWS = 200_000

#: And of its bytes.
BROADCAST_BYTES = 256 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a session: on a cluster they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_lumenfold_shipped", False):
        return
    package = Path(__file__).parent
    target = Path(tempfile.mkdtemp(prefix="lumenfold-")) / "lumenfold_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    sc.addPyFile(str(target))
    sc._lumenfold_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables as a DataFrame."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; only where that is unset (tests), a folder of our own is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + os.path.join(tempfile.gettempdir(), "lumenfold-scratch")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when this process ends."""
    path = f"{scratch_root(spark)}/lumenfold/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def _clean() -> None:
    for spark, path in _made:
        try:
            drop_path(spark, path)
        except Exception:  # noqa: BLE001 - the session is gone; its folder is the cluster's to clean
            return


def drop_path(spark: SparkSession, path: str) -> None:
    """Removes a scratch table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What is shuffled for a table that is written meanwhile goes once it is written."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    with shuffles_dropped(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Marks df for broadcast if, and only if, it is counted and has at most max_rows rows and about max_bytes; texts and arrays
    are measured, other columns taken as 8 bytes."""
    wide = [f.name for f in df.schema.fields if f.dataType.typeName() in ("string", "binary", "array", "map")]
    size = sum((F.coalesce(F.length(c) if df.schema[c].dataType.typeName() in ("string", "binary") else 16 * F.size(c), F.lit(0)) for c in wide), F.lit(8 * len(df.columns)))
    n, held = df.limit(max_rows + 1).select(size.alias("s")).agg(F.count("*"), F.coalesce(F.sum("s"), F.lit(0))).first()
    return F.broadcast(df) if n <= max_rows and held <= max_bytes else df


def partitions(spark: SparkSession, least: int = 1) -> int:
    """The session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
