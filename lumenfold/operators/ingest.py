"""Ingest: incremental selection, metadata joins, row numbering, paging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.text import base_name


def unchanged(found: DataFrame, known: DataFrame) -> DataFrame:
    """Found files whose path, mtime and size are not already known, null-safe."""
    same = found["path"].eqNullSafe(known["path"]) & found["mtime"].eqNullSafe(known["mtime"]) & found["size"].eqNullSafe(known["size"])
    return found.join(known, same, "left_anti")


def new_rows(batch: DataFrame, known: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Rows of a batch with a key seen neither before nor earlier in the batch; rows without key are kept."""
    w = Window.partitionBy(key).orderBy(*order)
    keyed = batch.where(F.col(key).isNotNull()).withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return keyed.join(known.select(key).distinct(), key, "left_anti").unionByName(batch.where(F.col(key).isNull()))


def join_meta(images: DataFrame, by_path: DataFrame, by_name: DataFrame, job: DataFrame) -> DataFrame:
    """Metadata maps laid over each record: job-wide below base name below full path; empty values do not count.

    by_path: (path, meta), by_name: (base, meta), job: one row (meta). by_name may have several rows of one name: the first in
    order of path wins, so it must come with `path`.
    """
    w = Window.partitionBy("base").orderBy("path")
    names = by_name.withColumn("__r", F.row_number().over(w)).where("__r = 1").select("base", F.col("meta").alias("m_name"))
    paths = by_path.select("path", F.col("meta").alias("m_path"))
    j = images.withColumn("base", base_name(F.col("path"))).join(paths, "path", "left").join(names, "base", "left")
    j = j.crossJoin(F.broadcast(job.limit(1).select(F.col("meta").alias("m_job"))))
    return j.withColumn("meta", lay_over([F.col("m_job"), F.col("m_name"), F.col("m_path")])).drop("m_job", "m_name", "m_path", "base")


def lay_over(maps: list[Column]) -> Column:
    """One map of several, later ones win; null maps and empty values do not count."""
    out = _filled(maps[0])
    for m in maps[1:]:
        out = _over(out, _filled(m))
    return out


def _filled(m: Column) -> Column:
    return F.map_filter(F.coalesce(m, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull() & (v != ""))


def _over(low: Column, high: Column) -> Column:
    return F.map_concat(F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k)), high)


def number_rows(batch: DataFrame, last: DataFrame, by: str, order: list[Column]) -> DataFrame:
    """Row positions continue from the last position of each data set."""
    w = Window.partitionBy(by).orderBy(*order)
    j = batch.withColumn("__i", F.row_number().over(w)).join(last, by, "left")
    return j.withColumn("row", (F.coalesce("last_row", F.lit(-1)) + F.col("__i")).cast("long")).drop("__i", "last_row")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """One page in table order; offset and limit are clamped to 0 and 0..200."""
    return df.orderBy(*order).offset(max(0, offset)).limit(min(200, max(0, limit)))


def common_parent(df: DataFrame, path: str, by: list[str]) -> DataFrame:
    """Longest common parent folder of each group's paths: the common prefix of the least and the greatest path, by component."""
    g = df.groupBy(*by).agg(F.min(path).alias("a"), F.max(path).alias("b"))
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.filter(F.sequence(F.lit(1), F.least(F.size(a), F.size(b)) - 1), lambda i: F.slice(a, 1, i) == F.slice(b, 1, i))
    n = F.coalesce(F.array_max(same), F.lit(0))
    return g.select(*by, F.array_join(F.slice(a, 1, n), "/").alias("root"))
