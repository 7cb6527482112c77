"""Deterministic sampling and splits: by hash of an id, so that they do not depend on the layout of a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def digest(ident: str, seed: int):
    """Order key that any engine can recompute."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(ident).cast("string")))


def cap_per_class(df: DataFrame, by: list[str], ident: str, cap: int, seed: int = 0) -> DataFrame:
    """At most `cap` rows of each class, drawn by digest."""
    w = Window.partitionBy(*by).orderBy(digest(ident, seed), ident)
    return df.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= cap).drop("__r")


def split(df: DataFrame, ident: str, share: float, seed: int = 0) -> DataFrame:
    """Adds `part`, train or test: by the digest's leading digits, so a row's part never changes as the table grows."""
    lead = F.conv(F.substring(digest(ident, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("part", F.when(lead < int(share * (1 << 32)), "train").otherwise("test"))


def stride(df: DataFrame, order: list, n: int) -> DataFrame:
    """About n rows evenly spaced in order. Positions come from one window over all rows: for lists of concepts, not for records."""
    w = Window.partitionBy(F.lit(0)).orderBy(*order)
    total = df.count()
    step = max(1, total // max(1, n))
    return df.withColumn("__r", F.row_number().over(w) - 1).where(F.col("__r") % step == 0).limit(n).drop("__r")


def tiered(df: DataFrame, tiers: list[str], quota: int, ident: str, seed: int = 0) -> DataFrame:
    """Fills a quota tier by tier: all of the first tiers, the last one only as far as needed."""
    order = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier"))
    got = df.where(F.col("tier").isin(tiers)).withColumn("__o", order)
    return got.orderBy("__o", digest(ident, seed), ident).limit(quota).drop("__o")
