"""Top N items within every group: two-stage salted ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Subgroups that each group is hashed into for the first ranking.
SALTS = 32


def usable_tracks(tracks: DataFrame) -> DataFrame:
    """Track rows that carry a score: p not null, not NaN, within 0..1; category and tier trimmed and lower-cased.

    Rows without track_id are left out (they cannot be told apart). Copies of one track_id, equal but for the time of
    arrival, become one row; the distinct is combined map-side, so a row delivered any number of times moves once a task.
    """
    return (
        tracks.where(F.col("track_id").isNotNull() & F.col("p").isNotNull() & ~F.isnan("p") & F.col("p").between(0.0, 1.0))
        .select(
            "track_id",
            "dataset",
            "image_id",
            F.lower(F.trim("category")).alias("category"),
            F.lower(F.trim("tier")).alias("tier"),
            # -0.0 and 0.0 are one score
            (F.col("p") + F.lit(0.0)).alias("p"),
        )
        .distinct()
    )


def top_n(df: DataFrame, keys: list[str], order: list[Column], ident: str, n: int, salts: int = SALTS) -> DataFrame:
    """First n rows of every group of keys in the given order, with their rank in column `rank`.

    Stage one ranks within (group, hash of ident) and keeps n of each subgroup, so a group of any size is spread over
    `salts` tasks; Spark's group limit drops rows before the shuffle as well. Stage two ranks the survivors, at most
    n * salts of a group. Null keys form their own group; null order values come where `order` puts them.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    salt, rank = "__salt", "rank"
    first = Window.partitionBy(*keys, salt).orderBy(*order)
    last = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn(salt, F.pmod(F.xxhash64(ident), F.lit(salts)))
        .withColumn(rank, F.row_number().over(first))
        .where(F.col(rank) <= n)
        .drop(salt)
        .withColumn(rank, F.row_number().over(last))
        .where(F.col(rank) <= n)
    )


def top_tracks(tracks: DataFrame, n: int = 5) -> DataFrame:
    """The n usable rows of highest p per dataset, category and non-null tier; ties by image_id, then track_id."""
    rows = usable_tracks(tracks).where("tier IS NOT NULL")
    order = [F.desc("p"), F.asc_nulls_first("image_id"), F.asc("track_id")]
    ranked = top_n(rows, ["dataset", "category", "tier"], order, "track_id", n)
    return ranked.select("dataset", "category", "tier", "rank", "track_id", "image_id", "p")
