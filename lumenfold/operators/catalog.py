"""Relations that search and track scoring start from: items with unit vectors, concept vectors, concept banks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.vector import l2_normalise
from lumenfold.session import small, table

#: Data sets that the items are dealt into.
SETS = 3


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, ds, e): every embedded item with its vector in double precision and its data set."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), "label", (F.col("label") % SETS).alias("ds"), F.col("embedding").cast("array<double>").alias("e")
    )


def mean_vectors(df: DataFrame, keys: list[str], vec: str = "e") -> DataFrame:
    """Mean vector of each group, renormalised: a concept as the mean of its prompts. Partial sums are combined map-side."""
    means = df.select(*keys, F.posexplode(vec).alias("pos", "v")).groupBy(*keys, "pos").agg(F.avg("v").alias("m"))
    whole = means.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s.m).alias("m"))
    return whole.select(*keys, l2_normalise("m").alias("c"))


def tag_vectors(items_: DataFrame) -> DataFrame:
    """(idx, c): one concept per label; few rows, broadcast once counted."""
    return small(mean_vectors(items_, ["label"]).withColumnRenamed("label", "idx"), 20_000)
