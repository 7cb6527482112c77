"""Track scores and tiers: margins over concept banks, derivation at read, roll-ups, flagged lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.calib import MARGIN_FLOOR, STD_FLOOR, TIERS, Z_FIRE, clean_score, sigmoid, tier_rank, z_p
from lumenfold.functions.vector import dot, rows_of
from lumenfold.operators.search import bank_of
from lumenfold.session import small


def clean_tracks(tracks: DataFrame) -> DataFrame:
    """Stored scores as a relation: NaN and values outside 0..1 become null (not scored), names trimmed and lower-cased, rows
    delivered again kept once."""
    p = clean_score(F.col("p"))
    return tracks.select(
        "track_id", "dataset", "image_id", F.lower(F.trim("category")).alias("category"), F.lower(F.trim("tier")).alias("tier"), F.when(p.between(0.0, 1.0), p).alias("p"), "model_id"
    ).dropDuplicates(["track_id"])


def bank_scores(items: DataFrame, concepts: DataFrame) -> DataFrame:
    """Best and mean cosine of each item to each role's concepts: (id, ds, category, role, best, mean). The bank is gathered, at
    most MAX_BANK vectors, and multiplied with whole batches of items."""
    names, bank = bank_of(concepts, "category", "role", "idx")
    return bank_scores_batched(items, [n[:2] for n in names], bank)


def bank_scores_batched(items: DataFrame, names: list[tuple[str, str]], bank: np.ndarray) -> DataFrame:
    """The same by one matrix product per Arrow batch, for banks of many vectors: (id, ds, category, role, best, mean).

    names gives (category, role) of each row of bank.
    """
    slots = sorted(set(names))
    at = np.array([slots.index(n) for n in names])
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast(bank.astype(np.float64))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                c = rows_of(b.column(2)) @ shared.value.T
                for k, (category, role) in enumerate(slots):
                    own = c[:, at == k]
                    word = [pa.repeat(pa.scalar(w, pa.string()), b.num_rows) for w in (category, role)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *word, pa.array(own.max(1)), pa.array(own.mean(1))], names=["id", "ds", "category", "role", "best", "mean"])

    kinds = ", ".join(f"{c} {items.schema[c].dataType.simpleString()}" for c in ("id", "ds"))
    return items.select("id", "ds", "e").mapInArrow(score, f"{kinds}, category string, role string, best double, mean double")


def margins(bank: DataFrame, form: str = "max") -> DataFrame:
    """(id, ds, category, role, margin): best cosine to a role minus best cosine to the negatives; form 'mean' takes the mean
    minus half the negatives' mean. A category without negatives subtracts nothing."""
    value = "best" if form == "max" else "mean"
    weight = 1.0 if form == "max" else 0.5
    neg = F.max(F.when(F.col("role") == "negative", F.col(value))).over(Window.partitionBy("id", "category"))
    out = bank.withColumn("margin", F.col(value) - weight * F.coalesce(neg, F.lit(0.0)))
    return out.where("role <> 'negative'").select("id", "ds", "category", "role", "margin")


def derive_unfitted(margin: DataFrame) -> DataFrame:
    """Tier of each item and category without a fit: z of each role's margin within the data set, logistic, the role that exceeds
    its firing point most (first in severity on ties); it fires only with an absolute margin of MARGIN_FLOOR as well."""
    stats = margin.groupBy("ds", "category", "role").agg(F.avg("margin").alias("m"), F.greatest(F.stddev_pop("margin"), F.lit(STD_FLOOR)).alias("s"))
    j = margin.join(small(stats), ["ds", "category", "role"])
    p = z_p((F.col("margin") - F.col("m")) / F.col("s"))
    over = F.struct((p - z_p(F.lit(Z_FIRE))).alias("over"), (-tier_rank(F.col("role"))).alias("o"), F.col("role").alias("role"), p.alias("p"), F.col("margin").alias("margin"))
    best = j.groupBy("id", "ds", "category").agg(F.max(over).alias("b"))
    fires = (F.col("b.over") >= 0) & (F.col("b.margin") >= MARGIN_FLOOR)
    return best.select("id", "ds", "category", F.when(fires, F.col("b.role")).otherwise("none").alias("tier"), F.col("b.role").alias("picked"), F.col("b.p").alias("p"), F.col("b.margin").alias("margin"))


def tier_counts(df: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Rows per (category, tier); with categories, the fixed grid is filled with zeros and unknown tiers stay."""
    tier = F.coalesce("tier", F.lit("unknown"))
    got = df.groupBy("category", tier.alias("tier")).agg(F.count("*").alias("n"))
    if categories is None:
        return got
    spark = df.sparkSession
    grid = spark.createDataFrame([(c, t) for c in categories for t in TIERS], "category string, tier string")
    return grid.join(got, ["category", "tier"], "full").select("category", "tier", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def alert_rollup(df: DataFrame, severe: list[str]) -> DataFrame:
    """Distinct pictures with any severe tier, per data set and in all."""
    hit = F.when(F.col("tier").isin(severe), F.col("image_id"))
    per = df.groupBy("dataset").agg(F.count_distinct(hit).alias("alerts"), F.count_distinct("image_id").alias("images"))
    total = df.agg(F.count_distinct(hit).alias("alerts"), F.count_distinct("image_id").alias("images")).select(F.lit("*").alias("dataset"), "alerts", "images")
    return per.unionByName(total)


def flagged(df: DataFrame, limit: int, tiers: list[str]) -> DataFrame:
    """First rows of each (category, tier) by p; ties by picture and row."""
    w = Window.partitionBy("category", "tier").orderBy(F.desc("p"), "image_id", "track_id")
    return df.where(F.col("tier").isin(tiers) & F.col("p").isNotNull()).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def image_flags(df: DataFrame, tiers: list[str]) -> DataFrame:
    """Fired flags of each picture, most severe first, then by p, category."""
    flag = F.struct(tier_rank(F.col("tier")).alias("o"), (-F.coalesce("p", F.lit(0.0))).alias("d"), "category", "tier")
    got = df.where(F.col("tier").isin(tiers)).groupBy("dataset", "image_id").agg(F.sort_array(F.collect_list(flag)).alias("f"))
    return got.select("dataset", "image_id", F.transform("f", lambda x: F.concat(x.category, F.lit(":"), x.tier)).alias("flags"))


def overlay(layers: list[DataFrame], keys: list[str], values: list[str]) -> DataFrame:
    """Configuration layers, the last one that has a value wins: base, recorded, fitted for the base model, fitted."""
    out = layers[0]
    for layer in layers[1:]:
        new = layer.select(*keys, *[F.col(v).alias(f"__{v}") for v in values])
        out = out.join(small(new), keys, "left").select(*keys, *[F.coalesce(f"__{v}", v).alias(v) for v in values])
    return out


def head_score(items: DataFrame, weights: DataFrame) -> DataFrame:
    """Linear head: dot(weights, e) + b per item and head."""
    return items.crossJoin(small(weights, 1_000)).withColumn("raw", dot("e", "w") + F.col("b"))


def margin_probability(m: Column) -> Column:
    """Unfitted head margin to probability."""
    return F.when(m.isNotNull(), sigmoid(20.0 * m))
