"""Queries of the training-data operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import clusters, cutoff, dedup, leak, mix, neighbours, quality, topn
from lumenfold.llm import oracle as sql
from lumenfold.registry import Registry
from lumenfold.session import table

LLM = Registry()


@LLM.add("p4_found", sql.P4_FOUND)
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five usable rows of every dataset, category and tier."""
    return topn.top_tracks(table(spark, sf_dir, "tracks")).select("track_id")


@LLM.add("p4_top", sql.P4_TOP)
def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with group, rank and score."""
    return topn.top_tracks(table(spark, sf_dir, "tracks"))


@LLM.add("p5_found", sql.P5_FOUND)
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows kept by the new cutoffs, per band."""
    return cutoff.weapons_cutoffs(table(spark, sf_dir, "tracks"), table(spark, sf_dir, "weapons_heads"))[1].select("band", "track_id")


@LLM.add("p5_cutoffs", sql.P5_CUTOFFS)
def p5_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New cutoffs, kept rows and ties per dataset and band."""
    return cutoff.weapons_cutoffs(table(spark, sf_dir, "tracks"), table(spark, sf_dir, "weapons_heads"))[0].withColumnRenamed("source", "dataset")


@LLM.add("p8_found", sql.P8_FOUND)
def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not natural speech: caught by the learned rules (or, marked -1, by none of them), then held against the
    definition."""
    caught, _ = quality.junk_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "common_words"))
    return caught.where("rule <> 0").where(quality.not_speech()).select("doc_id")


@LLM.add("p8_stats", sql.P8_STATS)
def p8_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line and word statistics of every document."""
    words = [r[0] for r in table(spark, sf_dir, "common_words").select("word").where("word <> ''").distinct().limit(quality.MAX_WORDS + 1).collect()]
    return quality.text_stats(table(spark, sf_dir, "documents"), words)


@LLM.add("p6_found", sql.P6_FOUND)
def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the held-out items that their speech holds."""
    return leak.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


@LLM.add("p7_mix")
def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of the mixture with their copies."""
    return mix.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[0]


@LLM.add("p7_report")
def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by the mixture, one row a source of the targets."""
    return mix.mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))[1]


@LLM.add("p3_found", sql.P3_FOUND)
def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar records of every probe, as pairs."""
    near = neighbours.probe_neighbours(table(spark, sf_dir, "images"), table(spark, sf_dir, "sim_probes"))
    return near.select(F.least("q_id", "rec_id").alias("rec_a"), F.greatest("q_id", "rec_id").alias("rec_b")).distinct()


@LLM.add("p3_neighbours", sql.P3_NEIGHBOURS)
def p3_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar records of every record whose rec_id is divisible by 20, those that resemble no other included."""
    near = neighbours.every_twentieth(table(spark, sf_dir, "images"))
    return near.select("q_id", "rec_id", F.col("rank").cast("int").alias("rank"), F.round("cosine", 6).alias("cosine"))


@LLM.add("p1_found")
def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeats with the accepted records they repeat, as pairs."""
    found = dedup.repeats(table(spark, sf_dir, "images"))
    return found.select(F.least("q_id", "t_id").alias("rec_a"), F.greatest("q_id", "t_id").alias("rec_b")).distinct()


@LLM.add("p2_found", sql.P2_FOUND)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of every group of mutually similar records of one data set."""
    return clusters.members(table(spark, sf_dir, "images")).select("head_rec_id", "rec_id")


@LLM.add("p2_clusters", sql.P2_CLUSTERS)
def p2_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and most typical members of every group, best first."""
    found = clusters.describe(clusters.groups(table(spark, sf_dir, "images")))
    return found.select("head_rec_id", "size", F.array_join(F.col("typical").cast("array<string>"), ",").alias("typical"))
