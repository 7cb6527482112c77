"""Queries that go through versioned tables, file sources and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import tracks
from lumenfold.operators.store import Table
from lumenfold.registry import CORE
from lumenfold.session import scratch_path, table
from lumenfold.sources.pixels import apply_heads, embed
from lumenfold.streaming import ingest as st


@CORE.add("stream_ingest", "SELECT DISTINCT lower(trim(image_id)) AS image_id FROM images WHERE image_id IS NOT NULL")
def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures streamed into a versioned table, each content id once over all history (ST1 ST2 ST9 SNK1 SNK3)."""
    schema = "rec_id long, dataset string, image_id string, commit_id long"
    rows = st.stream(spark, f"{sf_dir}/images.parquet*", schema, 4).withColumn("image_id", F.lower(F.trim("image_id")))
    target = Table(spark, scratch_path(spark, "pictures"))
    st.ingest(rows, target, "image_id", ["commit_id", "rec_id"], scratch_path(spark, "checkpoint"), trigger={"availableNow": True}).awaitTermination()
    return target.read().select("image_id")


@CORE.add("table_versions", "SELECT 1 AS version, count(*) AS n, sum(n_nationkey)::BIGINT AS keys FROM nation WHERE n_nationkey < 10 UNION ALL SELECT 2, count(*), sum(n_nationkey)::BIGINT FROM nation WHERE n_nationkey < 20")
def table_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader pinned to a version keeps its rows while another appends; known keys are not added again (D7 D8 ST3 SNK6)."""
    n = table(spark, sf_dir, "nation")
    t = Table(spark, scratch_path(spark, "nations"))
    t.create(n.where("n_nationkey < 10"))
    old = t.read(1)
    t.append(n.where("n_nationkey < 20"), "n_nationkey")
    count = lambda v, df: df.agg(F.count("*").alias("n"), F.sum("n_nationkey").alias("keys")).select(F.lit(v).alias("version"), "n", "keys")
    return count(1, old).unionByName(count(2, t.read()))


@CORE.add(
    "track_backfill",
    """WITH i AS (SELECT rec_id, list_transform(emb, lambda x: x::DOUBLE) AS e FROM images WHERE emb IS NOT NULL AND len(emb) = 64 AND NOT isnan(list_sum(list_transform(emb, lambda x: x::DOUBLE)))) SELECT rec_id, round(1 / (1 + exp(-4 * e[1])), 6) AS p FROM i""",
)
def track_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One more track scored over stored vectors, without touching the others (SNK10 SNK11 X1 X2 X4)."""
    i = table(spark, sf_dir, "images").where("emb IS NOT NULL AND size(emb) = 64 AND NOT exists(emb, x -> isnan(x))").select("rec_id", F.col("emb").cast("array<double>").alias("e"))

    def first_axis(x):
        import numpy as np

        return 1 / (1 + np.exp(-4 * x[:, 0]))

    scored = apply_heads(i, "rec_id", "e", {"axis": first_axis}).select("rec_id", "p")
    t = Table(spark, scratch_path(spark, "track"))
    t.create(scored)
    return t.read().select("rec_id", F.round("p", 6).alias("p"))


class Initials:
    """An encoder for names: one axis a letter, by the first letter of each word."""

    dim, model_id = 26, "initials"

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        x = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.lower().split():
                if "a" <= w[0] <= "z":
                    x[i, ord(w[0]) - 97] += 1.0
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


@CORE.add(
    "encoded_names",
    "SELECT n_nationkey, upper(substr(trim(n_name), 1, 1)) AS initial FROM nation WHERE NOT contains(trim(n_name), ' ')",
)
def encoded_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts through a pluggable encoder, one batch at a time; names of one word have one axis (X6 SRC19 D17)."""
    e = embed(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", Initials).where("NOT contains(trim(n_name), ' ')")
    return e.select("n_nationkey", F.char(F.array_position("e", F.array_max("e")) + 64).alias("initial"))


@CORE.add(
    "dead_letters",
    "SELECT track_id, CASE WHEN p IS NULL OR isnan(p) THEN 'scored' WHEN p < 0 OR p > 1 THEN 'range' ELSE 'tier' END AS reason, count(*) AS n FROM tracks WHERE p IS NULL OR isnan(p) OR p < 0 OR p > 1 OR tier IS NULL GROUP BY ALL",
)
def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Refused rows with their reason (ST8 X2)."""
    t = table(spark, sf_dir, "tracks")
    p = F.col("p")
    _, bad = st.dead_letters(t, {"scored": p.isNotNull() & ~F.isnan(p), "range": p.between(0.0, 1.0), "tier": F.col("tier").isNotNull()})
    return bad.groupBy("track_id", "reason").agg(F.count("*").alias("n"))


@CORE.add("track_recount", "SELECT category, count(*) AS n FROM (SELECT DISTINCT track_id, lower(trim(category)) AS category, p FROM tracks WHERE NOT isnan(p)) WHERE p BETWEEN 0.5 AND 1 GROUP BY category")
def track_recount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over one threshold from cleaned stored scores (SNK12 M20)."""
    return tracks.clean_tracks(table(spark, sf_dir, "tracks")).where("p >= 0.5").groupBy("category").agg(F.count("*").alias("n"))
