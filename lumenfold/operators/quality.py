"""Evaluation of scores against labels: running curves, thresholds, calibration errors, retrieval measures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.vector import dot, rows_of
from lumenfold.operators.search import bank_of
from lumenfold.session import small

#: Equal parts of 0..1 that running counts are first taken over; rows are then ranked within a part only.
BINS = 1024


def running(scored: DataFrame, by: list[str], ident: str = "id", p: str = "p", y: str = "y") -> DataFrame:
    """Adds rn, tp (rows and positives up to and with this row, by p descending, then ident), n and pos (totals) to each row.

    scored has p within 0..1 (null and NaN rows are left out) and y 0 or 1. Counts per part of the score range give each part's
    start, so no window holds a whole group: a group of any size is ranked by up to BINS tasks.
    """
    rows = scored.where(F.col(p).isNotNull() & ~F.isnan(p)).withColumn("__bin", F.least(F.lit(BINS - 1), F.greatest(F.lit(0), F.floor(F.col(p) * BINS))).cast("int"))
    per = rows.groupBy(*by, "__bin").agg(F.count("*").alias("__n"), F.sum(y).alias("__y"))
    before = Window.partitionBy(*by).orderBy(F.desc("__bin")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    zero = F.lit(0).cast("long")
    start = per.select(*by, "__bin", F.coalesce(F.sum("__n").over(before), zero).alias("__rn0"), F.coalesce(F.sum("__y").over(before), zero).alias("__tp0"), F.sum("__n").over(whole).alias("n"), F.sum("__y").over(whole).alias("pos"))
    order = Window.partitionBy(*by, "__bin").orderBy(F.desc(p), ident)
    local = rows.withColumn("__rn", F.row_number().over(order)).withColumn("__tp", F.sum(y).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = local.join(start, [*by, "__bin"])
    return out.withColumn("rn", F.col("__rn0") + F.col("__rn")).withColumn("tp", F.col("__tp0") + F.col("__tp")).drop("__bin", "__rn", "__tp", "__rn0", "__tp0")


def average_precision(curve: DataFrame, by: list[str], y: str = "y") -> DataFrame:
    """Mean of the precision at each positive; null for a group without positives."""
    return curve.groupBy(*by).agg((F.sum(F.when(F.col(y) == 1, F.col("tp") / F.col("rn"))) / F.sum(y)).alias("ap"), F.max("n").alias("n"), F.max("pos").alias("pos"))


def auroc(scored: DataFrame, by: list[str], p: str = "p", y: str = "y") -> DataFrame:
    """Area under the ROC curve with tied scores counted half; null for a one-class group."""
    per = scored.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.sum(y).alias("a"), (F.count("*") - F.sum(y)).alias("b"))
    curve = per.withColumn("__bin", F.least(F.lit(BINS - 1), F.floor(F.col(p) * BINS)).cast("int"))
    coarse = curve.groupBy(*by, "__bin").agg(F.sum("b").alias("nb"))
    before = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    start = coarse.select(*by, "__bin", F.coalesce(F.sum("nb").over(before), F.lit(0).cast("long")).alias("b0"))
    local = Window.partitionBy(*by, "__bin").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    below = curve.withColumn("b1", F.coalesce(F.sum("b").over(local), F.lit(0).cast("long"))).join(start, [*by, "__bin"])
    s = below.groupBy(*by).agg(F.sum(F.col("a") * (F.col("b0") + F.col("b1") + 0.5 * F.col("b"))).alias("u"), F.sum("a").alias("pos"), F.sum("b").alias("neg"))
    return s.select(*by, F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("u") / (F.col("pos") * F.col("neg"))).alias("auroc"), "pos", "neg")


def max_f1(curve: DataFrame, by: list[str], p: str = "p") -> DataFrame:
    """Threshold of highest F1 along the curve; the highest threshold on ties."""
    f1 = 2 * F.col("tp") / (F.col("rn") + F.col("pos"))
    best = curve.withColumn("f1", f1).groupBy(*by).agg(F.max(F.struct("f1", (-F.col("rn")).alias("o"), F.col(p).alias("tau"))).alias("b"))
    return best.select(*by, F.col("b.tau").alias("tau"), F.col("b.f1").alias("f1"))


def tau_for_precision(curve: DataFrame, by: list[str], target: float, p: str = "p") -> DataFrame:
    """Score at the last place along the curve whose precision meets the target; the highest score if none does."""
    ok = F.col("tp") / F.col("rn") >= target
    return curve.groupBy(*by).agg(F.coalesce(F.max_by(p, F.when(ok, F.col("rn"))), F.max(p)).alias("tau"), F.coalesce(F.max(F.when(ok, F.col("tp") / F.greatest(F.col("pos"), F.lit(1)))), F.lit(0.0)).alias("recall"))


def tau_for_recall(scored: DataFrame, by: list[str], target: float, p: str = "p", y: str = "y") -> DataFrame:
    """Score that keeps the target share of the positives: the floor((1 - target) * n)-th of them, ascending."""
    r = running(scored.where(F.col(y) == 1), by, p=p, y=y)
    at = F.col("n") - F.floor(F.round((1 - target) * F.col("n"), 9))
    return r.where(F.col("rn") == at).select(*by, F.col(p).alias("tau"), F.col("n").alias("pos"))


def ece(scored: DataFrame, by: list[str], bins: int = 10, p: str = "p", y: str = "y") -> DataFrame:
    """Expected calibration error over equal bins, the last one closed."""
    b = scored.withColumn("__b", F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)))
    per = b.groupBy(*by, "__b").agg(F.count("*").alias("k"), F.avg(p).alias("c"), F.avg(y).alias("a"))
    return per.groupBy(*by).agg((F.sum(F.col("k") * F.abs(F.col("c") - F.col("a"))) / F.sum("k")).alias("ece"))


def prf(scored: DataFrame, by: list[str], tau: Column | float, p: str = "p", y: str = "y") -> DataFrame:
    """Precision, recall, F1, flagged share and accuracy at a threshold; 0 where a denominator is 0."""
    hit, pos = F.col(p) >= tau, F.col(y) == 1
    c = scored.groupBy(*by).agg(F.count_if(hit & pos).alias("tp"), F.count_if(hit).alias("hit"), F.count_if(pos).alias("pos"), F.count_if(hit == pos).alias("right"), F.count("*").alias("n"))
    one = F.lit(1)
    return c.select(
        *by, (F.col("tp") / F.greatest("hit", one)).alias("precision"), (F.col("tp") / F.greatest("pos", one)).alias("recall"),
        (2 * F.col("tp") / F.greatest(F.col("hit") + F.col("pos"), one)).alias("f1"), (F.col("hit") / F.col("n")).alias("flagged"), (F.col("right") / F.col("n")).alias("accuracy"),
    )


def retrieval_ranks(queries: DataFrame, scores: DataFrame) -> DataFrame:
    """Rank of each query's own item: how many items score strictly higher. scores: (q, id, s); queries: (q, target)."""
    own = scores.join(small(queries), (scores["q"] == queries["q"]) & (scores["id"] == queries["target"])).select(scores["q"], F.col("s").alias("own"))
    return scores.join(small(own), "q").groupBy("q").agg(F.count_if(F.col("s") > F.col("own")).alias("rank"))


def histogram(df: DataFrame, value: str, edges: list[float], by: list[str]) -> DataFrame:
    """Counts between explicit edges, left-closed, the last interval closed; values outside are not counted."""
    v = F.col(value)
    last = len(edges) - 2
    bucket = F.lit(None).cast("int")
    for i in range(last, -1, -1):
        upper = v <= edges[i + 1] if i == last else v < edges[i + 1]
        bucket = F.when((v >= edges[i]) & upper, i).otherwise(bucket)
    return df.withColumn("bin", bucket).where("bin IS NOT NULL").groupBy(*by, "bin").agg(F.count("*").alias("n"))


def ranks_over(items: DataFrame, queries: DataFrame, slack: float = 1e-12) -> DataFrame:
    """(q, rank): for each query (q, target, qe) the number of items, its target left out, with a higher cosine than the target.

    Items: (id, e). The queries are a bank of at most MAX_BANK vectors; every batch of items is multiplied with it once and only
    counts leave the batch.
    """
    own = queries.join(items.select(F.col("id").alias("target"), F.col("e").alias("te")), "target").withColumn("own", dot("qe", "te"))
    names, bank = bank_of(own.withColumnRenamed("qe", "c"), "q", "target", "own")
    if not names:
        return items.sparkSession.createDataFrame([], "q long, rank long")
    q, target, floor = (np.array([n[k] for n in names]) for k in range(3))
    shared = items.sparkSession.sparkContext.broadcast((bank.T.copy(), floor + slack))

    def count(batches):
        right, least = shared.value
        for b in batches:
            if b.num_rows:
                over = rows_of(b.column(1)) @ right > least
                over &= b.column(0).to_numpy()[:, None] != target[None, :]
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(over.sum(0))], names=["q", "n"])

    return items.select("id", "e").mapInArrow(count, "q long, n long").groupBy("q").agg(F.sum("n").alias("rank"))


def top_neighbours(items: DataFrame, queries: DataFrame, vec: str, k: int) -> DataFrame:
    """(q, id, rank): the k items of highest inner product with each query (id, vec), the query left out; ties by id. Every batch
    of items yields at most k candidates a query."""
    names, bank = bank_of(queries.select(F.col("id").alias("q"), F.col(vec).alias("c")), "q")
    q = np.array([n[0] for n in names], np.int64)
    shared = items.sparkSession.sparkContext.broadcast(bank.T.copy())

    def best(batches):
        for b in batches:
            if b.num_rows and len(q):
                ids, c = b.column(0).to_numpy(), np.round(rows_of(b.column(1)) @ shared.value, 12)
                c[ids[:, None] == q[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(ids[:, None], c.shape), -c), axis=0)[:k]
                s = np.take_along_axis(c, order, axis=0)
                i, j = np.nonzero(s > -np.inf)
                yield pa.RecordBatch.from_arrays([pa.array(q[j]), pa.array(ids[order[i, j]]), pa.array(s[i, j])], names=["q", "id", "s"])

    got = items.select("id", vec).mapInArrow(best, "q long, id long, s double")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("q", "id", "rank")
