"""Search over embedded items as one lazy plan: score, fuse, rank, filter, collapse."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.calib import KEEP_COS, STD_FLOOR, UNFITTED_EFF, platt, text_p
from lumenfold.functions.vector import products
from lumenfold.session import small


#: Vectors of a bank that is multiplied with every item; more are refused.
MAX_BANK = 20_000


def bank_of(tags: DataFrame, *names: str) -> tuple[list, np.ndarray]:
    """(rows of names, matrix of the vectors c), gathered: a bank of at most MAX_BANK vectors, refused beyond."""
    rows = tags.select(*names, "c").orderBy(*names).limit(MAX_BANK + 1).collect()
    if len(rows) > MAX_BANK:
        raise ValueError(f"over {MAX_BANK} vectors in a bank")
    return [tuple(r)[:-1] for r in rows], np.array([r["c"] for r in rows], np.float64).reshape(len(rows), -1)


def score_tags(items: DataFrame, tags: DataFrame) -> DataFrame:
    """Items against every candidate tag: (id, ds, idx, cos), by one matrix product a batch."""
    names, bank = bank_of(tags, "idx")
    if not names:
        return items.select("id", "ds", F.lit(0).alias("idx"), F.lit(0.0).alias("cos")).limit(0)
    s = products(items, ["id", "ds"], "e", bank)
    kind = tags.schema["idx"].dataType
    idx = F.array(*[F.lit(n[0]).cast(kind) for n in names])
    return s.select("id", "ds", F.explode(F.arrays_zip(idx.alias("idx"), "cos")).alias("s")).select("id", "ds", "s.idx", "s.cos")


def calibrate(scores: DataFrame, fits: DataFrame) -> DataFrame:
    """Adds p and eff of each (item, tag): fitted tags by Platt with threshold tau (0.5 if null, raised to the corpus mean + 3 std
    where statistics exist); others by the raw-cosine logistic with a threshold that never fires."""
    s = scores.join(small(fits), "idx", "left")
    fitted = F.col("a").isNotNull()
    return s.select(
        "id", "ds", "idx", "cos", fitted.alias("fitted"),
        F.when(fitted, platt(F.col("cos"), F.col("a"), F.col("b"))).otherwise(text_p(F.col("cos"))).alias("p"),
        F.when(fitted, F.greatest(F.coalesce("tau", F.lit(0.5)), F.coalesce("raised", F.lit(0.0)))).otherwise(UNFITTED_EFF).alias("eff"),
    )


def fuse(tagged: DataFrame, text: DataFrame) -> DataFrame:
    """One row an item: p_tag (the best tag, uncalibrated ones capped by the best calibrated tag or the text), p_text, p and the
    path that won; the tag path wins only if strictly better."""
    best = tagged.groupBy("id", "ds").agg(
        F.max(F.when(F.col("fitted"), F.col("p"))).alias("p_fit"),
        F.max(F.when(~F.col("fitted"), F.col("p"))).alias("p_raw"),
        F.bool_or(F.col("fitted") & (F.col("p") >= F.col("eff"))).alias("present"),
        F.max("cos").alias("tag_cos"),
    )
    j = best.join(text, ["id", "ds"])
    cap = F.greatest(F.coalesce("p_fit", F.lit(0.0)), F.col("p_text"))
    p_tag = F.greatest(F.coalesce("p_fit", F.lit(0.0)), F.least(F.coalesce("p_raw", F.lit(0.0)), cap))
    return j.withColumn("p_tag", p_tag).withColumn("p", F.greatest("p_tag", "p_text")).withColumn("path", F.when(F.col("p_tag") > F.col("p_text"), "tag").otherwise("text"))


def corpus_z(scores: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Adds z of value within each group: population standard deviation, floored at 1e-6. The statistics are one small
    aggregate, joined back; the rows themselves are not shuffled into one window."""
    stats = scores.groupBy(*by).agg(F.avg(value).alias("__m"), F.stddev_pop(value).alias("__s"))
    joined = scores.join(small(stats), by) if by else scores.crossJoin(F.broadcast(stats))  # one row
    return joined.withColumn("z", (F.col(value) - F.col("__m")) / F.greatest(F.col("__s"), F.lit(STD_FLOOR))).drop("__m", "__s")


def keep(cos: Column, p_tag: Column | None = None, fitted: bool = False) -> Column:
    """Row mask: raw cosine of at least 0.18, or a fitted tag probability of at least 0.5."""
    mask = cos >= KEEP_COS
    return mask | (p_tag >= 0.5) if fitted and p_tag is not None else mask


def coverage(hits: DataFrame, terms: int, present: float) -> DataFrame:
    """All / some / any ranking. hits: (id, ds, term, p). matched counts terms with p >= present, mean_p averages them."""
    on = F.col("p") >= present
    per = hits.groupBy("id", "ds", "term").agg(F.max("p").alias("p"))
    out = per.groupBy("id", "ds").agg(
        F.count_if(on).cast("int").alias("matched"),
        F.coalesce(F.avg(F.when(on, F.col("p"))), F.lit(0.0)).alias("mean_p"),
        F.max("p").alias("p"),
    )
    name = F.when(F.col("matched") == terms, "all").when(F.col("matched") > 1, "some").when(F.col("matched") == 1, "any").otherwise("none")
    return out.withColumn("spectrum", name)


def rank_hits(hits: DataFrame, k: int) -> DataFrame:
    """Final order: matched terms, mean p, p rounded to four places, id; the first k."""
    return hits.orderBy(F.desc("matched"), F.desc("mean_p"), F.desc(F.round("p", 4)), "id").limit(k)


def top_per_set(hits: DataFrame, k: int, order: list[Column], by: str = "ds") -> DataFrame:
    """First k of each data set; Spark's group limit drops rows before the shuffle."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def collapse(hits: DataFrame, key: str, order: list[Column], fold: str) -> DataFrame:
    """Duplicates collapse on the best-ranked row of each key; the others' `fold` values come along, distinct and sorted, with
    their number."""
    w = Window.partitionBy(key)
    ranked = hits.withColumn("__r", F.row_number().over(w.orderBy(*order)))
    others = F.array_sort(F.array_distinct(F.collect_list(F.when(F.col("__r") > 1, F.col(fold))).over(w)))
    return ranked.withColumn("also_in", others).withColumn("collapsed", (F.count("*").over(w) - 1).cast("int")).where("__r = 1").drop("__r")


def no_match(hits: DataFrame, gated: Column, dense_dead: Column, text_fitted: Column, best_text: Column) -> DataFrame:
    """Whether a search honestly has no answer: no hit, or no calibrated tag clears its threshold anywhere while the dense scores
    are dead or a fitted text path stays under 0.5."""
    return hits.withColumn("no_match", (F.col("n_hits") == 0) | (~gated & (dense_dead | (text_fitted & (best_text < 0.5)))))


def closure(edges: DataFrame, roots: DataFrame, depth: int = 3) -> DataFrame:
    """(root, term, level): everything below each root within `depth` levels, least level, safe with cycles.

    edges (parent, child) is reference data of bounded size; each level is one join.
    """
    level = roots.select(F.col("root"), F.col("root").alias("term"), F.lit(0).alias("level")).distinct()
    found = level
    for d in range(1, depth + 1):
        level = level.join(edges, level["term"] == edges["parent"]).select("root", F.col("child").alias("term"), F.lit(d).alias("level")).distinct()
        found = found.unionByName(level)
    return found.groupBy("root", "term").agg(F.min("level").alias("level"))
