"""Score cutoffs that keep a target fraction of every source: quantile sketches, exact refinement, exact counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import small, stage

#: KLL parameter; the normalised rank error of a two-sided query is about 2.3 / k**0.9, under 0.4 % here.
SKETCH_K = 1200
#: Half-width of the first bracket around the target rank, as a fraction of a source's rows.
SLACK = 0.01
#: Steps of the grid of ranks that a sketch is asked for.
GRID = 500
#: Grid points that are searched at once when a score is placed between them.
STEP = 22
#: A bracket of at most so many distinct scores is ranked exactly.
BRACKET_SCORES = 5_000


def cutoffs(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Exact cutoffs. rows: (source, score); targets: (source, band, keep_pm), one row per source and band.

    The cutoff is the highest score such that (rows with score >= cutoff) * 1000 >= rows * keep_pm. Returns source, band,
    keep_pm, n_rows, cutoff, n_kept, n_ties (rows at the cutoff). A target of 0 or less keeps the highest score and its
    ties; one over 1000, or a source without rows, gives a null cutoff and keeps nothing.

    A sketch (mergeable, combined map-side) of all rows of a source, ties included, brackets the wanted rank; a counting pass
    proves the bracket (a sketch may err: then the old bracket stays). A bracket that still holds many distinct scores is split
    at quantiles of its distinct scores, all splits are counted, and the one that holds the wanted rank goes on: that holds
    whatever the ties and the sketch's error. Only a bracket of few distinct scores is ranked in a window.
    """
    scored = rows.where("score IS NOT NULL AND NOT isnan(score)").select("source", "score")
    rows = stage(scored.groupBy("source", "score").agg(F.count("*").alias("n")), "scores")
    totals = rows.groupBy("source").agg(F.sum("n").alias("n_rows"), F.max("score").alias("hi"), F.min("score").alias("lo"), F.count("*").alias("d"))
    state = stage(
        targets.where("keep_pm IS NOT NULL")
        .join(totals, "source")
        .withColumn("need", F.greatest(F.lit(1), F.ceil(F.col("n_rows") * F.col("keep_pm") / 1000)).cast("long"))
        .where("need <= n_rows")
        .withColumn("above", F.lit(0).cast("long"))  # rows over hi
        .withColumn("inside", F.col("n_rows")),  # rows in lo..hi
        "cut-state",
    )
    state = stage(_bracket(scored, rows, state), "cut-state")  # every source is sketched once, the large ones are split on
    while (state.agg(F.max("d")).first()[0] or 0) > BRACKET_SCORES:
        state = stage(_split(rows, state), "cut-state")
    inside = rows.join(small(state), "source").where("score BETWEEN lo AND hi")
    run = Window.partitionBy("source", "band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    reached = inside.withColumn("kept", F.col("above") + F.sum("n").over(run)).where("kept >= need")
    found = reached.groupBy("source", "band").agg(F.max("score").alias("cutoff"), F.min("kept").alias("n_kept"), F.max_by("n", "score").alias("n_ties"))
    return (
        targets.join(totals.select("source", "n_rows"), "source", "left")
        .join(found, ["source", "band"], "left")
        .select("source", "band", "keep_pm", F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), "cutoff", F.coalesce("n_kept", F.lit(0).cast("long")).alias("n_kept"), F.coalesce("n_ties", F.lit(0).cast("long")).alias("n_ties"))
    )


def _grid(sketch: DataFrame) -> DataFrame:
    """The sketch's quantiles on a grid, as q: the ranks asked of a sketch must be constant."""
    grid = F.array(*[F.lit(i / GRID) for i in range(GRID + 1)])
    return sketch.withColumn("q", F.kll_sketch_get_quantile_double("sk", grid)).drop("sk")


def _bracket(scored: DataFrame, rows: DataFrame, state: DataFrame) -> DataFrame:
    """One sketch pass over the rows themselves, so that ranks are ranks of rows, and one counting pass."""
    mine = small(state.select("source").distinct())
    sketch = scored.join(mine, "source").groupBy("source").agg(F.kll_sketch_agg_double("score", F.lit(SKETCH_K)).alias("sk"))
    # rank from below of the wanted row, as a fraction of the rows
    at = 1 - F.col("need") / F.col("inside")
    low = F.greatest(F.lit(0), F.floor((at - SLACK) * GRID)).cast("int") + 1
    high = F.least(F.lit(GRID), F.ceil((at + SLACK) * GRID)).cast("int") + 1
    bounds = _grid(sketch).join(state, "source").select("source", "band", F.element_at("q", low).alias("new_lo"), F.element_at("q", high).alias("new_hi"))
    counted = (
        rows.join(small(bounds), "source")
        .groupBy("source", "band", "new_lo", "new_hi")
        .agg(
            F.sum(F.when(F.col("score") > F.col("new_hi"), F.col("n")).otherwise(0)).alias("over"),
            F.sum(F.when(F.col("score").between(F.col("new_lo"), F.col("new_hi")), F.col("n")).otherwise(0)).alias("within"),
            F.sum(F.when(F.col("score").between(F.col("new_lo"), F.col("new_hi")), 1).otherwise(0)).alias("new_d"),
        )
    )
    good = F.col("new_lo").isNotNull() & (F.col("over") < F.col("need")) & (F.col("over") + F.col("within") >= F.col("need"))
    pick = lambda new, old: F.when(good, new).otherwise(F.col(old)).alias(old)
    joined = state.join(counted, ["source", "band"], "left")
    new = {"lo": F.col("new_lo"), "hi": F.col("new_hi"), "above": F.col("over"), "inside": F.col("within"), "d": F.col("new_d")}
    return joined.select(*[pick(new[c], c) if c in new else F.col(c) for c in state.columns])


def _split(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Splits each bracket of more than BRACKET_SCORES distinct scores at quantiles of these, each score once, and keeps the part
    with the wanted row. The parts cover the bracket and are counted exactly. The grid has the highest score, which is parted
    from the lowest, so every pass narrows the bracket; a part has about 1 / GRID of the distinct scores."""
    wide = state.where(F.col("d") > BRACKET_SCORES)
    inside = rows.join(small(wide), "source").where("score BETWEEN lo AND hi").select("source", "band", "score", "n", "need", "above")
    sketch = inside.groupBy("source", "band").agg(F.kll_sketch_agg_double("score", F.lit(SKETCH_K)).alias("sk"))
    points = _grid(sketch).withColumn("q", F.array_sort(F.array_distinct("q")))
    points = small(stage(points.withColumn("coarse", F.filter("q", lambda x, i: i % STEP == 0)), "cut-points"))
    upto = lambda a: F.size(F.filter(a, lambda x: x <= F.col("score")))
    placed = inside.join(points, ["source", "band"]).withColumn("c", F.greatest(F.lit(1), upto("coarse")))
    placed = placed.withColumn("at", (F.col("c") - 1) * STEP + upto(F.slice("q", (F.col("c") - 1) * STEP + 1, F.lit(STEP))))
    parts = placed.groupBy("source", "band", "need", "above", "at").agg(F.sum("n").alias("within"), F.count("*").alias("new_d"), F.min("score").alias("new_lo"), F.max("score").alias("new_hi"))
    run = Window.partitionBy("source", "band").orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, 0)
    reached = parts.withColumn("upto", F.col("above") + F.sum("within").over(run)).where("upto >= need AND upto - within < need")
    new = reached.select("source", "band", "new_lo", "new_hi", (F.col("upto") - F.col("within")).alias("over"), "within", "new_d")
    joined = state.join(new, ["source", "band"], "left")
    names = {"lo": "new_lo", "hi": "new_hi", "above": "over", "inside": "within", "d": "new_d"}
    return joined.select(*[F.coalesce(names[c], c).alias(c) if c in names else F.col(c) for c in state.columns])


def weapons_rows(tracks: DataFrame, usable: DataFrame | None = None) -> DataFrame:
    """Usable rows of category weapons, any tier: (source, track_id, score)."""
    from lumenfold.llm.topn import usable_tracks

    kept = tracks.where(F.lower(F.trim("category")) == "weapons")
    return usable_tracks(kept).select(F.col("dataset").alias("source"), "track_id", F.col("p").alias("score")).distinct()


def head_targets(heads: DataFrame) -> DataFrame:
    """(source, band, keep_pm) of every dataset's head; of several heads the one fitted last counts, a null target asks nothing."""
    one = heads.where("dataset IS NOT NULL").groupBy("dataset").agg(F.max(F.struct("fitted_at", "keep_review_pm", "keep_violation_pm")).alias("h"))
    return one.select(
        F.col("dataset").alias("source"),
        F.expr("stack(2, 'review', h.keep_review_pm, 'violation', h.keep_violation_pm) AS (band, keep_pm)"),
    ).where("keep_pm IS NOT NULL")


def weapons_cutoffs(tracks: DataFrame, heads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(report per dataset and band, kept rows per band): new tau_review and tau_violation with the numbers kept."""
    targets = stage(head_targets(heads), "cut-targets")
    mine = small(targets.select("source").distinct())
    rows = stage(weapons_rows(tracks).join(mine, "source", "left_semi"), "cut-rows")
    report = stage(cutoffs(rows.select("source", "score"), targets), "cut-report")
    kept = rows.join(small(report.select("source", "band", "cutoff").where("cutoff IS NOT NULL")), "source").where("score >= cutoff")
    return report, kept.select("band", "track_id", "source", "score")
