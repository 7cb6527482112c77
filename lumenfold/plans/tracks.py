"""Track queries: margins, tier derivation, roll-ups, flagged lists, heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import calib as cal
from lumenfold.operators import tracks as op
from lumenfold.operators.catalog import items, tag_vectors
from lumenfold.plans.search import CENTROIDS, SIG
from lumenfold.registry import CORE
from lumenfold.session import table

# concept banks over the label centroids: (category, role, label)
BANK = [("x", "violation", 0), ("x", "violation", 1), ("x", "review", 2), ("x", "negative", 3), ("x", "negative", 4), ("y", "alert", 5), ("y", "review", 6), ("y", "negative", 7), ("y", "negative", 8), ("z", "match", 9)]
BANK_SQL = "bank AS (SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{r}', {k})" for c, r, k in BANK) + ") AS v(category, role, idx))"
SCORES = f"""{CENTROIDS}, {BANK_SQL}, s AS (SELECT u.id, u.ds, category, role, max(list_dot_product(u.e, c.c)) AS best, avg(list_dot_product(u.e, c.c)) AS mean FROM u, c JOIN bank USING (idx) GROUP BY ALL)"""
MARGINS = f"""{SCORES}, n AS (SELECT id, category, best AS nb, mean AS nm FROM s WHERE role = 'negative'),
mg AS (SELECT s.id, s.ds, s.category, s.role, best - coalesce(nb, 0) AS margin, mean - 0.5 * coalesce(nm, 0) AS mean_margin FROM s LEFT JOIN n ON s.id = n.id AND s.category = n.category WHERE s.role <> 'negative')"""
RANK = "CASE {} WHEN 'alert' THEN 0 WHEN 'violation' THEN 1 WHEN 'review' THEN 2 WHEN 'match' THEN 3 WHEN 'none' THEN 4 ELSE 5 END"
CLEAN = """tr AS (SELECT DISTINCT track_id, dataset, image_id, lower(trim(category)) AS category, lower(trim(tier)) AS tier,
    CASE WHEN p IS NOT NULL AND NOT isnan(p) AND p BETWEEN 0 AND 1 THEN p END AS p, model_id FROM tracks)"""


def _concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    it = items(spark, sf_dir)
    bank = spark.createDataFrame(BANK, "category string, role string, idx int")
    return it, tag_vectors(it).join(F.broadcast(bank), "idx")


def _margins(spark: SparkSession, sf_dir: str, form: str = "max") -> DataFrame:
    return op.margins(op.bank_scores(*_concepts(spark, sf_dir)), form)


@CORE.add("track_margin", f"WITH {MARGINS} SELECT id, category, role, round(margin, 6) AS margin FROM mg")
def track_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best concept of a role against the best negative."""
    return _margins(spark, sf_dir).select("id", "category", "role", F.round("margin", 6).alias("margin"))


@CORE.add("track_mean_margin", f"WITH {MARGINS} SELECT id, category, role, round(mean_margin, 6) AS margin FROM mg")
def track_mean_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean form: role mean minus half the negatives' mean."""
    return _margins(spark, sf_dir, "mean").select("id", "category", "role", F.round("margin", 6).alias("margin"))


@CORE.add("track_margin_batched", f"WITH {SCORES} SELECT id, category, role, round(best, 6) AS best, round(mean, 6) AS mean FROM s")
def track_margin_batched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Role scores by one matrix product per batch."""
    import numpy as np

    it, concepts = _concepts(spark, sf_dir)
    rows = concepts.orderBy("category", "role", "idx").select("category", "role", "c").collect()  # the bank: a few concepts
    got = op.bank_scores_batched(it, [(r[0], r[1]) for r in rows], np.array([r[2] for r in rows]))
    return got.select("id", "category", "role", F.round("best", 6).alias("best"), F.round("mean", 6).alias("mean"))


UNFITTED = f"""{MARGINS}, st AS (SELECT ds, category, role, avg(margin) AS m, greatest(stddev_pop(margin), 1e-6) AS s FROM mg GROUP BY ALL),
zz AS (SELECT mg.*, {SIG.format("1.6 * ((margin - m) / st.s) - 4")} AS p FROM mg JOIN st USING (ds, category, role)),
ov AS (SELECT *, row_number() OVER (PARTITION BY id, category ORDER BY p DESC, {RANK.format("role")}) AS r FROM zz),
un AS (SELECT id, ds, category, role AS picked, p, margin, CASE WHEN p >= {SIG.format("1.6 * 3 - 4")} AND margin >= 0.02 THEN role ELSE 'none' END AS tier FROM ov WHERE r = 1)"""


@CORE.add("track_unfitted", f"WITH {UNFITTED} SELECT id, category, tier, picked, round(p, 4) AS p, round(margin, 6) AS margin FROM un")
def track_unfitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers without a fit: z within the data set, argmax over roles, two guards."""
    return op.derive_unfitted(_margins(spark, sf_dir)).select("id", "category", "tier", "picked", F.round("p", 4).alias("p"), F.round("margin", 6).alias("margin"))


@CORE.add(
    "track_band",
    f"WITH {CLEAN} SELECT track_id, category, CASE WHEN p IS NULL THEN 'unknown' WHEN category = 'safety' AND p >= 0.9 THEN 'alert' WHEN p >= 0.7 THEN 'violation' WHEN p >= 0.4 THEN 'review' ELSE 'none' END AS derived FROM tr",
)
def track_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Severity banding of stored scores, most severe cleared threshold first; not scored is unknown (F11 SRC4 Q4)."""
    alert = F.when(F.col("category") == "safety", 0.9)
    return op.clean_tracks(table(spark, sf_dir, "tracks")).select("track_id", "category", cal.band(F.col("p"), [("alert", alert), ("violation", 0.7), ("review", 0.4)]).alias("derived"))


PLATT = "CASE WHEN {m} IS NOT NULL THEN 1 / (1 + exp(least(30, greatest(-30, -10.0 * {m})))) END"


@CORE.add(
    "track_arbitrated",
    f"""WITH {MARGINS}, w AS (SELECT id, max(margin) FILTER (role = 'violation') AS m, max(margin) FILTER (role = 'review') AS mr FROM mg WHERE category = 'x' GROUP BY id),
    p AS (SELECT *, {PLATT.format(m="m")} AS pv, {PLATT.format(m="mr")} AS pr FROM w)
    SELECT id, round(pv, 4) AS pv, round(pr, 4) AS pr, CASE WHEN m IS NULL THEN 'unknown' WHEN pv >= 0.55 AND m >= mr + 0.1 THEN 'violation' WHEN pr >= 0.55 OR pv >= 0.55 THEN 'review' ELSE 'none' END AS tier FROM p""",
)
def track_arbitrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two margins arbitrated into one tier."""
    m = _margins(spark, sf_dir).where("category = 'x'").groupBy("id").agg(F.max(F.when(F.col("role") == "violation", F.col("margin"))).alias("m"), F.max(F.when(F.col("role") == "review", F.col("margin"))).alias("mr"))
    tier = cal.arbitrated(F.col("m"), F.col("mr"), -10.0, 0.0, 0.55, 0.55, 0.1)
    return m.select("id", F.round(cal.platt(F.col("m"), -10.0, 0.0), 4).alias("pv"), F.round(cal.platt(F.col("mr"), -10.0, 0.0), 4).alias("pr"), tier.alias("tier"))


@CORE.add(
    "track_router",
    f"""WITH {MARGINS}, {CLEAN.replace("tr AS", "tr0 AS")}, a AS (SELECT category, 'margin' AS form, count(*) AS n, count(*) FILTER (margin >= 0.3) AS fired FROM mg GROUP BY category),
    b AS (SELECT category, 'band' AS form, count(*) AS n, count(*) FILTER (p >= 0.7) AS fired FROM tr0 GROUP BY category)
    SELECT category, CASE WHEN form = 'margin' THEN 'pending' ELSE 'fitted' END AS calibration, n, CASE WHEN form = 'margin' THEN 0 ELSE fired END AS fired FROM (SELECT * FROM a UNION ALL SELECT * FROM b)""",
)
def track_router(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored roles are routed by their space: margins without a fit stay pending, probabilities are banded."""
    m = _margins(spark, sf_dir).groupBy("category").agg(F.count("*").alias("n")).select("category", F.lit("pending").alias("calibration"), "n", F.lit(0).cast("long").alias("fired"))
    t = op.clean_tracks(table(spark, sf_dir, "tracks")).groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.7).alias("fired"))
    return m.unionByName(t.select("category", F.lit("fitted").alias("calibration"), "n", "fired"))


CATS = ["drugs", "nudity", "safety", "sports", "violence", "weapons"]


@CORE.add(
    "moderation_counts",
    f"""WITH {CLEAN}, g AS (SELECT c.category, t.tier FROM (VALUES {", ".join(f"('{c}')" for c in CATS)}) AS c(category), (VALUES {", ".join(f"('{t}')" for t in cal.TIERS)}) AS t(tier)),
    n AS (SELECT category, coalesce(tier, 'unknown') AS tier, count(*) AS n FROM tr GROUP BY ALL) SELECT category, tier, coalesce(n, 0) AS n FROM g FULL JOIN n USING (category, tier)""",
)
def moderation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows per category and tier on the full grid, zeros included."""
    return op.tier_counts(op.clean_tracks(table(spark, sf_dir, "tracks")), CATS)


@CORE.add(
    "moderation_split",
    f"""WITH {CLEAN} SELECT dataset, count(*) FILTER (tier IN ('alert', 'violation', 'review') AND category <> 'sports') AS enforcement, count(*) FILTER (tier = 'match' OR (category = 'sports' AND tier IN ('violation', 'review'))) AS content,
    count(*) FILTER (p IS NULL) AS unscored FROM tr GROUP BY dataset""",
)
def moderation_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enforcement tiers apart from content tiers, per data set (A2 A4)."""
    t, c = F.col("tier"), F.col("category")
    return op.clean_tracks(table(spark, sf_dir, "tracks")).groupBy("dataset").agg(
        F.count_if(t.isin("alert", "violation", "review") & (c != "sports")).alias("enforcement"),
        F.count_if((t == "match") | ((c == "sports") & t.isin("violation", "review"))).alias("content"),
        F.count_if(F.col("p").isNull()).alias("unscored"),
    )


@CORE.add(
    "moderation_summary",
    f"""WITH {CLEAN}, n AS (SELECT dataset, tier, category, count(*) AS n FROM tr WHERE tier IN ('alert', 'violation', 'review', 'match') GROUP BY ALL)
    SELECT dataset, string_agg(n || ' ' || category || ' ' || tier, ', ' ORDER BY {RANK.format("tier")}, category) AS summary FROM n GROUP BY dataset""",
)
def moderation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One line of text per data set: counts in order of severity (A3)."""
    n = op.clean_tracks(table(spark, sf_dir, "tracks")).where(F.col("tier").isin("alert", "violation", "review", "match")).groupBy("dataset", "tier", "category").agg(F.count("*").alias("n"))
    part = F.struct(cal.tier_rank(F.col("tier")).alias("o"), "category", F.concat_ws(" ", "n", "category", "tier").alias("s"))
    return n.groupBy("dataset").agg(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda x: x.s), ", ").alias("summary"))


@CORE.add(
    "moderation_pivot",
    f"WITH {CLEAN} SELECT category, " + ", ".join(f"count(*) FILTER (tier = '{t}') AS {t}" for t in ("alert", "violation", "review", "match", "none")) + " FROM tr GROUP BY category",
)
def moderation_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers as columns."""
    names = ["alert", "violation", "review", "match", "none"]
    p = op.clean_tracks(table(spark, sf_dir, "tracks")).groupBy("category").pivot("tier", names).agg(F.count("track_id"))
    return p.select("category", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])


@CORE.add(
    "alert_rollup",
    f"""WITH {CLEAN} SELECT dataset, count(DISTINCT image_id) FILTER (tier IN ('alert', 'violation')) AS alerts, count(DISTINCT image_id) AS images FROM tr GROUP BY dataset
    UNION ALL SELECT '*', count(DISTINCT image_id) FILTER (tier IN ('alert', 'violation')), count(DISTINCT image_id) FROM tr""",
)
def alert_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures with any alert, once each, per data set and in all."""
    return op.alert_rollup(op.clean_tracks(table(spark, sf_dir, "tracks")), ["alert", "violation"])


@CORE.add(
    "tier_rollup",
    f"WITH {CLEAN} SELECT coalesce(category, '*') AS category, coalesce(tier, '*') AS tier, count(*) AS n, grouping(category)::INT + grouping(tier)::INT AS level FROM tr WHERE tier IS NOT NULL GROUP BY ROLLUP (category, tier)",
)
def tier_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by category and tier, by category, and in all."""
    r = op.clean_tracks(table(spark, sf_dir, "tracks")).where("tier IS NOT NULL").rollup("category", "tier").agg(F.count("*").alias("n"), (F.grouping("category") + F.grouping("tier")).cast("int").alias("level"))
    return r.select(F.coalesce("category", F.lit("*")).alias("category"), F.coalesce("tier", F.lit("*")).alias("tier"), "n", "level")


@CORE.add(
    "flagged_topk",
    f"""WITH {CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY category, tier ORDER BY p DESC, image_id, track_id) AS rk FROM tr WHERE tier IN ('alert', 'violation', 'review', 'match') AND p IS NOT NULL)
    SELECT category, tier, rk::INT AS rank, track_id, image_id, p FROM r WHERE rk <= 20""",
)
def flagged_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top of each category and tier by p."""
    return op.flagged(op.clean_tracks(table(spark, sf_dir, "tracks")), 20, ["alert", "violation", "review", "match"]).select("category", "tier", "rank", "track_id", "image_id", "p")


@CORE.add(
    "track_browse",
    f"WITH {CLEAN} SELECT track_id, tier, p FROM tr WHERE category = 'weapons' AND tier IN ('alert', 'violation', 'review') AND p IS NOT NULL ORDER BY {RANK.format('tier')}, p DESC, image_id, track_id LIMIT 100",
)
def track_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Browse one track without a query, in order of severity."""
    t = op.clean_tracks(table(spark, sf_dir, "tracks")).where("category = 'weapons' AND tier IN ('alert', 'violation', 'review') AND p IS NOT NULL")
    return t.orderBy(cal.tier_rank(F.col("tier")), F.desc("p"), "image_id", "track_id").limit(100).select("track_id", "tier", "p")


@CORE.add(
    "image_flags",
    f"""WITH {CLEAN} SELECT dataset, image_id, string_agg(category || ':' || tier, ' ' ORDER BY {RANK.format("tier")}, coalesce(p, 0) DESC, category) AS flags FROM tr WHERE tier IN ('alert', 'violation', 'review', 'match') GROUP BY dataset, image_id""",
)
def image_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fired flags of each picture in order of severity."""
    return op.image_flags(op.clean_tracks(table(spark, sf_dir, "tracks")), ["alert", "violation", "review", "match"]).withColumn("flags", F.array_join("flags", " "))


@CORE.add(
    "image_panel",
    f"""WITH {CLEAN}, i AS (SELECT min(image_id) AS image_id FROM tr WHERE dataset = 'city-archive'), s AS (SELECT * FROM (VALUES {", ".join(f"('{c}')" for c in [*CATS, "people"])}) AS v(category))
    SELECT s.category, coalesce(t.tier, 'unknown') AS tier, t.p, t.track_id IS NOT NULL AS stored FROM s LEFT JOIN (SELECT * FROM tr WHERE dataset = 'city-archive' AND image_id = (SELECT image_id FROM i)) t USING (category)""",
)
def image_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track of one picture, scored or not."""
    t = op.clean_tracks(table(spark, sf_dir, "tracks")).where("dataset = 'city-archive'")
    mine = t.join(F.broadcast(t.agg(F.min("image_id").alias("image_id"))), "image_id", "left_semi")
    s = spark.createDataFrame([(c,) for c in [*CATS, "people"]], "category string")
    return s.join(mine, "category", "left").select("category", F.coalesce("tier", F.lit("unknown")).alias("tier"), "p", F.col("track_id").isNotNull().alias("stored"))


LAYERS = """base AS (SELECT * FROM (VALUES ('weapons', 0.8, 0.5), ('drugs', 0.7, 0.4), ('nudity', 0.9, 0.6)) AS v(category, tau_v, tau_r)),
rec AS (SELECT * FROM (VALUES ('weapons', 0.75, NULL), ('drugs', NULL, 0.35)) AS v(category, tau_v, tau_r)), fit AS (SELECT * FROM (VALUES ('nudity', 0.6, 0.3)) AS v(category, tau_v, tau_r)),
cfg AS (SELECT base.category, coalesce(fit.tau_v, rec.tau_v, base.tau_v)::DOUBLE AS tau_v, coalesce(fit.tau_r, rec.tau_r, base.tau_r)::DOUBLE AS tau_r FROM base LEFT JOIN rec USING (category) LEFT JOIN fit USING (category))"""


def _cfg(spark: SparkSession) -> DataFrame:
    kind = "category string, tau_v double, tau_r double"
    base = spark.createDataFrame([("weapons", 0.8, 0.5), ("drugs", 0.7, 0.4), ("nudity", 0.9, 0.6)], kind)
    rec = spark.createDataFrame([("weapons", 0.75, None), ("drugs", None, 0.35)], kind)
    return op.overlay([base, rec, spark.createDataFrame([("nudity", 0.6, 0.3)], kind)], ["category"], ["tau_v", "tau_r"])


@CORE.add("config_overlay", f"WITH {LAYERS} SELECT * FROM cfg")
def config_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered thresholds, last value wins (J14 SRC12 SRC13)."""
    return _cfg(spark)


@CORE.add(
    "recount_after_refit",
    f"""WITH {CLEAN}, {LAYERS}, d AS (SELECT dataset, category, CASE WHEN p IS NULL THEN 'unknown' WHEN p >= tau_v THEN 'violation' WHEN p >= tau_r THEN 'review' ELSE 'none' END AS tier FROM tr JOIN cfg USING (category))
    SELECT dataset, category, tier, count(*) AS n FROM d GROUP BY ALL""",
)
def recount_after_refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts re-derived from stored scores under the thresholds in force (SNK12 O6)."""
    d = op.clean_tracks(table(spark, sf_dir, "tracks")).join(F.broadcast(_cfg(spark)), "category")
    tier = cal.band(F.col("p"), [("violation", F.col("tau_v")), ("review", F.col("tau_r"))])
    return d.groupBy("dataset", "category", tier.alias("tier")).agg(F.count("*").alias("n"))


HEADS = """hd AS (SELECT dataset, list_transform(weight_vec, lambda x: x::DOUBLE) AS w, b, platt[1] AS pa, platt[2] AS pb, tau_violation, tau_review,
    row_number() OVER (PARTITION BY dataset ORDER BY fitted_at DESC, model_id) AS r FROM weapons_heads), h1 AS (SELECT * FROM hd WHERE r = 1)"""


@CORE.add(
    "head_scores",
    f"""WITH {HEADS}, i AS (SELECT rec_id, dataset, list_transform(emb, lambda x: x::DOUBLE) AS e FROM images WHERE emb IS NOT NULL AND len(emb) = 64 AND NOT list_bool_or(list_transform(emb, lambda x: isnan(x)))),
    s AS (SELECT rec_id, i.dataset, list_dot_product(e, w) + b AS raw, pa, pb FROM i JOIN h1 USING (dataset))
    SELECT rec_id, dataset, round(raw, 4) AS raw, round(1 / (1 + exp(least(30, greatest(-30, pa * raw + pb)))), 4) AS p FROM s""",
)
def head_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each data set's linear head over its own records: weights dot vector plus bias, then Platt."""
    h = table(spark, sf_dir, "weapons_heads").withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("fitted_at"), "model_id"))).where("r = 1")
    h = h.select("dataset", F.col("weight_vec").alias("w"), "b", F.col("platt")[0].alias("pa"), F.col("platt")[1].alias("pb"))
    i = table(spark, sf_dir, "images").where("emb IS NOT NULL AND size(emb) = 64 AND NOT exists(emb, x -> isnan(x))").select("rec_id", "dataset", "emb")
    from lumenfold.functions.vector import dot

    s = i.join(h, "dataset").withColumn("raw", dot("emb", "w") + F.col("b"))
    return s.select("rec_id", "dataset", F.round("raw", 4).alias("raw"), F.round(cal.platt(F.col("raw"), F.col("pa"), F.col("pb")), 4).alias("p"))


@CORE.add(
    "head_tiers",
    f"""WITH {HEADS}, {CLEAN}, c AS (SELECT dataset, CASE WHEN isnan(tau_violation) THEN NULL ELSE tau_violation END AS tv, CASE WHEN isnan(tau_review) THEN NULL ELSE tau_review END AS tv2 FROM h1)
    SELECT track_id, CASE WHEN p IS NULL THEN 'unknown' WHEN tv IS NULL OR tv2 IS NULL OR tv < tv2 THEN 'pending' WHEN p >= tv THEN 'violation' WHEN p >= tv2 THEN 'review' ELSE 'none' END AS tier FROM tr JOIN c USING (dataset) WHERE category = 'weapons'""",
)
def head_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers from each head's own thresholds; missing or misordered thresholds leave rows pending."""
    h = table(spark, sf_dir, "weapons_heads").withColumn("r", F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc("fitted_at"), "model_id"))).where("r = 1")
    h = h.select("dataset", cal.clean_score(F.col("tau_violation")).alias("tv"), cal.clean_score(F.col("tau_review")).alias("tr"))
    t = op.clean_tracks(table(spark, sf_dir, "tracks")).where("category = 'weapons'").join(h, "dataset")
    pending = F.col("tv").isNull() | F.col("tr").isNull() | (F.col("tv") < F.col("tr"))
    tier = F.when(F.col("p").isNull(), "unknown").when(pending, "pending").otherwise(cal.band(F.col("p"), [("violation", F.col("tv")), ("review", F.col("tr"))]))
    return t.select("track_id", tier.alias("tier"))


@CORE.add(
    "scorer_why",
    f"""WITH {CENTROIDS}, {BANK_SQL}, s AS (SELECT u.id, category, role, idx, list_dot_product(u.e, c.c) AS cos FROM u, c JOIN bank USING (idx)),
    p AS (SELECT id, category, arg_max(idx, (cos, -idx)) FILTER (role <> 'negative') AS why, arg_max(idx, (cos, -idx)) FILTER (role = 'negative') AS nearest_benign, max(cos) FILTER (role <> 'negative') - coalesce(max(cos) FILTER (role = 'negative'), 0) AS m FROM s GROUP BY ALL)
    SELECT id, category, why, nearest_benign, round(least({SIG.format("20 * m")}, 4.0 / 5.0), 4) AS p FROM p""",
)
def scorer_why(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The concept that decided and the nearest benign one, with the evidence cap on p."""
    from lumenfold.functions.vector import dot

    it, concepts = _concepts(spark, sf_dir)
    s = it.crossJoin(F.broadcast(concepts)).select("id", "category", "role", "idx", dot("e", "c").alias("cos"))
    neg = F.col("role") == "negative"
    key = F.struct("cos", (-F.col("idx")).alias("o"))
    p = s.groupBy("id", "category").agg(
        F.max_by("idx", F.when(~neg, key)).alias("why"), F.max_by("idx", F.when(neg, key)).alias("nearest_benign"),
        (F.max(F.when(~neg, F.col("cos"))) - F.coalesce(F.max(F.when(neg, F.col("cos"))), F.lit(0.0))).alias("m"),
    )
    return p.select("id", "category", "why", "nearest_benign", F.round(cal.capped(op.margin_probability(F.col("m")), 3), 4).alias("p"))


@CORE.add(
    "cascade_persons",
    f"""WITH {CENTROIDS}, s AS (SELECT u.id, max(list_dot_product(u.e, c.c)) FILTER (idx = 0) AS m1, max(list_dot_product(u.e, c.c)) FILTER (idx = 1) AS m2 FROM u, c GROUP BY u.id),
    p AS (SELECT id, {SIG.format("8 * m1 - 0.5")} AS p1, least({SIG.format("8 * m1 - 0.5")}, {SIG.format("8 * m2 - 0.5")}) AS p2 FROM s), n AS (SELECT *, CASE WHEN p2 >= 0.4 THEN 2 WHEN p1 >= 0.4 THEN 1 ELSE 0 END AS n FROM p)
    SELECT id, round(p1, 4) AS p1, round(p2, 4) AS p2, greatest(n, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) AS n_persons, CASE greatest(n, CASE WHEN id % 7 = 0 THEN 1 ELSE 0 END) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS kind FROM n""",
)
def cascade_persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-stage cascade p2 <= p1, bucketed, at least the detected faces."""
    it, _ = _concepts(spark, sf_dir)
    from lumenfold.operators.search import score_tags

    s = score_tags(it, tag_vectors(it).where("idx < 2")).groupBy("id").agg(F.max(F.when(F.col("idx") == 0, F.col("cos"))).alias("m1"), F.max(F.when(F.col("idx") == 1, F.col("cos"))).alias("m2"))
    p1 = cal.sigmoid(8 * F.col("m1") - 0.5)
    p2 = F.least(p1, cal.sigmoid(8 * F.col("m2") - 0.5))
    n = F.greatest(F.when(p2 >= 0.4, 2).when(p1 >= 0.4, 1).otherwise(0), F.when(F.col("id") % 7 == 0, 1).otherwise(0))
    kind = F.when(n == 0, "none").when(n == 1, "one").otherwise("many")
    return s.select("id", F.round(p1, 4).alias("p1"), F.round(p2, 4).alias("p2"), n.alias("n_persons"), kind.alias("kind"))


@CORE.add(
    "softmax_labels",
    f"""WITH {CENTROIDS}, s AS (SELECT u.id, list(list_dot_product(u.e, c.c) * 10 ORDER BY idx) AS x FROM u, c GROUP BY u.id), e AS (SELECT id, list_transform(x, lambda v: exp(v - list_max(x))) AS y FROM s)
    SELECT id, (list_position(y, list_max(y)) - 1)::INT AS label, round(list_max(y) / list_sum(y), 6) AS p FROM e""",
)
def softmax_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax over all concepts, best label."""
    it, _ = _concepts(spark, sf_dir)
    from lumenfold.operators.search import score_tags

    s = score_tags(it, tag_vectors(it)).groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("idx", "cos"))), lambda v: v.cos * 10).alias("x"))
    y = s.select("id", cal.softmax(F.col("x")).alias("y"))
    return y.select("id", (F.array_position("y", F.array_max("y")) - 1).cast("int").alias("label"), F.round(F.array_max("y"), 6).alias("p"))


@CORE.add(
    "track_headers",
    f"WITH {CLEAN} SELECT category, count(*) AS n_rows, count(p) AS scored, count(DISTINCT model_id) AS models, array_to_string(list_sort(list(DISTINCT tier) FILTER (tier IS NOT NULL)), ' ') AS tiers FROM tr GROUP BY category",
)
def track_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers rebuilt from the stored rows (SNK8 SNK9 D6)."""
    return op.clean_tracks(table(spark, sf_dir, "tracks")).groupBy("category").agg(F.count("*").alias("n_rows"), F.count("p").alias("scored"), F.count_distinct("model_id").alias("models"), F.array_join(F.array_sort(F.collect_set("tier")), " ").alias("tiers"))


@CORE.add(
    "track_gap_fill",
    f"""WITH {CLEAN}, i AS (SELECT DISTINCT dataset, lower(trim(image_id)) AS image_id FROM images), c AS (SELECT DISTINCT category FROM tr WHERE category IS NOT NULL),
    m AS (SELECT dataset, image_id, category, max(p) AS p FROM tr GROUP BY ALL) SELECT i.dataset, c.category, count(*) AS n_rows, count(p) AS scored FROM i CROSS JOIN c LEFT JOIN m USING (dataset, image_id, category) GROUP BY ALL""",
)
def track_gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every track has as many rows as its data set; gaps are null (J1 SNK4 SNK5)."""
    i = table(spark, sf_dir, "images").select("dataset", F.lower(F.trim("image_id")).alias("image_id")).distinct()
    t = op.clean_tracks(table(spark, sf_dir, "tracks")).where("category IS NOT NULL")
    c = F.explode(F.array(*[F.lit(r[0]) for r in t.select("category").distinct().limit(1_000).collect()])).alias("category")  # the tracks: a few names
    m = t.groupBy("dataset", "image_id", "category").agg(F.max("p").alias("p"))
    return i.select("dataset", "image_id", c).join(m, ["dataset", "image_id", "category"], "left").groupBy("dataset", "category").agg(F.count("*").alias("n_rows"), F.count("p").alias("scored"))
