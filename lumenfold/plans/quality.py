"""Evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import calib as cal
from lumenfold.functions.vector import dot
from lumenfold.operators import quality as op
from lumenfold.operators.catalog import items, tag_vectors
from lumenfold.operators.search import score_tags
from lumenfold.plans.search import CENTROIDS, SIG, U
from lumenfold.registry import CORE
from lumenfold.session import small, table

SCORED = f"""{CENTROIDS}, sc AS (SELECT u.id, c.idx AS tag, {SIG.format("10 * list_dot_product(u.e, c.c) - 3")} AS p, (u.label = c.idx)::INT AS y FROM u, c)"""
CURVE = f"""{SCORED}, cv AS (SELECT *, row_number() OVER w AS rn, sum(y) OVER w AS tp, count(*) OVER (PARTITION BY tag) AS n, sum(y) OVER (PARTITION BY tag) AS pos FROM sc
    WINDOW w AS (PARTITION BY tag ORDER BY p DESC, id ROWS UNBOUNDED PRECEDING))"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    s = score_tags(it, tag_vectors(it)).join(it.select("id", "label"), "id")
    return s.select("id", F.col("idx").alias("tag"), cal.sigmoid(10 * F.col("cos") - 3).alias("p"), (F.col("label") == F.col("idx")).cast("int").alias("y"))


def _curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op.running(_scored(spark, sf_dir), ["tag"])


def _r(c: str, name: str | None = None, n: int = 6):
    return F.round(c, n).alias(name or c)


@CORE.add("avg_precision", f"WITH {CURVE} SELECT tag, round(sum(y * tp / rn) / sum(y), 6) AS ap, max(n) AS n, max(pos)::BIGINT AS pos FROM cv GROUP BY tag")
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision per concept."""
    return op.average_precision(_curve(spark, sf_dir), ["tag"]).select("tag", _r("ap"), "n", "pos")


@CORE.add(
    "auroc",
    f"""WITH {SCORED}, d AS (SELECT tag, p, sum(y) AS a, count(*) - sum(y) AS b FROM sc GROUP BY tag, p), r AS (SELECT *, coalesce(sum(b) OVER (PARTITION BY tag ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d)
    SELECT tag, round(sum(a * (below + 0.5 * b)) / (sum(a) * sum(b)), 6) AS auroc FROM r GROUP BY tag""",
)
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUROC with ties counted half."""
    return op.auroc(_scored(spark, sf_dir), ["tag"]).select("tag", _r("auroc"))


@CORE.add(
    "max_f1",
    f"WITH {CURVE}, f AS (SELECT tag, p, 2 * tp / (rn + pos) AS f1, rn FROM cv), o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY f1 DESC, rn) AS k FROM f) SELECT tag, round(p, 6) AS tau, round(f1, 6) AS f1 FROM o WHERE k = 1",
)
def max_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of highest F1."""
    return op.max_f1(_curve(spark, sf_dir), ["tag"]).select("tag", _r("tau"), _r("f1"))


@CORE.add(
    "tau_precision",
    f"WITH {CURVE} SELECT tag, round(coalesce(arg_max(p, rn) FILTER (tp / rn >= 0.6), max(p)), 6) AS tau, round(coalesce(max(tp / pos) FILTER (tp / rn >= 0.6), 0), 6) AS recall FROM cv GROUP BY tag",
)
def tau_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold for a target precision and the recall there."""
    return op.tau_for_precision(_curve(spark, sf_dir), ["tag"], 0.6).select("tag", _r("tau"), _r("recall"))


@CORE.add(
    "tau_recall",
    f"WITH {SCORED}, s AS (SELECT tag, list_sort(list(p)) AS a FROM sc WHERE y = 1 GROUP BY tag) SELECT tag, round(a[(floor(round(0.1 * len(a), 9)) + 1)::INT], 6) AS tau, len(a) AS pos FROM s",
)
def tau_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold that keeps nine tenths of the positives."""
    return op.tau_for_recall(_scored(spark, sf_dir), ["tag"], 0.9).select("tag", _r("tau"), "pos")


@CORE.add(
    "recall_at_fpr",
    f"WITH {SCORED}, t AS (SELECT tag, quantile_cont(p, 0.98) AS t FROM sc WHERE y = 0 GROUP BY tag) SELECT tag, round(t, 6) AS tau, round(avg((p >= t)::INT), 6) AS recall FROM sc JOIN t USING (tag) WHERE y = 1 GROUP BY tag, t",
)
def recall_at_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall at two per cent false positives, the quantile interpolated."""
    s = _scored(spark, sf_dir)
    t = s.where("y = 0").groupBy("tag").agg(F.expr("percentile(p, 0.98)").alias("t"))
    j = s.where("y = 1").join(small(t), "tag").groupBy("tag", "t").agg(F.avg((F.col("p") >= F.col("t")).cast("int")).alias("recall"))
    return j.select("tag", F.round("t", 6).alias("tau"), _r("recall"))


@CORE.add(
    "ece_brier",
    f"""WITH {SCORED}, b AS (SELECT tag, least(floor(p * 10), 9) AS b, count(*) AS k, avg(p) AS c, avg(y) AS a FROM sc GROUP BY 1, 2), e AS (SELECT tag, sum(k * abs(c - a)) / sum(k) AS ece FROM b GROUP BY tag),
    r AS (SELECT tag, avg((p - y) ** 2) AS brier FROM sc GROUP BY tag) SELECT tag, round(ece, 6) AS ece, round(brier, 6) AS brier FROM e JOIN r USING (tag)""",
)
def ece_brier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibration error and Brier score."""
    s = _scored(spark, sf_dir)
    brier = s.groupBy("tag").agg(F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"))
    return op.ece(s, ["tag"]).join(brier, "tag").select("tag", _r("ece"), _r("brier"))


@CORE.add(
    "prf_at_tau",
    f"""WITH {SCORED}, cc AS (SELECT tag, count(*) FILTER (p >= 0.2 AND y = 1) AS tp, count(*) FILTER (p >= 0.2) AS h, sum(y) AS pos, count(*) FILTER ((p >= 0.2) = (y = 1)) AS ok, count(*) AS n FROM sc GROUP BY tag)
    SELECT tag, round(tp / greatest(h, 1), 6) AS precision, round(tp / greatest(pos, 1), 6) AS recall, round(2 * tp / greatest(h + pos, 1), 6) AS f1, round(h / n, 6) AS flagged, round(ok / n, 6) AS accuracy FROM cc""",
)
def prf_at_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, F1, flag rate and accuracy at a threshold."""
    return op.prf(_scored(spark, sf_dir), ["tag"], 0.2).select("tag", *[_r(c) for c in ("precision", "recall", "f1", "flagged", "accuracy")])


@CORE.add(
    "wilson_bounds",
    f"""WITH {SCORED}, cc AS (SELECT tag, count(*) FILTER (p >= 0.3)::DOUBLE AS k, count(*)::DOUBLE AS n FROM sc WHERE y = 0 GROUP BY tag)
    SELECT tag, k::BIGINT AS k, n::BIGINT AS n, round((k / n + 1.96 * 1.96 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS lo,
    round((k / n + 1.96 * 1.96 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 1.96 * 1.96 / (4 * n * n))) / (1 + 1.96 * 1.96 / n), 6) AS hi FROM cc""",
)
def wilson_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False positives with their Wilson interval."""
    c = _scored(spark, sf_dir).where("y = 0").groupBy("tag").agg(F.count_if(F.col("p") >= 0.3).alias("k"), F.count("*").alias("n"))
    lo, hi = cal.wilson(F.col("k"), F.col("n"))
    return c.select("tag", "k", "n", F.round(lo, 6).alias("lo"), F.round(hi, 6).alias("hi"))


@CORE.add(
    "prevalence_projection",
    f"""WITH {SCORED}, cc AS (SELECT tag, avg((p >= 0.3)::INT) FILTER (y = 1) AS tpr, avg((p >= 0.3)::INT) FILTER (y = 0) AS fpr FROM sc GROUP BY tag), v AS (SELECT * FROM (VALUES (0.001::DOUBLE), (0.01), (0.1)) AS t(prevalence))
    SELECT tag, prevalence, round(tpr * prevalence / greatest(tpr * prevalence + fpr * (1 - prevalence), 1e-12), 6) AS precision FROM cc, v""",
)
def prevalence_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision projected to other prevalences."""
    c = _scored(spark, sf_dir).groupBy("tag").agg(F.avg(F.when(F.col("y") == 1, (F.col("p") >= 0.3).cast("int"))).alias("tpr"), F.avg(F.when(F.col("y") == 0, (F.col("p") >= 0.3).cast("int"))).alias("fpr"))
    v = F.explode(F.array(F.lit(0.001), F.lit(0.01), F.lit(0.1))).alias("prevalence")
    hit = F.col("tpr") * F.col("prevalence")
    return c.select("*", v).select("tag", "prevalence", F.round(hit / F.greatest(hit + F.col("fpr") * (1 - F.col("prevalence")), F.lit(1e-12)), 6).alias("precision"))


CLEANP = "SELECT DISTINCT track_id, dataset, image_id, lower(trim(category)) AS category, lower(trim(tier)) AS tier, p FROM tracks WHERE p IS NOT NULL AND NOT isnan(p) AND p BETWEEN 0 AND 1"


def _p(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.operators.tracks import clean_tracks

    return clean_tracks(table(spark, sf_dir, "tracks")).where("p IS NOT NULL")


QS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 0.999, 1.0]


@CORE.add(
    "score_distribution",
    f"WITH t AS ({CLEANP}) SELECT category, {', '.join(f'round(quantile_cont(p, {q}), 6) AS q{i}' for i, q in enumerate(QS))}, round(avg(p), 6) AS mean, round(avg((p < 0.02)::INT), 6) AS low_share FROM t GROUP BY category",
)
def score_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles, mean and saturation of stored scores."""
    arr = ", ".join(map(str, QS))
    g = _p(spark, sf_dir).groupBy("category").agg(F.expr(f"percentile(p, array({arr}))").alias("q"), F.avg("p").alias("mean"), F.avg((F.col("p") < 0.02).cast("int")).alias("low_share"))
    return g.select("category", *[F.round(F.col("q")[i], 6).alias(f"q{i}") for i in range(len(QS))], _r("mean"), _r("low_share"))


@CORE.add(
    "score_histogram",
    f"WITH t AS ({CLEANP}) SELECT category, (CASE WHEN p < 0.05 THEN 0 WHEN p < 0.2 THEN 1 WHEN p < 0.5 THEN 2 WHEN p < 0.9 THEN 3 ELSE 4 END) AS bin, count(*) AS n FROM t GROUP BY 1, 2",
)
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts between explicit edges."""
    return op.histogram(_p(spark, sf_dir), "p", [0.0, 0.05, 0.2, 0.5, 0.9, 1.0], ["category"])


@CORE.add(
    "tau_sweep",
    f"""WITH t AS ({CLEANP}), v AS (SELECT * FROM (VALUES (0.2::DOUBLE), (0.4), (0.6), (0.8)) AS x(tau)) SELECT category, tau, round(avg((p >= tau)::INT), 6) AS share FROM t, v GROUP BY ALL""",
)
def tau_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flag rate per threshold and slice, every category a slice; one pass, the thresholds are columns until the end."""
    taus = (0.2, 0.4, 0.6, 0.8)
    rates = _p(spark, sf_dir).groupBy("category").agg(*[F.avg((F.col("p") >= t).cast("int")).alias(f"t{i}") for i, t in enumerate(taus)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("tau"), F.round(f"t{i}", 6).alias("share")) for i, t in enumerate(taus)])).alias("s")
    return rates.select("category", each).select("category", "s.tau", "s.share")


@CORE.add(
    "subcategory_medians",
    f"WITH t AS ({CLEANP}) SELECT category, tier, round(median(p), 6) AS median, count(*) AS n, count(*) FILTER (p >= 0.5) AS n_high FROM t WHERE tier IS NOT NULL GROUP BY category, tier HAVING count(*) >= 5",
)
def subcategory_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians and counts of sub-categories with at least five rows."""
    g = _p(spark, sf_dir).where("tier IS NOT NULL").groupBy("category", "tier").agg(F.expr("percentile(p, 0.5)").alias("median"), F.count("*").alias("n"), F.count_if(F.col("p") >= 0.5).alias("n_high"))
    return g.where("n >= 5").select("category", "tier", _r("median"), "n", "n_high")


@CORE.add(
    "best_tau_quantiles",
    f"""WITH {SCORED}, q AS (SELECT tag, unnest(quantile_cont(p, {[round(i / 100, 2) for i in range(1, 100)]})) AS tau FROM sc GROUP BY tag), d AS (SELECT DISTINCT tag, tau FROM q),
    f AS (SELECT d.tag, tau, 2 * count(*) FILTER (p >= tau AND y = 1) / greatest(count(*) FILTER (p >= tau) + sum(y), 1) AS f1 FROM d JOIN sc USING (tag) GROUP BY d.tag, tau)
    SELECT tag, round(max(f1), 6) AS f1 FROM f GROUP BY tag""",
)
def best_tau_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best F1 over 99 quantile thresholds."""
    s = _scored(spark, sf_dir)
    arr = ", ".join(str(round(i / 100, 2)) for i in range(1, 100))
    taus = s.groupBy("tag").agg(F.array_distinct(F.expr(f"percentile(p, array({arr}))")).alias("taus"))
    j = s.join(small(taus), "tag").select("tag", "p", "y", F.explode("taus").alias("tau"))
    c = j.groupBy("tag", "tau").agg(F.count_if((F.col("p") >= F.col("tau")) & (F.col("y") == 1)).alias("tp"), F.count_if(F.col("p") >= F.col("tau")).alias("h"), F.sum("y").alias("pos"))
    return c.groupBy("tag").agg(F.round(F.max(2 * F.col("tp") / F.greatest(F.col("h") + F.col("pos"), F.lit(1))), 6).alias("f1"))


RANKED = f"""{CENTROIDS}, s AS (SELECT c.idx AS q, u.id, u.label, list_dot_product(u.e, c.c) AS s FROM u, c), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, id) AS rn FROM s)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    return score_tags(it, tag_vectors(it)).join(it.select("id", "label"), "id").select(F.col("idx").alias("q"), "id", "label", F.col("cos").alias("s"))


@CORE.add(
    "precision_at_k",
    f"""WITH {RANKED}, n AS (SELECT label AS q, count(*) AS n_pos FROM u GROUP BY label), p AS (SELECT r.q, avg((label = r.q)::INT) AS p FROM r JOIN n USING (q) WHERE rn <= least(10, n_pos) GROUP BY r.q)
    SELECT q, round(p, 6) AS p_at_k, p >= 0.5 AS pass FROM p""",
)
def precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision at min(10, positives) per concept."""
    s = _ranked(spark, sf_dir)
    n = items(spark, sf_dir).groupBy(F.col("label").alias("q")).agg(F.count("*").alias("n_pos"))
    top = s.withColumn("rn", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("s"), "id"))).where("rn <= 10")
    p = top.join(small(n), "q").where("rn <= least(10, n_pos)").groupBy("q").agg(F.avg((F.col("label") == F.col("q")).cast("int")).alias("p"))
    return p.select("q", F.round("p", 6).alias("p_at_k"), (F.col("p") >= 0.5).alias("pass"))


@CORE.add(
    "hypernym_recall",
    f"""WITH {U}, m AS (SELECT label % 3 AS sup, i, avg(e[i]) AS m FROM u, range(1, 65) t(i) GROUP BY 1, 2), l AS (SELECT sup, list(m ORDER BY i) AS m FROM m GROUP BY sup), c AS (SELECT sup, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS c FROM l),
    s AS (SELECT sup, id, label, row_number() OVER (PARTITION BY sup ORDER BY list_dot_product(e, c) DESC, id) AS rn FROM u, c), n AS (SELECT label % 3 AS sup, count(*) AS r FROM u GROUP BY 1)
    SELECT s.sup, label AS child, count(*) FILTER (rn <= 100 AND label % 3 = s.sup) / 100.0::DOUBLE AS p_part, round(count(*) FILTER (rn <= r) / count(*), 6) AS recall FROM s JOIN n USING (sup) WHERE label % 3 = s.sup GROUP BY s.sup, label""",
)
def hypernym_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Super-concepts: each child's share of precision@100 and its recall within the first R."""
    from lumenfold.operators.catalog import mean_vectors

    it = items(spark, sf_dir)
    c = mean_vectors(it, ["ds"]).withColumnRenamed("ds", "sup")
    s = it.crossJoin(F.broadcast(c)).select("sup", "id", "label", dot("e", "c").alias("s"))
    s = s.withColumn("rn", F.row_number().over(Window.partitionBy("sup").orderBy(F.desc("s"), "id")))
    n = it.groupBy(F.col("ds").alias("sup")).agg(F.count("*").alias("r"))
    own = s.join(small(n), "sup").where(F.col("label") % 3 == F.col("sup"))
    return own.groupBy("sup", F.col("label").alias("child")).agg((F.count_if(F.col("rn") <= 100) / 100).alias("p_part"), F.round(F.count_if(F.col("rn") <= F.col("r")) / F.count("*"), 6).alias("recall"))


@CORE.add(
    "retrieval_rank",
    f"""WITH {U}, q AS (SELECT a.id AS q, b.id AS target, a.e AS qe, list_dot_product(a.e, b.e) AS own FROM u a JOIN u b ON b.id = a.id + 1 WHERE a.id % 20 = 0),
    r AS (SELECT q.q, count(*) FILTER (u.id <> target AND list_dot_product(u.e, qe) > own + 1e-12) AS rank FROM u, q GROUP BY q.q)
    SELECT count(*) AS queries, round(100 * avg((rank < 1)::INT), 4) AS r1, round(100 * avg((rank < 5)::INT), 4) AS r5, round(100 * avg((rank < 10)::INT), 4) AS r10, round(100 * avg((rank < 100)::INT), 4) AS r100, median(rank)::DOUBLE AS median_rank FROM r""",
)
def retrieval_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval of one target per query among all records: recall at 1, 5, 10 and 100 and median rank; every record whose id is
    divisible by 20 is a query, the next record its target (A18)."""
    it = items(spark, sf_dir).select("id", "e")
    q = it.where("id % 20 = 0").select(F.col("id").alias("q"), (F.col("id") + 1).alias("target"), F.col("e").alias("qe"))
    r = op.ranks_over(it, q)
    share = [F.round(100 * F.avg((F.col("rank") < k).cast("int")), 4).alias(f"r{k}") for k in (1, 5, 10, 100)]
    return r.agg(F.count("*").alias("queries"), *share, F.expr("percentile(rank, 0.5)").alias("median_rank"))


@CORE.add(
    "negative_leakage",
    f"""WITH {RANKED}, k AS (SELECT q, rn, s, sum((label = q)::INT) OVER (PARTITION BY q ORDER BY rn) AS tp FROM r WHERE rn <= 10), h AS (SELECT q, max(tp) AS hits FROM k GROUP BY q),
    t AS (SELECT k.q, max(s) FILTER (tp >= 0.7 * hits) AS tau FROM k JOIN h USING (q) GROUP BY k.q) SELECT t.q, round(tau, 6) AS tau, count(*) FILTER (s.s >= tau AND label <> t.q) AS leaked FROM t JOIN s ON s.q = t.q GROUP BY t.q, tau""",
)
def negative_leakage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest threshold that keeps seven tenths of the top-ten recall, and what else clears it."""
    s = _ranked(spark, sf_dir)
    w = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    top = s.withColumn("rn", F.row_number().over(w)).where("rn <= 10").withColumn("tp", F.sum((F.col("label") == F.col("q")).cast("int")).over(Window.partitionBy("q").orderBy("rn")))
    hits = top.withColumn("hits", F.max("tp").over(Window.partitionBy("q")))
    t = hits.groupBy("q").agg(F.max(F.when(F.col("tp") >= 0.7 * F.col("hits"), F.col("s"))).alias("tau"))
    j = s.join(small(t), "q").groupBy("q", "tau").agg(F.count_if((F.col("s") >= F.col("tau")) & (F.col("label") != F.col("q"))).alias("leaked"))
    return j.select("q", _r("tau"), "leaked")


@CORE.add(
    "fidelity_nn",
    f"""WITH {U}, v AS (SELECT id, e, list_transform(e, lambda x: round(x * 8) / 8) AS f FROM u), n AS (SELECT id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e, list_transform(f, lambda x: x / sqrt(list_dot_product(f, f))) AS f FROM v),
    s AS (SELECT a.id, b.id AS o, round(list_dot_product(a.e, b.e), 12) AS x, round(list_dot_product(a.f, b.f), 12) AS y FROM n a JOIN n b ON a.id <> b.id AND a.id % 20 = 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY x DESC, o) AS rx, row_number() OVER (PARTITION BY id ORDER BY y DESC, o) AS ry FROM s),
    t AS (SELECT id, list(o) FILTER (rx <= 3) AS a, list(o) FILTER (ry <= 3) AS b, max(o) FILTER (rx = 1) = max(o) FILTER (ry = 1) AS agree FROM r GROUP BY id),
    c AS (SELECT avg(list_dot_product(e, f)) AS m, min(list_dot_product(e, f)) AS l, quantile_cont(list_dot_product(e, f), 0.01) AS p1 FROM n),
    g AS (SELECT avg(agree::INT) AS nn, avg(len(list_intersect(a, b)) / 3) AS top3, count(*) AS n FROM t)
    SELECT round(m, 6) AS mean_cos, round(l, 6) AS min_cos, round(p1, 6) AS p1_cos, round(nn, 6) AS nn_agree, round(top3, 6) AS top3_overlap, n, CASE WHEN m < 0.95 OR nn < 0.6 THEN 'banned' WHEN nn >= 0.9 THEN 'default' ELSE 'optin' END AS verdict FROM c, g""",
)
def fidelity_nn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A coarse copy of the vectors against the true ones: mean, least and first-percentile cosine over all records, and the
    agreement of neighbours among all records, of every record whose id is divisible by 20, with the verdict (A42 F40 J10 U5 M6)."""
    from lumenfold.functions.vector import l2_normalise

    it = items(spark, sf_dir).select("id", "e", F.transform("e", lambda x: F.round(x * 8) / 8).alias("f"))
    it = it.select("id", l2_normalise("e").alias("e"), l2_normalise("f").alias("f"))
    q = it.where("id % 20 = 0")
    x, y = op.top_neighbours(it, q, "e", 3), op.top_neighbours(it, q, "f", 3)
    pick = lambda d, c: d.groupBy("q").agg(F.collect_list("id").alias(c), F.max(F.when(F.col("rank") == 1, F.col("id"))).alias(f"{c}1"))
    t = pick(x, "a").join(pick(y, "b"), "q")
    g = t.agg(F.avg((F.col("a1") == F.col("b1")).cast("int")).alias("nn"), F.avg(F.size(F.array_intersect("a", "b")) / 3).alias("top3"), F.count("*").alias("n"))
    cos = dot("e", "f")
    c = it.agg(F.avg(cos).alias("m"), F.min(cos).alias("l"), F.expr("percentile(aggregate(zip_with(e, f, (x, y) -> x * y), 0D, (s, v) -> s + v), 0.01)").alias("p1"))
    verdict = F.when((F.col("m") < 0.95) | (F.col("nn") < 0.6), "banned").when(F.col("nn") >= 0.9, "default").otherwise("optin")
    return c.crossJoin(F.broadcast(g)).select(_r("m", "mean_cos"), _r("l", "min_cos"), _r("p1", "p1_cos"), _r("nn", "nn_agree"), _r("top3", "top3_overlap"), "n", verdict.alias("verdict"))  # one row each



@CORE.add(
    "tag_statistics",
    f"""WITH {CENTROIDS}, s AS (SELECT c.idx, list_dot_product(u.e, c.c) AS v FROM u, c) SELECT idx, count(*) AS n, round(sum(v), 4) AS s1, round(sum(v * v), 4) AS s2, round(quantile_cont(v, 0.99), 6) AS p99, round(avg(v) + 3 * stddev_pop(v), 6) AS raised FROM s GROUP BY idx""",
)
def tag_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus statistics of every concept, for raised thresholds."""
    s = _ranked(spark, sf_dir).groupBy(F.col("q").alias("idx"))
    return s.agg(F.count("*").alias("n"), F.round(F.sum("s"), 4).alias("s1"), F.round(F.sum(F.col("s") * F.col("s")), 4).alias("s2"), F.round(F.expr("percentile(s, 0.99)"), 6).alias("p99"), F.round(F.avg("s") + 3 * F.stddev_pop("s"), 6).alias("raised"))


@CORE.add(
    "latency_percentiles",
    """WITH e AS (SELECT event_type, list_sort(list(value)) AS a FROM events WHERE value IS NOT NULL GROUP BY event_type), i AS (SELECT event_type, a, len(a) AS n FROM e)
    SELECT event_type, n, round(a[least(n - 1, floor(n * 0.5))::INT + 1], 6) AS p50, round(a[least(n - 1, floor(n * 0.95))::INT + 1], 6) AS p95, round(a[least(n - 1, floor(n * 0.99))::INT + 1], 6) AS p99 FROM i""",
)
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles by index, not interpolated: the row of that rank (A41). Ranks come from a window per type over bins of value."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "value")
    per = e.groupBy("event_type", "value").agg(F.count("*").alias("k"))  # ties collapse before the window
    w = Window.partitionBy("event_type")
    run = per.withColumn("upto", F.sum("k").over(w.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))).withColumn("n", F.sum("k").over(w))
    at = lambda q: F.round(F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("value"))), 6)
    return run.groupBy("event_type").agg(F.max("n").alias("n"), at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"))


@CORE.add(
    "perf_median_row",
    """WITH d AS (SELECT event_type, date_trunc('day', ts) AS d, count(*)::DOUBLE AS v FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY v, d) AS rn, count(*) OVER (PARTITION BY event_type) AS n, max(v) OVER (PARTITION BY event_type) AS hi, min(v) OVER (PARTITION BY event_type) AS lo FROM d)
    SELECT event_type, v AS median_row, round(100 * (hi - lo) / v, 4) AS spread_pct, CASE WHEN (hi - lo) / v > 0.2 THEN 'ADVISORY' ELSE 'OK' END AS status FROM r WHERE rn = n // 2 + 1""",
)
def perf_median_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median run, spread and status of repeated measurements."""
    d = table(spark, sf_dir, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("d")).agg(F.count("*").cast("double").alias("v"))
    w = Window.partitionBy("event_type")
    r = d.withColumn("rn", F.row_number().over(w.orderBy("v", "d"))).withColumn("n", F.count("*").over(w)).withColumn("hi", F.max("v").over(w)).withColumn("lo", F.min("v").over(w))
    m = r.where("rn = floor(n / 2) + 1")
    spread = (F.col("hi") - F.col("lo")) / F.col("v")
    return m.select("event_type", F.col("v").alias("median_row"), F.round(100 * spread, 4).alias("spread_pct"), F.when(spread > 0.2, "ADVISORY").otherwise("OK").alias("status"))


@CORE.add(
    "caption_votes",
    r"""WITH v AS (SELECT title_id, count(*) FILTER (regexp_matches(lower(text), '\b(knife|broken|stolen)\b')) AS votes, count(*) FILTER (regexp_matches(lower(text), '\b(wedding|party)\b')) AS benign, count(*) AS n FROM documents WHERE title_id IS NOT NULL GROUP BY title_id)
    SELECT title_id, n, CASE WHEN votes >= 2 THEN 'positive' WHEN votes >= 1 THEN 'excluded' WHEN benign >= 1 THEN 'benign' ELSE 'other' END AS label FROM v""",
)
def caption_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by votes of texts: two make a positive, one only excludes."""
    t = F.lower("text")
    v = table(spark, sf_dir, "documents").where("title_id IS NOT NULL").groupBy("title_id").agg(F.count_if(t.rlike(r"\b(knife|broken|stolen)\b")).alias("votes"), F.count_if(t.rlike(r"\b(wedding|party)\b")).alias("benign"), F.count("*").alias("n"))
    label = F.when(F.col("votes") >= 2, "positive").when(F.col("votes") >= 1, "excluded").when(F.col("benign") >= 1, "benign").otherwise("other")
    return v.select("title_id", "n", label.alias("label"))


@CORE.add(
    "slices_setops",
    f"""WITH t AS ({CLEANP}), a AS (SELECT image_id FROM t WHERE category = 'violence' AND p >= 0.5), b AS (SELECT image_id FROM t WHERE category = 'weapons' AND p >= 0.5), s AS (SELECT image_id FROM t WHERE category = 'sports' AND p >= 0.5)
    SELECT 'both' AS slice, count(*) AS n FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT 'only_violence', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b EXCEPT SELECT * FROM s) UNION ALL SELECT 'any', count(*) FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM s)""",
)
def slices_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices by set operations on pictures."""
    t = _p(spark, sf_dir).where("p >= 0.5")
    a, b, s = (t.where(F.col("category") == c).select("image_id") for c in ("violence", "weapons", "sports"))
    n = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("slice"), "n")
    return n("both", a.intersect(b)).union(n("only_violence", a.subtract(b).subtract(s))).union(n("any", a.union(b).union(s).distinct()))


@CORE.add(
    "leaderboard",
    f"""WITH {CURVE}, a AS (SELECT tag, sum(y * tp / rn) / sum(y) AS ap, max(pos) AS pos FROM cv GROUP BY tag) SELECT tag, pos >= 40 AS eligible, round(ap, 6) AS ap, row_number() OVER (ORDER BY (pos >= 40) DESC, round(ap, 9) DESC, tag)::INT AS place FROM a""",
)
def leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates, eligible ones first, then by quality (T10 C29). One row a candidate stands in the window."""
    a = op.average_precision(_curve(spark, sf_dir), ["tag"]).withColumn("eligible", F.col("pos") >= 40)
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("eligible"), F.desc(F.round("ap", 9)), "tag")
    return a.select("tag", "eligible", _r("ap"), F.row_number().over(w).alias("place"))


@CORE.add(
    "tau_grid",
    f"""WITH {SCORED}, v AS (SELECT round(0.3 + i / 100, 2) AS tau FROM range(0, 69) t(i)), a AS (SELECT tag, tau, avg(((p >= tau) = (y = 1))::INT) AS acc FROM sc, v GROUP BY tag, tau), o AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY round(acc, 9) DESC, tau) AS k FROM a)
    SELECT tag, tau, round(acc, 6) AS acc FROM o WHERE k = 1""",
)
def tau_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold of best accuracy on a fixed grid, the lowest on ties (C24). The grid is applied map-side."""
    grid = F.explode(F.array(*[F.lit(round(0.3 + i / 100, 2)) for i in range(69)])).alias("tau")
    a = _scored(spark, sf_dir).select("tag", "p", "y", grid).groupBy("tag", "tau").agg(F.avg(((F.col("p") >= F.col("tau")) == (F.col("y") == 1)).cast("int")).alias("acc"))
    best = a.groupBy("tag").agg(F.max(F.struct(F.round("acc", 9).alias("acc"), (-F.col("tau")).alias("t"))).alias("b"))
    return best.select("tag", (-F.col("b.t")).alias("tau"), F.round("b.acc", 6).alias("acc"))


@CORE.add(
    "prompt_ab",
    f"""WITH {CENTROIDS}, s AS (SELECT u.id, (u.label = 0)::INT AS y, c.idx, list_dot_product(u.e, c.c) AS v FROM u, c WHERE c.idx < 5), b AS (SELECT id, v AS base FROM s WHERE idx = 0),
    x AS (SELECT s.idx AS cand, y, (greatest(base, v) + 1) / 2 AS p FROM s JOIN b USING (id)), d AS (SELECT cand, p, sum(y) AS a, count(*) - sum(y) AS n FROM x GROUP BY cand, p),
    r AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY cand ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM d), q AS (SELECT cand, sum(a * (below + 0.5 * n)) / (sum(a) * sum(n)) AS auroc FROM r GROUP BY cand),
    f AS (SELECT cand, quantile_cont(p, 0.99) AS p99 FROM x WHERE y = 0 GROUP BY cand), z AS (SELECT auroc AS a0, p99 AS f0 FROM q JOIN f USING (cand) WHERE cand = 0)
    SELECT cand, round(auroc - a0, 6) AS d_auroc, round(p99 - f0, 6) AS d_fp99, auroc - a0 >= -0.0005 AND p99 - f0 <= 0.001 AS promote FROM q JOIN f USING (cand), z WHERE cand > 0""",
)
def prompt_ab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each candidate concept added to the bank alone: change of AUROC and of the negatives' 99th percentile."""
    it = items(spark, sf_dir)
    s = score_tags(it, tag_vectors(it).where("idx < 5")).join(it.select("id", "label"), "id")
    wide = s.groupBy("id", "label").agg(F.max(F.when(F.col("idx") == 0, F.col("cos"))).alias("base"), F.collect_list(F.struct("idx", "cos")).alias("c"))
    x = wide.select((F.col("label") == 0).cast("int").alias("y"), "base", F.explode("c").alias("c")).select(F.col("c.idx").alias("cand"), "y", ((F.greatest("base", "c.cos") + 1) / 2).alias("p"))
    f = x.where("y = 0").groupBy("cand").agg(F.expr("percentile(p, 0.99)").alias("p99"))
    j = op.auroc(x, ["cand"]).join(f, "cand")
    z = j.where("cand = 0").select(F.col("auroc").alias("a0"), F.col("p99").alias("f0"))
    d = j.where("cand > 0").crossJoin(F.broadcast(z)).withColumn("da", F.col("auroc") - F.col("a0")).withColumn("df", F.col("p99") - F.col("f0"))
    return d.select("cand", F.round("da", 6).alias("d_auroc"), F.round("df", 6).alias("d_fp99"), ((F.col("da") >= -0.0005) & (F.col("df") <= 0.001)).alias("promote"))


@CORE.add("pose_angles", f"WITH {U} SELECT id, round(degrees(atan2(abs(e[2]), abs(e[1]))), 4) AS angle, degrees(atan2(abs(e[2]), abs(e[1]))) < 35 AS lying FROM u WHERE e[1] <> 0 OR e[2] <> 0")
def pose_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Angle of a vector to the horizontal."""
    it = items(spark, sf_dir).where(F.expr("e[0] <> 0 OR e[1] <> 0"))
    a = F.degrees(F.atan2(F.abs(F.col("e")[1]), F.abs(F.col("e")[0])))
    return it.select("id", F.round(a, 4).alias("angle"), (a < 35).alias("lying"))
