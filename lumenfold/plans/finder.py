"""Queries of the search by text, of the scorers, and of writes to stored tracks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import finder, lifecycle
from lumenfold.operators import scorers as sc
from lumenfold.operators.catalog import items, tag_vectors
from lumenfold.operators.search import bank_of
from lumenfold.operators.store import Table
from lumenfold.operators.tracks import clean_tracks
from lumenfold.plans.search import CENTROIDS, SIG
from lumenfold.plans.tracks import CLEAN
from lumenfold.registry import CORE
from lumenfold.session import scratch_path, table

# ten concepts, one a label of the items
NAMES = ["cat", "dog", "car", "boat", "tree", "house", "red car", "cup", "horse", "sky"]
EDGES = {"animal": ["cat", "dog", "horse"], "vehicle": ["car", "boat", "red car"], "thing": ["vehicle", "cup"]}
FITS = {"cat": (-12.0, 1.2, 0.5), "dog": (-10.0, 0.5, None), "car": (-14.0, 2.0, 0.6), "red car": (-9.0, 0.2, 0.55)}
QUERIES = {"dog": False, "dog car": False, 'my "red car" and boat': False, "animal cup": False, "cat dog": True, "sunset over the calm water": False, "horse": False}


class ItemEncoder:
    """Encodes a text as the vector of the item that its letters count up to: a query's vector lies in the items' space."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.dim, self.model_id = vectors, vectors.shape[1], "items"

    def embed_texts(self, texts: list[str]) -> np.ndarray:
        return np.array([self.vectors[number(t, len(self.vectors))] for t in texts])


def number(text: str, n: int) -> int:
    return sum(map(ord, text)) % n


ENCODED = 50


def _parts(spark: SparkSession, sf_dir: str):
    it = items(spark, sf_dir)
    _, bank = bank_of(tag_vectors(it).where(f"idx < {len(NAMES)}"), "idx")
    tags = finder.TagTable(NAMES, bank, FITS, {"dog": 0.62}, EDGES)
    own = it.where(F.col("id") < ENCODED).orderBy("id").select("e").collect()
    return it, tags, ItemEncoder(np.array([r[0] for r in own], np.float64))


def _sql(query: str, strict: bool, k: int = 20) -> str:
    """SQL of one search: candidates and concepts are looked up here, everything else is in the statement."""
    tags = finder.TagTable(NAMES, np.eye(len(NAMES)), FITS, {"dog": 0.62}, EDGES)
    a = finder.plan(tags, query)
    rows, groups = [], []
    for i, _ in a.cands:
        f = FITS.get(NAMES[i])
        eff = max(0.5 if f[2] is None else f[2], {"dog": 0.62}.get(NAMES[i], 0.0)) if f else 2.0
        rows.append(f"({i}, {f[0] if f else 'NULL'}, {f[1] if f else 'NULL'}, {eff}::DOUBLE, {eff if f else 1 / (1 + np.exp(-(60.0 * 0.9 - 17.6)))}::DOUBLE)")
    for g, (_, idx) in enumerate(a.groups):
        groups += [f"({g}, {i})" for i in idx]
    n = len(a.groups)
    cand = f"(SELECT * FROM (VALUES {', '.join(rows)}) AS v(idx, a, b, eff, bar))" if rows else "(SELECT 0 AS idx, NULL::DOUBLE AS a, NULL::DOUBLE AS b, 2.0 AS eff, 2.0 AS bar WHERE false)"
    group = f"(SELECT * FROM (VALUES {', '.join(groups)}) AS v(g, idx))" if groups else "(SELECT 0 AS g, 0 AS idx WHERE false)"
    text = f"(SELECT e AS qe FROM u WHERE id = {number(query, ENCODED)})"
    tcos = f"(SELECT u.id, list_dot_product(u.e, q.qe) AS tc FROM u, {text} q)" if a.use_text else "(SELECT id, NULL::DOUBLE AS tc FROM u)"
    lead = "mean_p" if n else "p"
    return f"""WITH {CENTROIDS}, cand AS {cand}, grp AS {group}, t AS {tcos},
    tt AS (SELECT id, tc, CASE WHEN tc IS NULL THEN 0.0 ELSE {SIG.format("60 * tc - 17.6")} END AS p_text FROM t),
    k0 AS (SELECT u.id, cand.*, list_dot_product(u.e, c.c) AS cos, CASE WHEN a IS NULL THEN {SIG.format("60 * list_dot_product(u.e, c.c) - 17.6")}
           ELSE 1 / (1 + exp(least(30, greatest(-30, a * list_dot_product(u.e, c.c) + b)))) END AS p0 FROM u, c JOIN cand USING (idx)),
    cap AS (SELECT id, max(p0) FILTER (a IS NOT NULL) AS pf FROM k0 GROUP BY id),
    k AS (SELECT k0.*, CASE WHEN a IS NOT NULL THEN p0 ELSE least(p0, greatest(coalesce(pf, 0), p_text)) END AS p FROM k0 JOIN cap USING (id) JOIN tt USING (id)),
    best AS (SELECT id, max(p) AS p_tag, arg_max(cos, (p, -idx)) AS tag_cos, max(cos) AS any_cos, bool_and(p >= eff) FILTER (a IS NOT NULL) AS every FROM k GROUP BY id),
    gg AS (SELECT id, g, max(p) AS gp, bool_or(p >= bar) AS gh FROM k JOIN grp USING (idx) GROUP BY id, g),
    mm AS (SELECT id, count(*) FILTER (gh) AS matched, coalesce(avg(gp) FILTER (gh), 0) AS mean_p FROM gg GROUP BY id),
    f AS (SELECT u.id, u.ds, {"CASE WHEN coalesce(every, true) THEN coalesce(p_tag, 0) ELSE 0 END" if strict else "coalesce(p_tag, 0)"} AS p_tag,
          {"CASE WHEN coalesce(every, true) THEN p_text ELSE 0 END" if strict else "p_text"} AS p_text, coalesce(tc, any_cos) AS row_cos, tag_cos, tc, coalesce(matched, 0) AS matched, coalesce(mean_p, 0) AS mean_p
          FROM u LEFT JOIN best USING (id) LEFT JOIN mm USING (id) JOIN tt USING (id)),
    h AS (SELECT *, greatest(p_tag, p_text) AS p, CASE WHEN p_tag > p_text THEN 'tag' ELSE 'text' END AS path, CASE WHEN p_tag > p_text THEN tag_cos ELSE coalesce(tc, 0) END AS score FROM f),
    w AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY matched DESC, {lead} DESC, id) AS r FROM h),
    o AS (SELECT * FROM w WHERE r <= {k} AND (row_cos >= 0.18 OR p_tag >= 0.5) ORDER BY matched DESC, mean_p DESC, round(p, 4) DESC, id LIMIT {k})
    SELECT id, ds, round(score, 6) AS score, round(p, 4) AS p, round(p_tag, 4) AS p_tag, round(p_text, 4) AS p_text, path, matched::INT AS matched, round(mean_p, 4) AS mean_p,
    {f"CASE WHEN matched = {n} THEN 'all' WHEN matched > 1 THEN 'some' ELSE 'any' END" if n else "NULL::VARCHAR"} AS spectrum FROM o"""


def _add(name: str, query: str, strict: bool) -> None:
    def find(spark: SparkSession, sf_dir: str) -> DataFrame:
        it, tags, encoder = _parts(spark, sf_dir)
        got = finder.search(it, tags, query, encoder, 20, strict)
        r = lambda c, n: F.round(c, n).alias(c)
        return got.select("id", "ds", r("score", 6), r("p", 4), r("p_tag", 4), r("p_text", 4), "path", "matched", r("mean_p", 4), "spectrum")

    find.__doc__ = f"Search for {query!r}: text in, ranked hits out (C1 C2-C8 F7-F10 J5 T1 T2)."
    CORE.add(name, _sql(query, strict))(find)


for _name, _query in zip(("find_tag", "find_terms", "find_quoted", "find_hypernym", "find_strict", "find_text", "find_uncalibrated"), QUERIES):
    _add(_name, _query, QUERIES[_query])


@CORE.add("find_nothing", "SELECT count(*) AS indexed, 'skipped' AS text_path, false AS gated, true AS no_match FROM embeddings")
def find_nothing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query that names no tag, with the text path off: honestly no match."""
    it, tags, encoder = _parts(spark, sf_dir)
    return finder.summary(it, tags, "sunset over the calm water", encoder, text="never").select("indexed", "text_path", "gated", "no_match")


@CORE.add("find_loaded_table", _sql("dog car", False))
def find_loaded_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search with a tag table that was saved and loaded for its model (SNK13 SRC9 SRC10)."""
    it, tags, encoder = _parts(spark, sf_dir)
    tags.model_sha = "m1"
    path = scratch_path(spark, "tags")
    tags.save(path, spark)
    got = finder.search(it, finder.TagTable.load(path, spark, "m1"), "dog car", encoder, 20)
    r = lambda c, n: F.round(c, n).alias(c)
    return got.select("id", "ds", r("score", 6), r("p", 4), r("p_tag", 4), r("p_text", 4), "path", "matched", r("mean_p", 4), "spectrum")


def _cos(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    return sc.item_cosines(it, bank_of(tag_vectors(it).where(f"idx < {len(NAMES)}"), "idx")[1])


COS = f"{CENTROIDS}, x AS (SELECT u.id, list(list_dot_product(u.e, c.c) ORDER BY c.idx) AS v FROM u, c WHERE c.idx < 10 GROUP BY u.id)"


def _max(*idx: int) -> str:
    return "greatest(" + ", ".join(f"v[{i + 1}]" for i in idx) + ")"


def _which(names: list[str], *idx: int) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"[{listed}][list_position([{', '.join(f'v[{i + 1}]' for i in idx)}], {_max(*idx)})]"


@CORE.add(
    "score_escalation",
    f"""WITH {COS}, p AS (SELECT id, {SIG.format(f"9 * ({_max(0, 1)} - {_max(2, 3)}) + 0.5")} AS p, {SIG.format(f"8 * ({_max(4, 5)} - {_max(6, 7)}) + 0.3")} AS pd FROM x)
    SELECT id, round(p, 4) AS p, round(pd, 4) AS p_danger, CASE WHEN p >= 0.6 AND pd >= 0.55 THEN 'alert' WHEN p >= 0.6 THEN 'review' ELSE 'none' END AS tier FROM p""",
)
def score_escalation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Person down, escalated by danger."""
    got = sc.escalation(_cos(spark, sf_dir), [0, 1], [2, 3], [4, 5], [6, 7], (sc.Fit(9.0, 0.5), sc.Fit(8.0, 0.3)), (0.6, 0.55))
    return got.select("id", F.round("p", 4).alias("p"), F.round("p_danger", 4).alias("p_danger"), "tier")


@CORE.add(
    "score_worst_of",
    f"""WITH {COS}, mm AS (SELECT id, {_max(0, 1)} - {_max(8, 9)} AS s, {_max(2, 3, 4)} - {_max(8, 9)} AS w, {_max(5, 6)} - {_max(8, 9)} AS c, {_which(["cut", "hit", "shot"], 2, 3, 4)} AS concept FROM x),
    p AS (SELECT *, {SIG.format("7 * greatest(s, w) - 0.4")} AS p FROM mm)
    SELECT id, round(p, 4) AS p, round(s, 6) AS margin_severe, round(w, 6) AS margin_violent, round(c, 6) AS margin_context, concept, CASE WHEN p >= 0.85 THEN 'alert' WHEN p >= 0.7 THEN 'violation' WHEN p >= 0.5 THEN 'review' ELSE 'none' END AS tier FROM p""",
)
def score_worst_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The worse of severe and violent margins in three bands, with the context margin beside."""
    got = sc.worst_of(_cos(spark, sf_dir), [0, 1], [2, 3, 4], [5, 6], [8, 9], ["cut", "hit", "shot"], sc.Fit(7.0, -0.4), (0.85, 0.7, 0.5))
    m = [F.round(c, 6).alias(c) for c in ("margin_severe", "margin_violent", "margin_context")]
    return got.select("id", F.round("p", 4).alias("p"), *m, "concept", "tier")


@CORE.add(
    "score_two_bank",
    f"""WITH {COS}, mm AS (SELECT id, {_max(0, 1)} - {_max(7, 8)} AS m, {_max(2, 3)} - {_max(7, 8)} AS mr, {_which(["pills", "powder"], 0, 1)} AS concept, {_which(["sweets", "flour"], 4, 5)} AS nearest_benign FROM x),
    p AS (SELECT *, least({SIG.format("10 * m")}, 41.0 / 42.0) AS p, least({SIG.format("10 * mr")}, 41.0 / 42.0) AS pr FROM mm)
    SELECT id, round(p, 4) AS p, round(pr, 4) AS p_review, CASE WHEN p >= 0.7 AND m >= mr + 0.05 THEN 'violation' WHEN pr >= 0.6 OR p >= 0.7 THEN 'review' ELSE 'none' END AS tier, concept, nearest_benign FROM p""",
)
def score_two_bank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two look-alike banks with arbitration, evidence cap and the nearest benign concept."""
    got = sc.two_bank(_cos(spark, sf_dir), [0, 1], [2, 3], [7, 8], ["pills", "powder"], sc.Fit(10.0, 0.0), (0.7, 0.6), 0.05, 40, [4, 5], ["sweets", "flour"])
    return got.select("id", F.round("p", 4).alias("p"), F.round("p_review", 4).alias("p_review"), "tier", "concept", "nearest_benign")


@CORE.add(
    "score_review_only",
    f"""WITH {COS}, mm AS (SELECT id, {_max(0, 1, 2)} - {_max(3, 4)} AS m, {_which(["bare", "bare", "partly"], 0, 1, 2)} AS subcategory FROM x)
    SELECT id, round({SIG.format("1.0 * m")}, 4) AS p, round(m, 6) AS margin, CASE WHEN m >= 0.05 THEN 'review' ELSE 'none' END AS tier, subcategory FROM mm""",
)
def score_review_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review queue by margin with its sub-category."""
    got = sc.review_only(_cos(spark, sf_dir), {"bare": [0, 1], "partly": [2]}, [3, 4], sc.Fit(1.0, 0.0), 0.05)
    return got.select("id", F.round("p", 4).alias("p"), F.round("margin", 6).alias("margin"), "tier", "subcategory")


@CORE.add(
    "track_fitted",
    f"""WITH {COS}, o AS (SELECT id, {_max(0, 1)} - {_max(7, 8)} AS m1, {_max(2, 3)} - {_max(7, 8)} AS m2 FROM x)
    SELECT id, CASE WHEN greatest(m1 - 0.12, m2 - 0.04) < 0 THEN 'none' WHEN m1 - 0.12 >= m2 - 0.04 THEN 'violation' ELSE 'review' END AS tier, CASE WHEN m1 - 0.12 >= m2 - 0.04 THEN 'violation' ELSE 'review' END AS picked,
    round(CASE WHEN m1 - 0.12 >= m2 - 0.04 THEN {SIG.format("11 * m1 - 0.2")} ELSE {SIG.format("11 * m2 - 0.2")} END, 4) AS p FROM o""",
)
def track_fitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fitted track: gated in margin space by the threshold exceeded most."""
    got = sc.fitted_track(_cos(spark, sf_dir), {"violation": [0, 1], "review": [2, 3]}, [7, 8], {"violation": 0.12, "review": 0.04}, sc.Fit(11.0, -0.2))
    return got.select("id", "tier", "picked", F.round("p", 4).alias("p"))


@CORE.add(
    "person_confidence",
    f"""WITH {COS}, p AS (SELECT id, {SIG.format("8 * v[1] - 0.5")} AS p1, least({SIG.format("8 * v[1] - 0.5")}, {SIG.format("8 * v[2] - 0.5")}) AS p2, id % 4 AS nf, {SIG.format("v[3]")} AS cf FROM x),
    n AS (SELECT *, greatest(nf, CASE WHEN p2 >= 0.4 THEN 2 WHEN p1 >= 0.4 THEN 1 ELSE 0 END) AS n FROM p)
    SELECT id, n::INT AS n_persons, round(CASE WHEN nf > 0 AND n = nf THEN greatest(cf, CASE WHEN n >= 1 THEN p1 ELSE 1 - p1 END) WHEN n = 0 THEN 1 - p1 WHEN n = 1 THEN greatest(p1 - p2, 0) ELSE p2 END, 4) AS confidence FROM n""",
)
def person_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidence of a person count by the evidence that decided it."""
    c = F.col("cos")
    from lumenfold.functions.calib import sigmoid

    p = _cos(spark, sf_dir).select("id", sigmoid(8 * c[0] - 0.5).alias("p1"), sigmoid(8 * c[1] - 0.5).alias("q"), (F.col("id") % 4).alias("nf"), sigmoid(c[2]).alias("cf")).withColumn("p2", F.least("p1", "q"))
    n = F.greatest("nf", F.when(F.col("p2") >= 0.4, 2).when(F.col("p1") >= 0.4, 1).otherwise(0)).cast("int")
    p = p.withColumn("n_persons", n)
    conf = sc.person_confidence(F.col("p1"), F.col("p2"), F.col("n_persons"), F.col("nf"), F.col("cf"))
    return p.select("id", "n_persons", F.round(conf, 4).alias("confidence"))


@CORE.add(
    "class_verdict",
    """WITH d AS (SELECT l_orderkey AS id, l_returnflag AS cls, max(l_discount) AS p FROM lineitem GROUP BY ALL), t AS (SELECT * FROM (VALUES ('A', 'violation', 2), ('R', 'review', 1)) AS v(cls, tier, sev)),
    j AS (SELECT d.*, coalesce(tier, 'none') AS tier, coalesce(sev, 0) AS sev FROM d LEFT JOIN t USING (cls))
    SELECT id, arg_max(tier, sev) AS tier, coalesce(string_agg(cls, ',' ORDER BY p DESC, cls) FILTER (sev > 0), '') AS subcategories FROM j GROUP BY id""",
)
def class_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highest tier over an item's detected classes, and the classes that reached one."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("cls"), F.col("l_discount").cast("double").alias("p"))
    tiers = spark.createDataFrame([("A", "violation", 2), ("R", "review", 1)], "cls string, tier string, severity int")
    return sc.verdict(d, tiers)


@CORE.add(
    "head_records",
    f"""WITH {COS}, p AS (SELECT id, {SIG.format("8 * v[1] - 0.5")} AS a, {SIG.format("8 * v[2] - 0.5")} AS b FROM x)
    SELECT id, 'raw' AS kind, NULL::DOUBLE AS p FROM p UNION ALL SELECT id, 'one', round(a, 4) FROM p WHERE a >= 0.6 UNION ALL SELECT id, 'many', round(b, 4) FROM p WHERE b >= 0.6""",
)
def head_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw record and a chip for each part that applies."""
    from lumenfold.functions.calib import sigmoid

    c = F.col("cos")
    a, b = sigmoid(8 * c[0] - 0.5), sigmoid(8 * c[1] - 0.5)
    return sc.records(_cos(spark, sf_dir), {"one": (a >= 0.6, a), "many": (b >= 0.6, b)}).select("id", "kind", F.round("p", 4).alias("p"))


@CORE.add(
    "column_swap",
    f"""WITH {CLEAN} SELECT category, count(*) AS n_rows, count(CASE WHEN category = 'weapons' THEN round(1 - p, 6) ELSE p END) AS scored, round(sum(CASE WHEN category = 'weapons' THEN round(1 - p, 6) ELSE p END), 3) AS total FROM tr WHERE category IS NOT NULL GROUP BY category""",
)
def column_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track's column rescored and swapped in a stored table; the other columns' files stay as they are (SNK10 SNK11 M20)."""
    t = clean_tracks(table(spark, sf_dir, "tracks")).where("category IS NOT NULL")
    store = lifecycle.TrackStore(Table(spark, scratch_path(spark, "tracks")))
    store.create(t)
    store.swap("weapons", store.column("weapons").withColumn("p", F.round(1 - F.col("p"), 6)))
    got = store.read()
    return got.groupBy("category").agg(F.count("*").alias("n_rows"), F.count("p").alias("scored"), F.round(F.sum("p"), 3).alias("total"))


@CORE.add(
    "recount_stored",
    f"""WITH {CLEAN} SELECT category, CASE WHEN p IS NULL THEN 'unknown' WHEN p >= 0.7 THEN 'violation' WHEN p >= 0.4 THEN 'review' ELSE 'none' END AS tier, count(*) AS n FROM tr WHERE category IS NOT NULL GROUP BY ALL""",
)
def recount_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts re-derived under the thresholds in force, written back with the table, and read from it (SNK8 SNK12 M20)."""
    t = clean_tracks(table(spark, sf_dir, "tracks")).where("category IS NOT NULL")
    store = lifecycle.TrackStore(Table(spark, scratch_path(spark, "tracks")))
    store.create(t)
    store.recount([("violation", 0.7), ("review", 0.4)])
    return store.counts()


@CORE.add(
    "dataset_lifecycle",
    "SELECT 'asia' AS dataset, 2 AS version, count(*) AS n FROM nation WHERE n_regionkey = 2 UNION ALL SELECT 'europe', 1, count(*) FROM nation WHERE n_regionkey = 3",
)
def dataset_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets created, renamed, reindexed and deleted, then listed with their rows (SNK14 SRC6 D18)."""
    n = table(spark, sf_dir, "nation")
    lib = lifecycle.Library(spark, scratch_path(spark, "library"))
    lib.create("east", n.where("n_regionkey = 1"))
    lib.create("europe", n.where("n_regionkey = 3"))
    lib.create("gone", n.where("n_regionkey = 0"))
    lib.rename("east", "asia")
    lib.reindex("asia", n.where("n_regionkey = 2"))
    lib.delete("gone", force=True)
    return lib.listing()


@CORE.add(
    "job_status_write",
    """WITH j AS (SELECT DISTINCT * FROM jobs WHERE job_id IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC NULLS LAST, done_n DESC NULLS LAST, coalesce(total_n, -1) DESC) AS r FROM j)
    SELECT job_id, max(done_n) FILTER (r = 1) AS done_n FROM r GROUP BY job_id""",
)
def job_status_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest status of every job upserted into a stored table, in two batches of snapshots (SNK15)."""
    j = table(spark, sf_dir, "jobs").where("job_id IS NOT NULL").dropDuplicates()
    status = lifecycle.JobStatus(Table(spark, scratch_path(spark, "jobs")))
    half = F.pmod(F.xxhash64("job_id", "updated_at"), F.lit(2))
    status.write(j.where(half == 0))
    status.write(j.where(half == 1))
    return status.read().select("job_id", "done_n")


@CORE.add(
    "packed_matrix",
    "SELECT vec_id AS id, len(embedding) AS n, true AS close FROM embeddings",
)
def packed_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed as half floats in base64 and unpacked again, equal to three digits (SNK17)."""
    it = items(spark, sf_dir).select("id", "e")
    got = lifecycle.unpack_half(lifecycle.pack_half(it, "e"), "e").withColumnRenamed("e", "h").join(it, "id")
    close = F.forall(F.zip_with("e", "h", lambda x, y: F.abs(x - y) <= 1e-3), lambda x: x)
    return got.select("id", F.size("h").cast("long").alias("n"), close.alias("close"))


@CORE.add(
    "aligned_truth",
    """WITH g AS (SELECT p_partkey AS num, p_brand AS label FROM part), r AS (SELECT rec_id, row_id, dataset, try_cast(regexp_extract(img_path, '([0-9]+)[.][^./]*$', 1) AS BIGINT) AS num FROM images)
    SELECT label, count(*) AS n, count(DISTINCT rec_id) AS recs FROM r JOIN g USING (num) GROUP BY label""",
)
def aligned_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ground truth joined to a snapshot's rows by the number in the file name."""
    g = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("num"), F.col("p_brand").alias("label"))
    r = table(spark, sf_dir, "images").select("rec_id", F.regexp_extract("img_path", r"([0-9]+)[.][^./]*$", 1).try_cast("bigint").alias("num"))
    return r.join(g, "num").groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("rec_id").alias("recs"))


@CORE.add(
    "visibility_counts",
    """SELECT l_orderkey AS image, count(*) FILTER (l_quantity >= 10) AS full_view, count(*) FILTER (l_quantity >= 10 AND l_discount > 0.02) AS face, count(*) FILTER (l_quantity < 10) AS hidden, count(*) AS persons FROM lineitem GROUP BY l_orderkey""",
)
def visibility_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts per picture under three visibility rules."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("image")).agg(
        F.count_if(q >= 10).alias("full_view"), F.count_if((q >= 10) & (d > 0.02)).alias("face"), F.count_if(q < 10).alias("hidden"), F.count("*").alias("persons")
    )


# Bands of a tag's provenance, and those whose threshold the data set may raise.
BANDS = {"coco80": "common-calibrated", "lvis-f": "frequent", "lvis-c": "common", "lvis-r": "rare", "openimages600": "open", "curated": "open"}
RAISED = ["common", "rare", "open"]


@CORE.add(
    "provenance_bands",
    "WITH p AS (SELECT * FROM (VALUES ('coco80'), ('lvis-f'), ('lvis-c-syn'), ('lvis-r'), ('openimages600'), ('other')) AS v(source)), "
    "b AS (SELECT source, CASE replace(source, '-syn', '') WHEN 'coco80' THEN 'common-calibrated' WHEN 'lvis-f' THEN 'frequent' WHEN 'lvis-c' THEN 'common' WHEN 'lvis-r' THEN 'rare' ELSE 'open' END AS band FROM p) "
    "SELECT source, band, band IN ('common', 'rare', 'open') AS may_raise FROM b",
)
def provenance_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequency band of a tag's provenance, and whether its threshold may be raised."""
    p = spark.createDataFrame([(s,) for s in ("coco80", "lvis-f", "lvis-c-syn", "lvis-r", "openimages600", "other")], "source string")
    known = F.create_map(*[F.lit(x) for kv in BANDS.items() for x in kv])
    b = p.withColumn("band", F.coalesce(known[F.replace("source", F.lit("-syn"), F.lit(""))], F.lit("open")))
    return b.withColumn("may_raise", F.col("band").isin(RAISED))
