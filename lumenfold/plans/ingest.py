"""Ingest, catalog, job and fitting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.functions.vector import l2_norm
from lumenfold.operators import fits, ingest, jobs, sampling
from lumenfold.operators.catalog import items
from lumenfold.plans.search import U
from lumenfold.registry import CORE
from lumenfold.session import table


def _images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "images").withColumnsRenamed({"img_path": "path", "size_bytes": "size"})


@CORE.add(
    "incremental_files",
    """WITH f AS (SELECT img_path AS path, mtime, size_bytes AS size, rec_id FROM images WHERE commit_id >= 4), k AS (SELECT DISTINCT img_path AS path, mtime, size_bytes AS size FROM images WHERE commit_id < 4)
    SELECT rec_id FROM f WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.path IS NOT DISTINCT FROM f.path AND k.mtime IS NOT DISTINCT FROM f.mtime AND k.size IS NOT DISTINCT FROM f.size)""",
)
def incremental_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that changed since the commits before."""
    i = _images(spark, sf_dir)
    return ingest.unchanged(i.where("commit_id >= 4").select("path", "mtime", "size", "rec_id"), i.where("commit_id < 4").select("path", "mtime", "size").distinct()).select("rec_id")


@CORE.add(
    "new_pictures",
    """WITH i AS (SELECT rec_id, commit_id, lower(trim(image_id)) AS image_id FROM images), b AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY commit_id, rec_id) AS r FROM i WHERE commit_id >= 3)
    SELECT rec_id, image_id FROM b WHERE r = 1 AND image_id NOT IN (SELECT image_id FROM i WHERE commit_id < 3)""",
)
def new_pictures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content ids not known before nor earlier in the run (J4 SNK1 W8 U1)."""
    i = table(spark, sf_dir, "images").select("rec_id", "commit_id", F.lower(F.trim("image_id")).alias("image_id"))
    return ingest.new_rows(i.where("commit_id >= 3"), i.where("commit_id < 3"), "image_id", [F.asc("commit_id"), F.asc("rec_id")]).select("rec_id", "image_id")


@CORE.add(
    "meta_join",
    """WITH i AS (SELECT rec_id, img_path AS path, regexp_extract(img_path, '[^/]+$') AS base FROM images WHERE dataset = 'city-archive'), p AS (SELECT img_path AS path, 'p' || min(rec_id) AS v FROM images WHERE rec_id % 3 = 0 GROUP BY 1),
    n AS (SELECT regexp_extract(img_path, '[^/]+$') AS base, arg_min('n' || rec_id, (img_path, rec_id)) AS v FROM images WHERE rec_id % 5 = 0 GROUP BY 1) SELECT rec_id, coalesce(p.v, n.v) AS tag, 'job' AS origin FROM i LEFT JOIN p USING (path) LEFT JOIN n USING (base)""",
)
def meta_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata laid over records: path before base name before job (J2 SRC7 Q11)."""
    i = _images(spark, sf_dir)
    one = lambda c: F.create_map(F.lit("tag"), c).alias("meta")
    by_path = i.where("rec_id % 3 = 0").groupBy("path").agg(F.min("rec_id").alias("r")).select("path", one(F.concat(F.lit("p"), "r")))
    named = i.where("rec_id % 5 = 0").groupBy("path").agg(F.min("rec_id").alias("r")).select("path", tx.base_name(F.col("path")).alias("base"), one(F.concat(F.lit("n"), "r")))
    job = spark.range(1).select(F.create_map(F.lit("origin"), F.lit("job")).alias("meta"))
    out = ingest.join_meta(i.where("dataset = 'city-archive'").select("rec_id", "path"), by_path, named, job)
    return out.select("rec_id", F.col("meta")["tag"].alias("tag"), F.col("meta")["origin"].alias("origin"))


@CORE.add(
    "row_numbers",
    """WITH b AS (SELECT dataset, rec_id, row_number() OVER (PARTITION BY dataset ORDER BY rec_id) AS i FROM images WHERE commit_id > 3), l AS (SELECT dataset, max(row_id) AS last_row FROM images WHERE commit_id <= 3 GROUP BY dataset)
    SELECT rec_id, coalesce(last_row, -1) + i AS row FROM b LEFT JOIN l USING (dataset)""",
)
def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of appended rows."""
    i = table(spark, sf_dir, "images")
    last = i.where("commit_id <= 3").groupBy("dataset").agg(F.max("row_id").alias("last_row"))
    return ingest.number_rows(i.where("commit_id > 3").select("dataset", "rec_id"), last, "dataset", [F.asc("rec_id")]).select("rec_id", "row")


@CORE.add("image_page", "SELECT rec_id, row_id, img_path FROM images WHERE dataset = 'city-archive' ORDER BY row_id, rec_id LIMIT 50 OFFSET 25")
def image_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of a listing (SRC20 P8)."""
    i = table(spark, sf_dir, "images").where("dataset = 'city-archive'").select("rec_id", "row_id", "img_path")
    return ingest.page(i, ["row_id", "rec_id"], 25, 50)


@CORE.add(
    "dataset_catalog",
    """WITH i AS (SELECT dataset, count(*) AS n_images, sum(size_bytes) AS bytes, max(commit_id) AS commit_id, min(img_path) AS a, max(img_path) AS b FROM images GROUP BY dataset), j AS (SELECT dataset, job_state, total_n, done_n, row_number() OVER (PARTITION BY dataset ORDER BY started_at DESC, updated_at DESC, done_n DESC, job_id DESC) AS r FROM jobs)
    SELECT i.dataset, n_images, bytes::BIGINT AS bytes, commit_id, job_state, greatest(coalesce(total_n, 0), n_images) AS total FROM i LEFT JOIN j ON i.dataset = j.dataset AND r = 1""",
)
def dataset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets with counts, bytes and their latest job (SRC5 SRC6 J12 A13 W7 C30)."""
    i = table(spark, sf_dir, "images").groupBy("dataset").agg(F.count("*").alias("n_images"), F.sum("size_bytes").alias("bytes"), F.max("commit_id").alias("commit_id"))
    j = jobs.latest(table(spark, sf_dir, "jobs")).select("dataset", "job_state", "total_n")
    return i.join(j, "dataset", "left").select("dataset", "n_images", "bytes", "commit_id", "job_state", F.greatest(F.coalesce("total_n", F.lit(0)), F.col("n_images")).alias("total"))


@CORE.add(
    "common_root",
    """WITH g AS (SELECT dataset, string_split(min(img_path), '/') AS a, string_split(max(img_path), '/') AS b FROM images GROUP BY dataset), n AS (SELECT dataset, a, coalesce(list_max(list_filter(range(1, least(len(a), len(b))), lambda i: a[1:i] = b[1:i])), 0) AS k FROM g)
    SELECT dataset, array_to_string(a[1:k], '/') AS root FROM n""",
)
def common_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common parent folder of each data set."""
    return ingest.common_parent(table(spark, sf_dir, "images"), "img_path", ["dataset"])


@CORE.add("path_parts", "SELECT rec_id, regexp_extract(img_path, '[^/]+$') AS base, try_cast(regexp_extract(img_path, '([^/]+)\\.[^./]*$', 1) AS BIGINT) AS number, lower(regexp_extract(img_path, '[^.]+$')) AS suffix FROM images WHERE lower(regexp_extract(img_path, '[^.]+$')) IN ('jpg', 'jpeg', 'png', 'webp')")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base name, file number and suffix, suffixes from an allow-list (SRC1 P12)."""
    suffix = F.lower(F.regexp_extract("img_path", r"[^.]+$", 0))
    return table(spark, sf_dir, "images").where(suffix.isin("jpg", "jpeg", "png", "webp")).select("rec_id", tx.base_name(F.col("img_path")).alias("base"), tx.path_number(F.col("img_path")).alias("number"), suffix.alias("suffix"))


@CORE.add(
    "current_records",
    "WITH r AS (SELECT rec_id, dataset, img_path, row_number() OVER (PARTITION BY dataset, img_path ORDER BY commit_id DESC, rec_id DESC) AS r FROM images) SELECT rec_id, r = 1 AS is_current FROM r",
)
def current_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append-only table with the latest row of each path marked (Q14)."""
    w = Window.partitionBy("dataset", "img_path").orderBy(F.desc("commit_id"), F.desc("rec_id"))
    return table(spark, sf_dir, "images").select("rec_id", (F.row_number().over(w) == 1).alias("is_current"))


@CORE.add(
    "exists_tombstone",
    "WITH l AS (SELECT DISTINCT img_path FROM images WHERE commit_id <= 4) SELECT rec_id, l.img_path IS NOT NULL AS present FROM images LEFT JOIN l USING (img_path)",
)
def exists_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a record's file stands in a listing."""
    i = table(spark, sf_dir, "images")
    listing = i.where("commit_id <= 4").select("img_path").distinct().withColumn("present", F.lit(True))
    return i.join(listing, "img_path", "left").select("rec_id", F.coalesce("present", F.lit(False)).alias("present"))


@CORE.add(
    "verify_integrity",
    """WITH v AS (SELECT dataset, sqrt(list_sum(list_transform(emb, lambda x: x::DOUBLE * x::DOUBLE))) AS norm, len(emb) AS d, isnan(list_sum(list_transform(emb, lambda x: x::DOUBLE))) AS bad FROM images)
    SELECT dataset, count(*) AS n, count(*) FILTER (d IS DISTINCT FROM 64) AS short, count(*) FILTER (bad) AS n_nan, round(avg(norm) FILTER (NOT bad AND d = 64), 4) AS mean_norm, coalesce(avg(norm) FILTER (NOT bad AND d = 64) BETWEEN 0.99 AND 1.01, false) AS sound FROM v GROUP BY dataset""",
)
def verify_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row counts, short vectors and mean norm of every data set (A15 D4 SNK14)."""
    v = table(spark, sf_dir, "images").select("dataset", l2_norm("emb").alias("norm"), F.size("emb").alias("d"), F.coalesce(F.exists("emb", lambda x: F.isnan(x)), F.lit(False)).alias("bad"), F.col("emb").isNull().alias("none"))
    good = F.when(~F.col("bad") & (F.col("d") == 64), F.col("norm"))
    g = v.groupBy("dataset").agg(F.count("*").alias("n"), F.count_if(F.col("none") | (F.col("d") != 64)).alias("short"), F.count_if("bad").alias("n_nan"), F.avg(good).alias("m"))
    return g.select("dataset", "n", "short", "n_nan", F.round("m", 4).alias("mean_norm"), F.coalesce(F.col("m").between(0.99, 1.01), F.lit(False)).alias("sound"))


@CORE.add("normalised_vectors", "WITH v AS (SELECT rec_id, list_transform(emb, lambda x: x::DOUBLE) AS e FROM images WHERE emb IS NOT NULL AND len(emb) = 64 AND NOT isnan(list_sum(list_transform(emb, lambda x: x::DOUBLE)))) SELECT rec_id, round(e[1] / greatest(sqrt(list_dot_product(e, e)), 1e-12), 6) AS e1, round(list_sum(list_transform(e, lambda x: x / greatest(sqrt(list_dot_product(e, e)), 1e-12))), 4) AS s FROM v")
def normalised_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors; a zero vector stays zero."""
    from lumenfold.functions.vector import l2_normalise

    i = table(spark, sf_dir, "images").where("emb IS NOT NULL AND size(emb) = 64 AND NOT exists(emb, x -> isnan(x))")
    u = i.select("rec_id", l2_normalise("emb").alias("u"))
    return u.select("rec_id", F.round(F.col("u")[0], 6).alias("e1"), F.round(F.aggregate("u", F.lit(0.0), lambda s, x: s + x), 4).alias("s"))


@CORE.add("snapshot_counts", "SELECT c.v AS version, count(*) AS n, count(DISTINCT dataset) AS datasets FROM images, (VALUES (1), (3), (5)) AS c(v) WHERE commit_id <= c.v GROUP BY c.v")
def snapshot_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consistent prefixes: a snapshot reads the rows up to its commit (D8 SRC3 ST3)."""
    v = F.explode(F.array(F.lit(1), F.lit(3), F.lit(5))).alias("version")
    return table(spark, sf_dir, "images").select("commit_id", "dataset", v).where("commit_id <= version").groupBy("version").agg(F.count("*").alias("n"), F.count_distinct("dataset").alias("datasets"))


@CORE.add("commit_log", "SELECT commit_id, count(*) AS n_rows, count(DISTINCT dataset) AS datasets, sum(size_bytes)::BIGINT AS bytes, sum(count(*)) OVER (ORDER BY commit_id)::BIGINT AS total FROM images GROUP BY commit_id")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roll-up of every commit with running totals (D7 SNK18). One row a commit stands in the window."""
    c = table(spark, sf_dir, "images").groupBy("commit_id").agg(F.count("*").alias("n_rows"), F.count_distinct("dataset").alias("datasets"), F.sum("size_bytes").alias("bytes"))
    return c.withColumn("total", F.sum("n_rows").over(Window.partitionBy(F.lit(0)).orderBy("commit_id")))


@CORE.add(
    "cache_sweep",
    "WITH f AS (SELECT DISTINCT ON (img_path) img_path, size_bytes, mtime FROM images WHERE dataset = 'city-archive' AND mtime IS NOT NULL ORDER BY img_path, mtime DESC, size_bytes DESC), r AS (SELECT img_path, sum(size_bytes) OVER (ORDER BY mtime DESC, img_path) AS run FROM f) SELECT img_path, run <= 200000000 AS kept FROM r",
)
def cache_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least recently used entries beyond a byte cap go (SNK16)."""
    f = table(spark, sf_dir, "images").where("dataset = 'city-archive' AND mtime IS NOT NULL").groupBy("img_path").agg(F.max(F.struct("mtime", "size_bytes")).alias("m"))
    run = F.sum("m.size_bytes").over(Window.partitionBy(F.lit(0)).orderBy(F.desc("m.mtime"), "img_path"))
    return f.select("img_path", (run <= 200000000).alias("kept"))


JOBS = "cur AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY updated_at DESC, done_n DESC, total_n DESC NULLS LAST, job_state) AS r FROM jobs) WHERE r = 1)"


@CORE.add("job_current", f"WITH {JOBS} SELECT job_id, dataset, job_state, total_n, done_n, failed_n FROM cur")
def job_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last snapshot of every job (D13 SNK15 SRC15)."""
    return jobs.current(table(spark, sf_dir, "jobs")).select("job_id", "dataset", "job_state", "total_n", "done_n", "failed_n")


@CORE.add("job_list", f"WITH {JOBS} SELECT job_id, job_state, epoch(updated_at)::BIGINT AS updated_s FROM cur ORDER BY updated_at DESC, job_id LIMIT 50")
def job_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest fifty jobs (SRC14)."""
    return jobs.current(table(spark, sf_dir, "jobs")).orderBy(F.desc("updated_at"), "job_id").limit(50).select("job_id", "job_state", F.unix_timestamp("updated_at").alias("updated_s"))


@CORE.add(
    "job_corpses",
    f"WITH {JOBS} SELECT job_id, (job_state = 'running' AND pid IS NULL) OR (job_state = 'queued' AND epoch(TIMESTAMPTZ '2025-02-15 00:00:00+00') - epoch(updated_at) > 45) AS corpse FROM cur",
)
def job_corpses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that only claim to live (P14 ST6)."""
    return jobs.current(table(spark, sf_dir, "jobs")).select("job_id", jobs.is_corpse("2025-02-15 00:00:00").alias("corpse"))


@CORE.add(
    "job_coverage",
    f"WITH {JOBS} SELECT sum(CASE WHEN job_state IN ('running', 'queued') THEN greatest(0, coalesce(total_n, 0) - coalesce(done_n, 0)) ELSE 0 END)::BIGINT AS coming, sum(coalesce(done_n, 0))::BIGINT AS done, count(*) FILTER (job_state IN ('running', 'queued')) AS live FROM cur",
)
def job_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows expected from live jobs."""
    return jobs.expected_total(jobs.current(table(spark, sf_dir, "jobs")))


@CORE.add("job_unmirrored", f"WITH {JOBS} SELECT job_id FROM cur WHERE job_id NOT IN (SELECT engine_job_id FROM cur WHERE engine_job_id IS NOT NULL)")
def job_unmirrored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that are not another job's engine."""
    j = jobs.current(table(spark, sf_dir, "jobs"))
    return j.join(j.where("engine_job_id IS NOT NULL").select(F.col("engine_job_id").alias("job_id")), "job_id", "left_anti").select("job_id")


@CORE.add(
    "job_changes",
    "WITH d AS (SELECT DISTINCT job_id, updated_at, job_state, done_n FROM jobs), l AS (SELECT *, row_number() OVER w AS r, lag(job_state) OVER w AS was FROM d WINDOW w AS (PARTITION BY job_id ORDER BY updated_at, done_n, job_state)) SELECT job_id, epoch(updated_at)::BIGINT AS updated_s, job_state FROM l WHERE r = 1 OR job_state IS DISTINCT FROM was",
)
def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the records at which a job's state changed (ST4)."""
    d = table(spark, sf_dir, "jobs").select("job_id", "updated_at", "job_state", "done_n").distinct()
    return jobs.changes(d, "job_id", ["updated_at", "done_n", "job_state"], "job_state").select("job_id", F.unix_timestamp("updated_at").alias("updated_s"), "job_state")


@CORE.add(
    "rolling_rate",
    "SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total FROM (SELECT event_id, user_id, value, epoch(date_trunc('second', ts))::BIGINT AS s FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW)",
)
def rolling_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sliding count and sum over the last day of each key (W5 ST5)."""
    return jobs.rolling(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value"), "user_id", "ts", "value", 86400).select("event_id", "n", F.round("total", 4).alias("total"))


@CORE.add(
    "failure_records",
    "WITH f AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS r, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value < 20) SELECT event_type, max(n) AS failed, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) FILTER (r <= 200) AS sample FROM f GROUP BY event_type",
)
def failure_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures: an exact count, and the first 200 of each kind (ST8). The cut comes before rows are gathered."""
    f = table(spark, sf_dir, "events").where("value < 20").select("event_type", "event_id")
    n = f.groupBy("event_type").agg(F.count("*").alias("failed"))
    top = f.withColumn("r", F.row_number().over(Window.partitionBy("event_type").orderBy("event_id"))).where("r <= 200")
    return n.join(top.groupBy("event_type").agg(F.sort_array(F.collect_list("event_id")).alias("sample")), "event_type").select("event_type", "failed", F.array_join(F.col("sample").cast("array<string>"), " ").alias("sample"))


@CORE.add(
    "json_fields",
    "SELECT event_type, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || (json_keys(props))[1])) AS kinds, any_value(len(json_keys(props)))::INT AS n_keys FROM events WHERE props IS NOT NULL GROUP BY event_type",
)
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields out of JSON records."""
    keys = F.json_object_keys("props")
    e = table(spark, sf_dir, "events").where("props IS NOT NULL").select("event_type", keys.alias("k"), F.from_json("props", "map<string,string>").alias("m"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct(F.element_at("m", F.col("k")[0])).alias("kinds"), F.max(F.size("k")).alias("n_keys"))


@CORE.add("digests", "SELECT item_id, left(sha256(item_text), 16) AS sha, md5(item_text) AS md, strftime(TIMESTAMP '2025-01-01 00:00:00' + INTERVAL 1 DAY * item_id, '%Y-%m-%dT%H:%M:%SZ') AS at FROM eval_items")
def digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content digests and ISO timestamps."""
    at = F.date_format(F.lit("2025-01-01").cast("timestamp") + F.make_interval(days=F.col("item_id").cast("int")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf_dir, "eval_items").select("item_id", F.substring(F.sha2("item_text", 256), 1, 16).alias("sha"), F.md5("item_text").alias("md"), at.alias("at"))


@CORE.add(
    "capped_sample",
    "WITH r AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY md5('7:' || vec_id), vec_id) AS r FROM embeddings) SELECT id, label FROM r WHERE r <= 12",
)
def capped_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped draw of every class."""
    return sampling.cap_per_class(items(spark, sf_dir), ["label"], "id", 12, 7).select("id", "label")


@CORE.add("hash_split", "SELECT vec_id AS id, CASE WHEN ('0x' || left(md5('3:' || vec_id), 8))::BIGINT < floor(0.6 * 4294967296) THEN 'train' ELSE 'test' END AS part FROM embeddings")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A split that stays as the table grows."""
    return sampling.split(items(spark, sf_dir), "id", 0.6, 3).select("id", "part")


@CORE.add(
    "tiered_negatives",
    f"WITH {U} SELECT id, tier FROM (SELECT id, CASE label % 5 WHEN 0 THEN 'hard' WHEN 1 THEN 'verified' ELSE 'random' END AS tier FROM u WHERE label <> 3) ORDER BY CASE tier WHEN 'hard' THEN 1 WHEN 'verified' THEN 2 ELSE 3 END, md5('5:' || id), id LIMIT 250",
)
def tiered_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quota filled tier by tier."""
    k = F.col("label") % 5
    it = items(spark, sf_dir).where("label <> 3").select("id", F.when(k == 0, "hard").when(k == 1, "verified").otherwise("random").alias("tier"))
    return sampling.tiered(it, ["hard", "verified", "random"], 250, "id", 5)


@CORE.add("absent_concepts", "WITH n AS (SELECT n_name, row_number() OVER (ORDER BY n_name) - 1 AS r, count(*) OVER () AS k FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_nationkey < 10)) SELECT n_name FROM n WHERE r % greatest(1, k // 5) = 0 ORDER BY n_name LIMIT 5")
def absent_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts without a single row, evenly spaced (SRC17 M3)."""
    s = table(spark, sf_dir, "supplier").where("s_nationkey < 10").select(F.col("s_nationkey").alias("n_nationkey"))
    n = table(spark, sf_dir, "nation").join(s, "n_nationkey", "left_anti").select("n_name")
    return sampling.stride(n, [F.asc("n_name")], 5)


@CORE.add(
    "label_precedence",
    "WITH s AS (SELECT user_id, 0 AS src, max(event_type) AS label FROM events WHERE value > 90 GROUP BY user_id UNION ALL SELECT user_id, 1, min(event_type) FROM events GROUP BY user_id) SELECT user_id, arg_min(label, src) AS label, arg_min(src, src)::INT AS src FROM s GROUP BY user_id",
)
def label_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label sources in order of precedence."""
    e = table(spark, sf_dir, "events")
    a = e.where("value > 90").groupBy("user_id").agg(F.max("event_type").alias("label")).withColumn("src", F.lit(0))
    b = e.groupBy("user_id").agg(F.min("event_type").alias("label")).withColumn("src", F.lit(1))
    return a.unionByName(b).groupBy("user_id").agg(F.min_by("label", "src").alias("label"), F.min("src").alias("src"))


@CORE.add(
    "class_sets",
    "SELECT o_custkey AS id, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')), ',') AS positive, array_to_string(list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus <> 'F')), ',') AS negative FROM orders GROUP BY o_custkey",
)
def class_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive and negative class sets per record (SRC22 SRC16)."""
    f = F.col("o_orderstatus") == "F"
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.array_sort(F.collect_set(F.when(f, F.col("o_orderpriority")))).alias("a"), F.array_sort(F.collect_set(F.when(~f, F.col("o_orderpriority")))).alias("b"))
    some = lambda c: F.when(F.size(c) > 0, F.array_join(c, ","))
    return g.select("id", some("a").alias("positive"), some("b").alias("negative"))


@CORE.add("stage_means", "SELECT event_type, count(*) AS n, round(sum(value) / greatest(1, count(DISTINCT user_id)), 4) AS per_user FROM events GROUP BY event_type")
def stage_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per distinct unit."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value") / F.greatest(F.lit(1), F.count_distinct("user_id")), 4).alias("per_user"))


def _fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenfold.operators.catalog import tag_vectors
    from lumenfold.operators.search import score_tags

    it = items(spark, sf_dir)
    s = score_tags(it, tag_vectors(it)).join(it.select("id", "label"), "id")
    return s.select(F.col("idx").alias("tag"), F.col("cos").alias("s"), (F.col("label") == F.col("idx")).cast("int").alias("y"))


@CORE.add("platt_fit")
def platt_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Platt pairs of every concept (A20 A40 X7); checked against a direct optimisation in the tests."""
    return fits.fit_platt(_fit_rows(spark, sf_dir), "tag")


@CORE.add("bootstrap_ci")
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Average precision with bootstrap interval."""
    return fits.bootstrap_ap(_fit_rows(spark, sf_dir), "tag")


@CORE.add("logistic_fit")
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A linear head per data set."""
    it = items(spark, sf_dir)
    return fits.fit_logistic(it.select("ds", "e", (F.col("label") < 5).cast("int").alias("y")), "ds")


@CORE.add("box_suppression")
def box_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy suppression of overlapping boxes."""
    k = F.col("l_orderkey")
    d = table(spark, sf_dir, "lineitem").select(
        k.alias("image"), "l_linenumber", (F.col("l_quantity") % 20).cast("double").alias("x1"), (F.col("l_quantity") % 7).cast("double").alias("y1"), (F.col("l_quantity") % 20 + 10).cast("double").alias("x2"),
        (F.col("l_quantity") % 7 + 10).cast("double").alias("y2"), F.col("l_discount").cast("double").alias("p"),
    )
    return fits.nms(d, ["image"])
