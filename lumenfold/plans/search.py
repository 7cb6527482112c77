"""Search queries: dense, tag fusion, coverage, several data sets, honest answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.functions.calib import text_p, z_p
from lumenfold.functions.vector import dot, products
from lumenfold.operators import search as op
from lumenfold.operators.catalog import items, tag_vectors
from lumenfold.registry import CORE
from lumenfold.session import table

U = "u AS (SELECT vec_id AS id, label, label % 3 AS ds, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"
CENTROIDS = f"""{U}, m AS (SELECT label, i, avg(e[i]) AS m FROM u, range(1, 65) t(i) GROUP BY label, i),
l AS (SELECT label AS idx, list(m ORDER BY i) AS m FROM m GROUP BY label),
c AS (SELECT idx, list_transform(m, lambda x: x / greatest(sqrt(list_dot_product(m, m)), 1e-12)) AS c FROM l)"""
Q = "q AS (SELECT e AS qe FROM u WHERE id = 0)"
TEXT = "t AS (SELECT id, ds, list_dot_product(e, qe) AS cos FROM u, q)"
SIG = "1 / (1 + exp(-({})))"
# tags 0 and 1 are calibrated, tag 2 is not
FITS = "f AS (SELECT * FROM (VALUES (0, -12.0, 1.2, 0.5), (1, -10.0, 0.5, NULL), (2, NULL, NULL, NULL)) AS v(idx, a, b, tau))"
TAGGED = f"""g AS (SELECT u.id, u.ds, c.idx, list_dot_product(u.e, c.c) AS cos FROM u, c WHERE c.idx < 3),
k AS (SELECT g.*, a IS NOT NULL AS fitted, CASE WHEN a IS NOT NULL THEN 1 / (1 + exp(least(30, greatest(-30, a * cos + b)))) ELSE {SIG.format("60 * cos - 17.6")} END AS p,
      CASE WHEN a IS NOT NULL THEN coalesce(tau, 0.5) ELSE 2.0 END AS eff FROM g JOIN f USING (idx))"""
FUSED = f"""b AS (SELECT id, ds, max(p) FILTER (fitted) AS p_fit, max(p) FILTER (NOT fitted) AS p_raw, bool_or(fitted AND p >= eff) AS present FROM k GROUP BY id, ds),
x AS (SELECT b.*, t.cos, {SIG.format("60 * t.cos - 17.6")} AS p_text FROM b JOIN t USING (id, ds)),
y AS (SELECT *, greatest(coalesce(p_fit, 0), least(coalesce(p_raw, 0), greatest(coalesce(p_fit, 0), p_text))) AS p_tag FROM x),
z AS (SELECT *, greatest(p_tag, p_text) AS p, CASE WHEN p_tag > p_text THEN 'tag' ELSE 'text' END AS path FROM y)"""


def _fits(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, -12.0, 1.2, 0.5, None), (1, -10.0, 0.5, None, None), (2, None, None, None, None)], "idx int, a double, b double, tau double, raised double")


def _text(it: DataFrame) -> DataFrame:
    q = np.array(it.where("id = 0").select("e").first()[0], np.float64)  # one query vector
    return products(it, ["id", "ds"], "e", q[None, :]).select("id", "ds", F.col("cos")[0].alias("cos")).withColumn("p_text", text_p(F.col("cos")))


def _tagged(spark: SparkSession, it: DataFrame) -> DataFrame:
    return op.calibrate(op.score_tags(it, tag_vectors(it).where("idx < 3")), _fits(spark))


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    return op.fuse(_tagged(spark, it), _text(it))


@CORE.add(
    "search_dense",
    f"""WITH {U}, {Q}, {TEXT}, z AS (SELECT *, (cos - avg(cos) OVER ()) / greatest(stddev_pop(cos) OVER (), 1e-6) AS zz FROM t)
    SELECT id, round(cos, 6) AS score, round({SIG.format("60 * cos - 17.6")}, 4) AS p, round(zz, 3) AS z FROM z WHERE cos >= 0.18 ORDER BY cos DESC, id LIMIT 20""",
)
def search_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense search: cosine to one query vector, logistic, corpus z-score, keep mask, top 20."""
    s = _text(items(spark, sf_dir))
    top = op.corpus_z(s, "cos", []).where(op.keep(F.col("cos"))).orderBy(F.desc("cos"), "id").limit(20)
    return top.select("id", F.round("cos", 6).alias("score"), F.round("p_text", 4).alias("p"), F.round("z", 3).alias("z"))


@CORE.add(
    "search_cut_first",
    f"""WITH {U}, {Q}, {TEXT}, k AS (SELECT * FROM t ORDER BY cos DESC, id LIMIT 60) SELECT id, round(cos, 6) AS score FROM k WHERE cos >= 0.18""",
)
def search_cut_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference order: the cut to k comes before the keep mask, so fewer than k rows may come out."""
    return _text(items(spark, sf_dir)).orderBy(F.desc("cos"), "id").limit(60).where(op.keep(F.col("cos"))).select("id", F.round("cos", 6).alias("score"))


@CORE.add(
    "search_z_path",
    f"""WITH {U}, {Q}, {TEXT}, z AS (SELECT *, (cos - avg(cos) OVER (PARTITION BY ds)) / greatest(stddev_pop(cos) OVER (PARTITION BY ds), 1e-6) AS zz FROM t)
    SELECT id, ds, round(zz, 3) AS z, round({SIG.format("1.6 * zz - 4")}, 4) AS p FROM z WHERE zz >= 1""",
)
def search_z_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus-relative path: z-score within each data set, then the z logistic."""
    z = op.corpus_z(_text(items(spark, sf_dir)), "cos", ["ds"])
    return z.where("z >= 1").select("id", "ds", F.round("z", 3).alias("z"), F.round(z_p(F.col("z")), 4).alias("p"))


@CORE.add(
    "search_tag_fusion",
    f"WITH {CENTROIDS}, {Q}, {TEXT}, {FITS}, {TAGGED}, {FUSED} SELECT id, ds, round(p_tag, 4) AS p_tag, round(p_text, 4) AS p_text, round(p, 4) AS p, path, present FROM z",
)
def search_tag_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag path and text path fused for every item, with the winning path and presence."""
    r = lambda c: F.round(c, 4).alias(c)
    return _fused(spark, sf_dir).select("id", "ds", r("p_tag"), r("p_text"), r("p"), "path", "present")


SPECTRUM = f"""WITH {CENTROIDS}, h AS (SELECT u.id, u.ds, c.idx AS term, {SIG.format("12 * list_dot_product(u.e, c.c) - 3")} AS p FROM u, c WHERE c.idx < 3),
s AS (SELECT id, ds, count(*) FILTER (p >= 0.5) AS matched, coalesce(avg(p) FILTER (p >= 0.5), 0) AS mean_p, max(p) AS p FROM h GROUP BY id, ds),
r AS (SELECT *, CASE WHEN matched = 3 THEN 'all' WHEN matched > 1 THEN 'some' WHEN matched = 1 THEN 'any' ELSE 'none' END AS spectrum FROM s),
o AS (SELECT id, matched::INT AS matched, round(mean_p, 6) AS mean_p, round(p, 4) AS p, spectrum FROM r ORDER BY matched DESC, mean_p DESC, round(p, 4) DESC, id LIMIT 50)"""


def _spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    it = items(spark, sf_dir)
    hits = op.score_tags(it, tag_vectors(it).where("idx < 3")).select("id", "ds", F.col("idx").alias("term"), (1 / (1 + F.exp(-(12 * F.col("cos") - 3)))).alias("p"))
    top = op.rank_hits(op.coverage(hits, 3, 0.5), 50)
    return top.select("id", "matched", F.round("mean_p", 6).alias("mean_p"), F.round("p", 4).alias("p"), "spectrum")


@CORE.add("search_spectrum", f"{SPECTRUM} SELECT * FROM o")
def search_spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All / some / any of three terms, in the final order."""
    return _spectrum(spark, sf_dir)


@CORE.add(
    "search_bands",
    f"""{SPECTRUM}, g AS (SELECT *, row_number() OVER (ORDER BY matched DESC, mean_p DESC, p DESC, id) AS pos FROM o),
    j AS (SELECT *, CASE WHEN matched <> lag(matched) OVER (ORDER BY pos) THEN 1 ELSE 0 END AS new FROM g),
    b AS (SELECT *, sum(new) OVER (ORDER BY pos) AS band FROM j)
    SELECT band::INT AS band, any_value(matched) AS matched, count(*) AS n, min(pos)::INT AS first_pos FROM b GROUP BY band""",
)
def search_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of hits with equal matched count, in rank order (W10). At most k hits stand in the window."""
    from pyspark.sql import Window

    everything = Window.partitionBy(F.lit(0))
    g = _spectrum(spark, sf_dir).withColumn("pos", F.row_number().over(everything.orderBy(F.desc("matched"), F.desc("mean_p"), F.desc("p"), "id")))
    w = everything.orderBy("pos")
    new = F.when(F.col("matched") != F.lag("matched").over(w), 1).otherwise(0)
    b = g.withColumn("new", new).withColumn("band", F.sum("new").over(w).cast("int"))
    return b.groupBy("band").agg(F.min("matched").alias("matched"), F.count("*").alias("n"), F.min("pos").alias("first_pos"))


@CORE.add(
    "search_strict",
    f"""WITH {CENTROIDS}, {Q}, {TEXT}, {FITS}, {TAGGED}, a AS (SELECT id, ds, bool_and(p >= eff) FILTER (fitted) AS every FROM k GROUP BY id, ds)
    SELECT a.id, round(t.cos, 6) AS score FROM a JOIN t USING (id, ds) WHERE every""",
)
def search_strict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict: every calibrated tag must clear its threshold, as a real filter."""
    it = items(spark, sf_dir)
    every = _tagged(spark, it).groupBy("id", "ds").agg(F.bool_and(F.when(F.col("fitted"), F.col("p") >= F.col("eff"))).alias("every"))
    return every.where("every").join(_text(it), ["id", "ds"]).select("id", F.round("cos", 6).alias("score"))


@CORE.add(
    "search_multi_dataset",
    f"""WITH {U}, {Q}, {TEXT}, r AS (SELECT *, row_number() OVER (PARTITION BY ds ORDER BY cos DESC, id) AS rk FROM t)
    SELECT id, ds, rk::INT AS rank, round(cos, 6) AS score FROM r WHERE rk <= 10 ORDER BY cos DESC, id LIMIT 25""",
)
def search_multi_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top ten of each data set, merged and cut to k."""
    top = op.top_per_set(_text(items(spark, sf_dir)), 10, [F.desc("cos"), F.asc("id")])
    return top.orderBy(F.desc("cos"), "id").limit(25).select("id", "ds", "rank", F.round("cos", 6).alias("score"))


@CORE.add(
    "search_dedupe",
    """WITH h AS (SELECT DISTINCT lower(trim(image_id)) AS image_id, dataset, img_path, size_bytes FROM images WHERE size_bytes > 3000000),
    r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY size_bytes DESC, dataset, img_path) AS r, count(*) OVER (PARTITION BY image_id) - 1 AS collapsed FROM h)
    SELECT image_id, any_value(dataset) FILTER (r = 1) AS dataset, coalesce(array_to_string(list_sort(list(DISTINCT dataset) FILTER (r > 1)), ','), '') AS also_in, any_value(collapsed)::INT AS collapsed FROM r GROUP BY image_id""",
)
def search_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of one picture collapse on the best; the other data sets fold into also_in."""
    h = table(spark, sf_dir, "images").where("size_bytes > 3000000").select(F.lower(F.trim("image_id")).alias("image_id"), "dataset", "img_path", "size_bytes").distinct()
    one = op.collapse(h, "image_id", [F.desc("size_bytes"), F.asc("dataset"), F.asc("img_path")], "dataset")
    return one.select("image_id", "dataset", F.array_join("also_in", ",").alias("also_in"), "collapsed")


@CORE.add(
    "search_track_filter",
    """WITH f AS (SELECT DISTINCT dataset, image_id FROM tracks WHERE lower(trim(category)) = 'sports' AND lower(trim(tier)) = 'match'),
    i AS (SELECT rec_id, dataset, lower(trim(image_id)) AS image_id, size_bytes FROM images)
    SELECT rec_id, i.image_id, size_bytes FROM i SEMI JOIN f ON i.dataset = f.dataset AND i.image_id = f.image_id ORDER BY size_bytes DESC, rec_id LIMIT 40""",
)
def search_track_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track and tier filter as a semi-join before the cut (P5 Q2)."""
    f = table(spark, sf_dir, "tracks").where((F.lower(F.trim("category")) == "sports") & (F.lower(F.trim("tier")) == "match")).select("dataset", "image_id")
    i = table(spark, sf_dir, "images").select("rec_id", "dataset", F.lower(F.trim("image_id")).alias("image_id"), "size_bytes")
    return i.join(f, ["dataset", "image_id"], "left_semi").orderBy(F.desc("size_bytes"), "rec_id").limit(40).select("rec_id", "image_id", "size_bytes")


@CORE.add(
    "search_where_meta",
    """SELECT rec_id, dataset, meta['camera'][1] AS camera, cardinality(meta)::INT AS n_meta FROM images WHERE meta IS NOT NULL AND meta['camera'][1] = 'lumo x'"""
    .replace("meta['camera'][1]", "element_at(meta, 'camera')[1]").replace("element_at(meta, 'camera')[1]", "map_extract(meta, 'camera')[1]"),
)
def search_where_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata predicate, and metadata shown only where there is some."""
    i = table(spark, sf_dir, "images").where(F.col("meta")["camera"] == "lumo x")
    return i.select("rec_id", "dataset", F.col("meta")["camera"].alias("camera"), F.size("meta").alias("n_meta"))


@CORE.add(
    "search_summary",
    f"""WITH {CENTROIDS}, {Q}, {TEXT}, {FITS}, {TAGGED}, {FUSED},
    s AS (SELECT count(*) AS indexed, count(*) FILTER (cos >= 0.18) AS n_hits, bool_or(present) AS gated, max(cos) AS best_cos, max(p_text) AS best_text, count(DISTINCT ds) AS datasets FROM z)
    SELECT indexed, n_hits, gated, round(best_cos, 6) AS best_cos, round(best_text, 4) AS best_text, datasets, (n_hits = 0) OR (NOT gated AND (best_cos < 0.18 OR best_text < 0.5)) AS no_match FROM s""",
)
def search_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope of a search: counts, gate, best scores and the no-match verdict."""
    s = _fused(spark, sf_dir).agg(
        F.count("*").alias("indexed"), F.count_if(F.col("cos") >= 0.18).alias("n_hits"), F.bool_or("present").alias("gated"),
        F.max("cos").alias("best_cos"), F.max("p_text").alias("best_text"), F.count_distinct("ds").alias("datasets"),
    )
    out = op.no_match(s, F.col("gated"), F.col("best_cos") < 0.18, F.lit(True), F.col("best_text"))
    return out.select("indexed", "n_hits", "gated", F.round("best_cos", 6).alias("best_cos"), F.round("best_text", 4).alias("best_text"), "datasets", "no_match")


@CORE.add(
    "tag_near",
    f"""WITH {CENTROIDS}, {Q}, s AS (SELECT idx, list_dot_product(c, qe) AS cos FROM c, q) SELECT idx, round(cos, 6) AS cos FROM s WHERE cos >= 0.05 ORDER BY cos DESC, idx LIMIT 32""",
)
def tag_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts near the query vector, at most 32."""
    it = items(spark, sf_dir)
    q = it.where("id = 0").select(F.col("e").alias("qe"))
    s = tag_vectors(it).crossJoin(F.broadcast(q)).select("idx", dot("c", "qe").alias("cos"))
    return s.where("cos >= 0.05").orderBy(F.desc("cos"), "idx").limit(32).select("idx", F.round("cos", 6).alias("cos"))


EDGES = """e AS (SELECT DISTINCT lower(r_name) AS parent, lower(n_name) AS child FROM nation JOIN region ON n_regionkey = r_regionkey
UNION SELECT * FROM (VALUES ('world', 'asia'), ('world', 'europe'), ('world', 'africa'), ('world', 'america'), ('asia', 'world')) AS v(parent, child))"""


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    named = n.join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"]).select(F.lower("r_name").alias("parent"), F.lower("n_name").alias("child"))
    extra = [("world", "asia"), ("world", "europe"), ("world", "africa"), ("world", "america"), ("asia", "world")]
    return named.union(spark.createDataFrame(extra, "parent string, child string")).distinct()


@CORE.add(
    "hyponym_closure",
    f"""WITH RECURSIVE {EDGES}, r AS (SELECT 'world' AS root, 'world' AS term, 0 AS level UNION SELECT r.root, e.child, r.level + 1 FROM r JOIN e ON r.term = e.parent WHERE r.level < 3)
    SELECT root, term, min(level)::INT AS level FROM r GROUP BY root, term""",
)
def hyponym_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything below a term within three levels, cycles included (J6 SRC11 D10)."""
    return op.closure(_edges(spark, sf_dir), spark.createDataFrame([("world",)], "root string"))


@CORE.add(
    "name_candidates",
    f"""WITH {EDGES}, v AS (SELECT DISTINCT child AS name FROM e UNION SELECT DISTINCT parent FROM e), t AS (SELECT * FROM (VALUES ('asia'), ('europe'), ('nothing')) AS x(term)),
    c AS (SELECT term, name, 'exact' AS match, 0 AS pri FROM t JOIN v ON term = name UNION ALL SELECT term, child, 'hypernym', 1 FROM t JOIN e ON term = parent)
    SELECT term, name, arg_min(match, pri) AS match FROM c GROUP BY term, name""",
)
def name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query terms looked up in the vocabulary, exact before hypernym."""
    e = _edges(spark, sf_dir)
    v = e.select(F.col("child").alias("name")).union(e.select("parent")).distinct()
    t = spark.createDataFrame([("asia",), ("europe",), ("nothing",)], "term string")
    exact = v.join(F.broadcast(t), F.col("term") == F.col("name")).select("term", "name", F.lit("exact").alias("match"), F.lit(0).alias("pri"))
    hyper = e.join(F.broadcast(t), F.col("term") == F.col("parent")).select("term", F.col("child").alias("name"), F.lit("hypernym").alias("match"), F.lit(1).alias("pri"))
    return exact.union(hyper).groupBy("term", "name").agg(F.min_by("match", "pri").alias("match"))


STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)


@CORE.add(
    "token_stats",
    f"""WITH t AS (SELECT item_id, regexp_extract_all(lower(item_text), '[a-z0-9]+') AS a FROM eval_items), c AS (SELECT *, list_filter(a, lambda x: x NOT IN ({STOP})) AS k FROM t)
    SELECT item_id, len(a)::INT AS n_tokens, len(k)::INT AS n_content, len(k) > 2 AS compound, coalesce(k[1], '') AS first_term FROM c""",
)
def token_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and content tokens of a text, and whether it is a compound query."""
    t = table(spark, sf_dir, "eval_items").select("item_id", tx.tokens(F.col("item_text")).alias("a"), tx.content_tokens(F.col("item_text")).alias("k"))
    return t.select("item_id", F.size("a").alias("n_tokens"), F.size("k").alias("n_content"), (F.size("k") > 2).alias("compound"), F.coalesce(F.try_element_at("k", F.lit(1)), F.lit("")).alias("first_term"))


@CORE.add(
    "term_postings",
    f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM t
    WHERE term NOT IN ({STOP}) AND regexp_matches(term, '^[a-z]{{3,}}$') GROUP BY term HAVING count(DISTINCT doc_id) >= 20""",
)
def term_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of content terms: counted per document first, so frequent terms shuffle little."""
    t = table(spark, sf_dir, "documents").select("doc_id", F.explode(tx.content_tokens(F.col("text"))).alias("term")).where(F.col("term").rlike("^[a-z]{3,}$"))
    per = t.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where("df >= 20")


@CORE.add(
    "name_prompts",
    r"""WITH n AS (SELECT n_nationkey, lower(trim(regexp_replace(regexp_replace(regexp_replace(n_name || '_(old)', '\([^)]*\)', ' ', 'g'), '[_\-]', ' ', 'g'), '\s+', ' ', 'g'))) AS name FROM nation)
    SELECT n_nationkey, name, 'a photo of ' || CASE WHEN regexp_matches(lower(left(name, 1)), '[aeiou]') THEN 'an' ELSE 'a' END || ' ' || name || '.' AS prompt FROM n""",
)
def name_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names normalised and turned into prompts."""
    n = table(spark, sf_dir, "nation").select("n_nationkey", tx.normalise_name(F.concat("n_name", F.lit("_(old)"))).alias("name"))
    return n.withColumn("prompt", tx.prompt(F.col("name")))


@CORE.add(
    "vocab_union",
    """WITH s AS (SELECT lower(trim(n_name)) AS name, 0 AS src FROM nation UNION ALL SELECT lower(trim(r_name)), 1 FROM region UNION ALL SELECT lower(trim(word)), 2 FROM common_words UNION ALL SELECT lower(trim(p_type)), 3 FROM part),
    d AS (SELECT name, min(src) AS src FROM s WHERE length(name) BETWEEN 1 AND 40 GROUP BY name) SELECT name, src, row_number() OVER (ORDER BY src, name)::INT AS idx FROM d ORDER BY src, name LIMIT 4200""",
)
def vocab_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered union of vocabularies, first source wins, numbered, cut at the table's size."""
    from pyspark.sql import Window

    parts = [("nation", "n_name"), ("region", "r_name"), ("common_words", "word"), ("part", "p_type")]
    s = None
    for k, (t, c) in enumerate(parts):
        x = table(spark, sf_dir, t).select(F.lower(F.trim(c)).alias("name"), F.lit(k).alias("src"))
        s = x if s is None else s.unionByName(x)
    d = s.where(F.length("name").between(1, 40)).groupBy("name").agg(F.min("src").alias("src")).orderBy("src", "name").limit(4200)
    return d.withColumn("idx", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("src", "name")))
