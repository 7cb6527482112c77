"""Search by a query text: terms, tag candidates, fused scores, coverage, one ranked list of hits with an honest summary."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import text as tx
from lumenfold.functions.calib import KEEP_COS, STD_FLOOR, UNFITTED_EFF, platt, text_p
from lumenfold.functions.vector import products
from lumenfold.operators.search import collapse

# Tags that a query may name, least cosine of a near tag, default threshold.
MAX_TAGS, NEAR_TAG, TAU = 32, 0.90, 0.5


class ModelMismatch(ValueError):
    """A table was made for another model."""


@dataclass
class TagTable:
    """Concepts that a query may name: unit vectors, Platt pairs and thresholds where fitted, and the hypernym edges over names.

    A table is bounded reference data (thousands of tags), held on the driver and sent to the tasks as one matrix.
    """

    names: list[str]
    vectors: np.ndarray
    fits: dict[str, tuple[float, float, float | None]] = field(default_factory=dict)  # name -> a, b, tau
    raised: dict[str, float] = field(default_factory=dict)  # name -> mean + 3 std of the data set, where known
    edges: dict[str, list[str]] = field(default_factory=dict)  # parent -> children
    text_fitted: bool = False
    model_sha: str = ""

    def below(self, term: str, depth: int = 3) -> list[str]:
        """The term and everything under it within depth levels, nearest first; cycles end."""
        seen, level = [term], [term]
        for _ in range(depth):
            level = list(dict.fromkeys(c for t in level for c in self.edges.get(t, []) if c not in seen))
            seen += level
        return seen

    def named(self, term: str) -> list[tuple[int, str]]:
        """(tag, how) for the tags that a term names, itself or as a hypernym."""
        at = {n: i for i, n in enumerate(self.names)}
        return [(at[n], "exact" if n == term else "hypernym") for n in self.below(term) if n in at]

    def save(self, df_path: str, spark) -> None:
        """Writes the table; refuses one without vectors."""
        if not len(self.vectors):
            raise ValueError("a tag table needs vectors")
        none = (None, None, None)
        rows = [(i, n, v.tolist(), *self.fits.get(n, none), self.raised.get(n), self.edges.get(n, []), self.model_sha, self.text_fitted) for i, (n, v) in enumerate(zip(self.names, self.vectors))]
        extra = [(-1, p, [], *none, None, c, self.model_sha, self.text_fitted) for p, c in self.edges.items() if p not in self.names]
        kind = "idx int, name string, vec array<double>, a double, b double, tau double, raised double, children array<string>, model_sha string, text_fitted boolean"
        spark.createDataFrame(rows + extra, kind).coalesce(1).write.mode("overwrite").parquet(df_path)

    @staticmethod
    def load(path: str, spark, model_sha: str) -> TagTable | None:
        """Reads a table; None where there is none, an error where it was made for another model."""
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return None
        rows = sorted(spark.read.parquet(path).collect(), key=lambda r: r["idx"])
        if any(r["model_sha"] != model_sha for r in rows):
            raise ModelMismatch(f"{path} was made for model {rows[0]['model_sha']}, not {model_sha}")
        tags = [r for r in rows if r["idx"] >= 0]
        return TagTable(
            [r["name"] for r in tags], np.array([r["vec"] for r in tags]), {r["name"]: (r["a"], r["b"], r["tau"]) for r in tags if r["a"] is not None},
            {r["name"]: r["raised"] for r in tags if r["raised"] is not None}, {r["name"]: r["children"] for r in rows if r["children"]}, rows[0]["text_fitted"], model_sha,
        )


@dataclass
class Plan:
    """What a query asks for: candidate tags and how each was found, its concepts, whether the text is encoded."""

    query: str
    cands: list[tuple[int, str]]
    groups: list[tuple[str, list[int]]]
    use_text: bool


def concepts(table: TagTable, query: str) -> list[tuple[str, list[int]]]:
    """(term, tags) of a query that is a list of tags: two or more terms, all of them named, unquoted words joined to the longest
    names first. Anything else is natural language and has none."""
    vocabulary = set(table.names) | set(table.edges)
    terms, run = [], []
    for term, quoted in [*tx.split_terms(query), ("", True)]:
        if not quoted:
            run.append(term)
            continue
        joined = tx.segment(run, vocabulary) if run else []
        if joined is None:
            return []
        terms += joined + ([term] if term else [])
        run = []
    groups = [(t, [i for i, _ in table.named(t)]) for t in dict.fromkeys(terms)]
    return groups if len(groups) > 1 and all(g for _, g in groups) else []


def plan(table: TagTable | None, query: str, text: str = "auto") -> Plan:
    """Candidates by name for the whole query (a compound names none of its parts), tags of its concepts, and the policy of the
    text path: `always`, `never`, or `auto`: only if no tag is named, or none of the named is calibrated."""
    if text not in ("auto", "always", "never"):
        raise ValueError(f"unknown text policy {text!r}")
    if table is None:
        return Plan(query, [], [], text != "never")
    phrase = " ".join(t for t, _ in tx.split_terms(query))
    found = dict(table.named(phrase))
    groups = concepts(table, query)
    for _, idx in groups:
        for i in idx:
            found.setdefault(i, "tag-list")
    cands = sorted(found.items())[:MAX_TAGS]
    fitted = [table.names[i] in table.fits for i, _ in cands]
    return Plan(query, cands, groups, text == "always" or (text != "never" and not any(fitted)))


def _p(table: TagTable, i: int, cos: Column) -> Column:
    f = table.fits.get(table.names[i])
    return platt(cos, F.lit(f[0]), F.lit(f[1])) if f else text_p(cos)


def _eff(table: TagTable, i: int) -> float:
    f = table.fits.get(table.names[i])
    return max(TAU if f[2] is None else f[2], table.raised.get(table.names[i], 0.0)) if f else UNFITTED_EFF


def score(items: DataFrame, table: TagTable | None, asked: Plan, encoder=None, strict: bool = False) -> DataFrame:
    """Every item with its fused score: (id, ds, cos, score, p_tag, p_text, p, z, path, tag, match, matched, mean_p, spectrum,
    gate, keep). One pass of matrix products over the items; z takes the mean and deviation of the text cosine within each ds,
    one small aggregate."""
    cands, q = list(asked.cands), None
    if asked.use_text:
        q = np.asarray(encoder.embed_texts([asked.query])[0], np.float64)
        if table is not None and not tx.is_compound_text(asked.query):
            near = np.flatnonzero(table.vectors @ q >= NEAR_TAG)
            known = dict(cands)
            cands = sorted((known | {int(i): known.get(int(i), "near") for i in near}).items())[:MAX_TAGS]
    bank = [table.vectors[i] for i, _ in cands] + ([q] if q is not None else [])
    if not bank:
        bank = [np.zeros(len(items.select("e").first()[0]))]
    s = products(items, ["id", "ds"], "e", np.array(bank))
    zero = F.lit(0.0)
    cos = [F.col("cos")[j] for j in range(len(cands))]
    s_text = F.col("cos")[len(cands)] if q is not None else None
    fitted = [table.names[i] in table.fits for i, _ in cands]
    p = [_p(table, i, c) for (i, _), c in zip(cands, cos)]
    ptext = text_p(s_text) if q is not None else zero
    fit_p = [x for x, f in zip(p, fitted) if f]
    cap = F.greatest(zero, zero, *fit_p, *([ptext] if q is not None else []))
    p = [x if f else F.least(x, cap) for x, f in zip(p, fitted)]
    s = s.select("id", "ds", "cos", F.array(*p).alias("P") if p else F.array().cast("array<double>").alias("P"), ptext.alias("p_text"))
    P = [F.col("P")[j] for j in range(len(cands))]
    eff = [_eff(table, i) for i, _ in cands]
    gate = F.lit(False)
    every = F.lit(True)
    for x, e, f in zip(P, eff, fitted):
        if f:
            gate, every = gate | (x >= e), every & (x >= e)
    at = {i: j for j, (i, _) in enumerate(cands)}
    hit, best = [], []
    for _, idx in asked.groups:
        cols = [at[i] for i in idx if i in at]
        bars = [eff[j] if fitted[j] else float(1 / (1 + np.exp(-(60.0 * NEAR_TAG - 17.6)))) for j in cols]
        over = F.lit(False)
        for j, bar in zip(cols, bars):
            over = over | (P[j] >= bar)
        hit.append(over)
        best.append(F.greatest(zero, zero, *[P[j] for j in cols]))
    matched = sum((h.cast("int") for h in hit), F.lit(0))
    mean_p = F.when(matched > 0, sum((F.when(h, b).otherwise(zero) for h, b in zip(hit, best)), zero) / matched).otherwise(zero)
    p_tag = F.array_max("P") if P else zero
    keep_all = every if strict else F.lit(True)
    top = F.array_position("P", F.array_max("P")).cast("int") if P else F.lit(1)
    names = F.array(*[F.lit(table.names[i]) for i, _ in cands]) if cands else F.array(F.lit(""))
    how = F.array(*[F.lit(h) for _, h in cands]) if cands else F.array(F.lit(""))
    row_cos = s_text if q is not None else (F.array_max("cos") if cands else zero)
    terms = len(asked.groups)
    out = s.select(
        "id", "ds", F.when(keep_all, p_tag).otherwise(zero).alias("p_tag"), F.when(keep_all, F.col("p_text")).otherwise(zero).alias("p_text"), row_cos.alias("row_cos"),
        (F.col("cos")[top - 1] if cands else zero).alias("tag_cos"), (s_text if q is not None else zero).alias("text_cos"), names[top - 1].alias("tag"), how[top - 1].alias("match"),
        matched.cast("int").alias("matched"), mean_p.alias("mean_p"), gate.alias("gate"), F.array_compact(F.array(*[F.when(h, F.lit(t)) for h, (t, _) in zip(hit, asked.groups)])).alias("terms_hit") if terms else F.array().cast("array<string>").alias("terms_hit"),
    )
    tagged = F.col("p_tag") > F.col("p_text")
    spectrum = F.when(F.col("matched") == terms, "all").when(F.col("matched") > 1, "some").otherwise("any") if terms else F.lit(None).cast("string")
    keep = (F.col("row_cos") >= KEEP_COS) | ((F.col("p_tag") >= TAU) if table is not None and table.fits else F.lit(False)) | ((F.col("p_text") >= TAU) if table is not None and table.text_fitted else F.lit(False))
    return out.select(
        "*", F.greatest("p_tag", "p_text").alias("p"), F.when(tagged, "tag").otherwise("text").alias("path"),
        F.when(tagged, F.col("tag_cos")).otherwise(F.col("text_cos")).alias("score"), spectrum.alias("spectrum"), keep.alias("keep"),
    )


def search(items: DataFrame, table: TagTable | None, query: str, encoder=None, k: int = 50, strict: bool = False, text: str = "auto", only: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """Ranked hits of a query over all data sets: at most k rows (1..500), in the order matched terms, mean p, p to four places, id.

    items: (id, ds, e) and any other columns, which come along. only: (id) of the items that a filter leaves. key: a column on
    which hits collapse to the best-ranked one, with the data sets of the others in also_in. The cut to k of each data set comes
    before the keep mask, as a display floor; `strict` asks every calibrated tag of every hit.
    """
    if not 1 <= k <= 500:
        raise ValueError("k must lie in 1..500")
    asked = plan(table, query, text)
    s = score(items if only is None else items.join(only, "id", "left_semi"), table, asked, encoder, strict)
    if asked.use_text:
        stats = s.groupBy("ds").agg(F.avg("text_cos").alias("__m"), F.greatest(F.stddev_pop("text_cos"), F.lit(STD_FLOOR)).alias("__s"))
    lead = F.desc("mean_p") if asked.groups else F.desc("p")
    top = s.withColumn("r", F.row_number().over(Window.partitionBy("ds").orderBy(F.desc("matched"), lead, "id"))).where(F.col("r") <= k).where("keep").drop("r")
    if asked.use_text:
        top = top.join(stats, "ds").withColumn("z", (F.col("text_cos") - F.col("__m")) / F.col("__s")).drop("__m", "__s")
    else:
        top = top.withColumn("z", F.lit(0.0))
    rest = [c for c in items.columns if c not in ("id", "ds", "e") and c not in top.columns]
    hits = top.join(items.select("id", "ds", *rest), ["id", "ds"]) if rest else top
    order = [F.desc("matched"), F.desc("mean_p"), F.desc(F.round("p", 4)), "id"]
    if key:
        hits = collapse(hits, key, order, "ds")
    return hits.orderBy(*order).limit(k)


def summary(items: DataFrame, table: TagTable | None, query: str, encoder=None, strict: bool = False, text: str = "auto") -> DataFrame:
    """One row: what a search can say about itself. no_match: no row may be shown, or no calibrated tag clears its threshold
    anywhere while nothing is similar, or a fitted text path rejects everything."""
    asked = plan(table, query, text)
    s = score(items, table, asked, encoder, strict)
    fitted = bool(table and table.text_fitted)
    a = s.agg(F.count("*").alias("indexed"), F.count_if("keep").alias("n_keep"), F.bool_or("gate").alias("gated"), F.max("row_cos").alias("best_cos"), F.max("p_text").alias("best_p_text"))
    gated = F.coalesce("gated", F.lit(False))
    dead = F.coalesce(F.col("best_cos") < KEEP_COS, F.lit(True))
    no = (F.col("n_keep") == 0) | (~gated & (dead | (F.lit(fitted) & (F.col("best_p_text") < TAU))))
    return a.select(
        F.lit(query).alias("query"), "indexed", gated.alias("gated"), dead.alias("dense_dead"), F.when(gated, "fitted").otherwise("unfitted").alias("calibration"),
        F.lit("loaded" if asked.use_text else "skipped").alias("text_path"), F.lit(" | ".join(t for t, _ in asked.groups)).alias("terms"), no.alias("no_match"),
    )
