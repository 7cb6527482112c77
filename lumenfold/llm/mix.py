"""Mixing sources to target token shares: pivotal dependent rounding with a distributed reduction tree."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import stage

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Sources that targets may name; they are read to the driver and refused beyond.
MAX_SOURCES = 10_000
#: Documents of one group that is rounded by one task.
GROUP_ROWS = 20_000
#: Residuals combined by one task of the reduction tree.
FAN_IN = 64

_encoders: dict[str, object] = {}


def _encoder(path: str):
    """The tokenizer of this Python worker, loaded once from its public vocabulary file."""
    if path not in _encoders:
        import public_tokenizers
        import tiktoken

        with open(path if "/" in path else public_tokenizers.path(path), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[path] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def token_counts(docs: DataFrame, tokenizer: str = TOKENIZER, ident: str = "doc_id") -> DataFrame:
    """(ident, source, n_tokens): whole texts; source trimmed and lower-cased; a null or empty text has no tokens.

    tokenizer is a file name of the public tokenizers or a path to such a file.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = _encoder(tokenizer)
        for f in frames:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in f["text"]]
            yield pd.DataFrame({ident: f[ident], "source": f["source"], "n_tokens": np.array(n, np.int64)})

    kind = docs.schema[ident].dataType.simpleString()
    return docs.select(ident, F.lower(F.trim("source")).alias("source"), "text").mapInPandas(count, f"{ident} {kind}, source string, n_tokens long")


def pivotal(p: np.ndarray, t: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int]:
    """Rounds probabilities p of items of size t one pair at a time: (p after, place of the one fractional item or -1).

    Each step moves mass between the carried item and the next, sum(p * t) unchanged, until one of them is 0 or 1; the
    direction is drawn so that the expectation of every p stays what it was.
    """
    out, carry = p.astype(float), -1
    draws = rng.random(len(p))
    for i in range(len(p)):
        if out[i] <= 0.0 or out[i] >= 1.0:
            continue
        if carry < 0:
            carry = i
            continue
        a, b = out[carry], out[i]
        ta, tb = t[carry], t[i]
        up, down = min((1 - a) * ta, b * tb), min(a * ta, (1 - b) * tb)  # mass to the carried item, or from it
        if draws[i] * (up + down) < down:
            a, b = (1.0, b - up / tb) if (1 - a) * ta <= b * tb else (a + up / ta, 0.0)
        else:
            a, b = (0.0, b + down / tb) if a * ta <= (1 - b) * tb else (a - down / ta, 1.0)
        a, b = (x if 1e-12 < x < 1 - 1e-12 else float(round(x)) for x in (a, b))
        out[carry], out[i] = a, b
        carry = carry if 0 < a < 1 else i if 0 < b < 1 else -1
    return out, carry


_ROUNDED = "ident long, source string, n_tokens long, base int, p double, at int"


def _round_groups(f: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Pivotal rounding of each source in f; rows whose p stays fractional are the residuals, at most one a source."""
    for source, g in f.groupby("source", sort=True):
        first = int(g["ident"].iloc[0]) & (2**63 - 1)
        rng = np.random.default_rng([seed, first, len(g)])
        f.loc[g.index, "p"] = pivotal(g["p"].to_numpy(), g["n_tokens"].to_numpy(float), rng)[0]
    return f


def plan_rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> list[dict]:
    """Copies per document of each source, on the driver (one row a source).

    Shares are those of the targets among sources that have tokens. Without total_tokens the mixture is the largest in which
    every source has its share within its repeats; with it, a source that cannot reach its share is held at its cap.
    """
    rows = targets.where("source IS NOT NULL AND target_pm > 0").groupBy(F.lower(F.trim("source")).alias("source")).agg(F.max("target_pm").alias("target_pm"), F.max("max_repeats").alias("max_repeats"))
    rows = rows.limit(MAX_SOURCES + 1).join(sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs")), "source", "left").collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"targets name more than {MAX_SOURCES} sources")
    live = [r for r in rows if r["tokens"] and (r["max_repeats"] or 0) > 0]
    shares = sum(r["target_pm"] for r in live)
    if total_tokens is None:
        total = min((r["max_repeats"] * r["tokens"] * shares / r["target_pm"] for r in live), default=0.0)
    else:
        total = float(total_tokens)
    out = []
    for r in rows:
        rate = min(float(r["max_repeats"]), r["target_pm"] / shares * total / r["tokens"]) if r in live else 0.0
        rate = float(round(rate)) if abs(rate - round(rate)) < 1e-9 else rate
        out.append({"source": r["source"], "target_pm": r["target_pm"], "max_repeats": r["max_repeats"], "docs": r["docs"] or 0, "tokens": r["tokens"] or 0, "rate": rate})
    return sorted(out, key=lambda r: r["source"])


def mixture(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 7, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents with their copies, report of the shares reached).

    Documents without id, source target or tokens are not used; rows of one doc_id count as one document. A source's token total in the mixture differs from its
    target by less than one of its documents: rounding moves token mass between documents and only the last residual of a
    source is drawn alone. Every group of documents, dealt by hash of their id, is rounded in order of size and leaves at most
    one residual a source; residuals are combined FAN_IN at a time, level by level, so neither a task nor the driver ever holds a source.
    """
    spark = docs.sparkSession
    counted = stage(token_counts(docs.where("doc_id IS NOT NULL"), tokenizer).where("n_tokens > 0 AND source IS NOT NULL"), "sizes")
    sizes = counted.groupBy("doc_id").agg(F.min(F.struct("source", "n_tokens")).alias("d")).select("doc_id", "d.*")
    if counted.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").isEmpty():
        sizes = counted
    rates = plan_rates(sizes, targets, total_tokens)
    rate_of = spark.createDataFrame([(r["source"], r["rate"]) for r in rates], "source string, rate double")
    # groups by hash of the id, in order of size: the outcome depends on the documents and the seed, not on files or retries
    width = max(1, -(-sum(r["docs"] for r in rates) // GROUP_ROWS))
    start = sizes.join(F.broadcast(rate_of), "source").select(
        F.col("doc_id").alias("ident"), "source", "n_tokens", F.floor("rate").cast("int").alias("base"), (F.col("rate") - F.floor("rate")).alias("p"), F.pmod(F.hash("doc_id"), F.lit(width)).alias("at")
    )
    rounded = start.groupBy("at").applyInPandas(lambda f: _round_groups(f.sort_values(["source", "n_tokens", "ident"], ignore_index=True), seed), _ROUNDED)
    done = stage(rounded, "rounded")
    fractional = (F.col("p") > 0) & (F.col("p") < 1)
    parts, rest = [done.where(~fractional)], done.where(fractional)
    while width > 1:
        width = -(-width // FAN_IN)
        level = rest.withColumn("at", F.floor(F.col("at") / FAN_IN).cast("int"))
        level = stage(level.groupBy("source", "at").applyInPandas(lambda f: _round_groups(f.sort_values("ident", ignore_index=True), seed + 1), _ROUNDED), "rounded")
        parts.append(level.where(~fractional))
        rest = level.where(fractional)
    # one item a source is left: it is drawn alone
    unit = F.pmod(F.xxhash64("ident", F.lit(seed)), F.lit(1 << 53)) / float(1 << 53)
    parts.append(rest.withColumn("p", F.when(unit < F.col("p"), 1.0).otherwise(0.0)))
    chosen = parts[0]
    for x in parts[1:]:
        chosen = chosen.unionByName(x)
    copies = chosen.select(F.col("ident").alias("doc_id"), "source", "n_tokens", (F.col("base") + F.col("p")).cast("int").alias("copies")).where("copies > 0")

    reached = copies.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("mixed_tokens"), F.count("*").alias("used_docs"), F.max("copies").alias("most_copies"))
    plan = spark.createDataFrame([tuple(r.values()) for r in rates], "source string, target_pm int, max_repeats int, docs long, tokens long, rate double")
    zero = F.lit(0).cast("long")
    report = F.broadcast(plan).join(reached, "source", "left").select(
        "source", "target_pm", "max_repeats", "docs", "tokens", "rate", F.coalesce("mixed_tokens", zero).alias("mixed_tokens"), F.coalesce("used_docs", zero).alias("used_docs"), F.coalesce("most_copies", F.lit(0)).alias("most_copies")
    )
    everything = Window.partitionBy(F.lit(0))  # one row a source, MAX_SOURCES at most
    report = report.withColumn("share_pm", 1000.0 * F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(everything), F.lit(1)))
    return copies, report
