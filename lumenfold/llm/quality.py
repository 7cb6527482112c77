"""Per-document text statistics, and rule lists learned by incremental reduced-error pruning, applied as SQL CASE."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.session import stage

#: Labelled documents that a rule list is first fitted on, and that each later round may add, at most.
FIT_ROWS = 20_000
#: A word list larger than this is refused: it is compiled into the plan as a hash set.
MAX_WORDS = 20_000

FEATURES = ["n_words", "common_share", "nonletter_share", "mean_word_len", "words_per_line", "end_share"]

# What counts as blank, closing quotes and sentence ends.
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]"
QUOTES = "\"'“”„‘’‚«»‹›"
ENDS = ".!?…"


def speech_lines(text: Column) -> Column:
    """Trimmed lines without tags, braces and byte-order mark; no empty lines, digits only, time lines or WEBVTT."""
    bare = F.regexp_replace(text, r"<[^<>\r\n]*>|\{[^{}\r\n]*\}|﻿", "")
    lines = F.split(bare, r"\r\n|\n|\r")
    trimmed = F.transform(lines, lambda x: F.regexp_replace(x, rf"^{BLANK}+|{BLANK}+$", ""))
    return F.filter(trimmed, lambda x: (x != "") & ~x.contains("-->") & ~x.rlike(r"^\d+$") & (x != "WEBVTT"))


def text_stats(docs: DataFrame, words: list[str], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Statistics of every document's lines and words; whole texts, one pass, no Python and no shuffle.

    A null text counts as empty. Without words or lines the shares and means are null (never NaN) and n_words is 0.
    """
    if len(words) > MAX_WORDS:
        raise ValueError(f"word list has {len(words)} entries; at most {MAX_WORDS} are supported")
    known = sorted({w.lower() for w in words if w}) or [""]
    d = docs.select(ident, speech_lines(F.coalesce(F.col(text), F.lit(""))).alias("lines"))
    d = d.withColumn("body", F.array_join("lines", "\n"))
    d = d.withColumn("words", F.regexp_extract_all("body", F.lit(r"\p{L}+"), F.lit(0)))
    n, lines = F.size("words"), F.size("lines")
    letters = F.length(F.array_join("words", ""))
    nonblank = F.length(F.regexp_replace("body", f"{BLANK}+", ""))
    common = F.size(F.filter("words", lambda w: F.lower(w).isin(known)))
    ended = F.size(F.filter("lines", lambda x: x.rlike(rf"[{ENDS}][{QUOTES}]*$")))
    share = lambda a, b: F.when(b > 0, a / b)
    return d.select(
        ident,
        lines.alias("n_lines"),
        n.alias("n_words"),
        share(letters, n).alias("mean_word_len"),
        share(nonblank - letters, nonblank).alias("nonletter_share"),
        share(ended, lines).alias("end_share"),
        share(common, n).alias("common_share"),
        share(n, lines).alias("words_per_line"),
    )


def not_speech() -> Column:
    """The stated definition of a document that is not natural speech; labels the fitting sample and checks the result."""
    return (
        (F.col("n_words") == 0)
        | (F.col("common_share") < 0.30)
        | (F.col("nonletter_share") > 0.50)
        | (F.col("mean_word_len") > 10)
        | ((F.col("words_per_line") < 3) & (F.col("end_share") < 0.20))
    )


@dataclass(frozen=True)
class Condition:
    """feature < value (below) or feature > value."""

    feature: str
    below: bool
    value: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        c = x[:, names.index(self.feature)]
        with np.errstate(invalid="ignore"):
            return c < self.value if self.below else c > self.value

    def sql(self) -> str:
        return f"{self.feature} {'<' if self.below else '>'} {self.value!r}"


def round_cut(a: float, b: float, below: bool) -> float:
    """The shortest decimal t between a covered value and the next uncovered one such that a is covered and b is not."""
    if not math.isfinite(b):
        return math.nextafter(a, math.inf if below else -math.inf)
    inside = (lambda t: a < t <= b) if below else (lambda t: b <= t < a)
    mid = (a + b) / 2
    for digits in range(-3, 15):
        step = 10.0**-digits
        near = [round(math.floor(mid / step) * step + k * step, max(digits, 0)) for k in (-1, 0, 1, 2)]
        if fit := [t for t in near if inside(t)]:
            return min(fit, key=lambda t: abs(t - mid))
    return b


def _best_condition(x: np.ndarray, y: np.ndarray, names: list[str], pos_all: int) -> tuple[float, Condition] | None:
    """The condition of highest FOIL gain on the rows still covered."""
    p0, n0 = int(y.sum()), int((~y).sum())
    best: tuple[float, Condition] | None = None
    base = math.log2(p0 / (p0 + n0)) if p0 else 0.0
    for j, name in enumerate(names):
        ok = ~np.isnan(x[:, j])
        order = np.argsort(x[ok, j], kind="stable")
        v, lab = x[ok, j][order], y[ok][order]
        if not len(v):
            continue
        for below in (True, False):
            vv, ll = (v, lab) if below else (v[::-1], lab[::-1])
            p, n = np.cumsum(ll), np.cumsum(~ll)
            cut = np.flatnonzero(np.append(vv[1:] != vv[:-1], True))  # last row of each value
            if below is False or len(cut) > 1:
                cut = cut[:-1] if len(cut) > 1 else cut
            pc, nc = p[cut], n[cut]
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(pc > 0, pc * (np.log2(pc / (pc + nc)) - base), -np.inf)
            k = int(np.argmax(gain))
            if np.isfinite(gain[k]) and (best is None or gain[k] > best[0] + 1e-12):
                i = cut[k]
                nxt = vv[i + 1] if i + 1 < len(vv) else math.inf
                best = (float(gain[k]), Condition(name, below, round_cut(float(vv[i]), float(nxt), below)))
    return best


def _covers(rule: list[Condition], x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x, names)
    return hit


def irep(x: np.ndarray, y: np.ndarray, names: list[str], seed: int = 0, max_rules: int = 32) -> list[list[Condition]]:
    """Ordered rules for y by incremental reduced-error pruning.

    Each round splits the rows not yet covered into growing (2/3) and pruning (1/3) parts, grows a conjunction by FOIL gain
    until it covers no negative, drops final conditions while (p - n) / (p + n) on the pruning part does not fall, fixes
    every cut at the shortest decimal that all rows left allow, and stops when a rule is wrong more often than right.
    NaN features satisfy no condition. An empty or one-class y gives no rules.
    """
    rng = np.random.default_rng(seed)
    rules: list[list[Condition]] = []
    left = np.ones(len(y), bool)
    while y[left].any() and (~y[left]).any() and len(rules) < max_rules:
        idx = np.flatnonzero(left)
        part = rng.random(len(idx)) < 2 / 3
        if not y[idx[part]].any():
            part[:] = True
        rule: list[Condition] = []
        gx, gy = x[idx[part]], y[idx[part]]
        while (~gy).any() and len(rule) < 2 * len(names):
            found = _best_condition(gx, gy, names, int(gy.sum()))
            if not found or found[0] <= 1e-9:
                break
            rule.append(found[1])
            hit = found[1].holds(gx, names)
            gx, gy = gx[hit], gy[hit]
        if not rule:
            break
        px, py = x[idx[~part]], y[idx[~part]]

        def worth(r: list[Condition], px: np.ndarray = px, py: np.ndarray = py) -> float:
            hit = _covers(r, px, names)
            return (py[hit].sum() - (~py[hit]).sum()) / max(1, hit.sum())

        while len(rule) > 1 and len(py) and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        rule = _refit(rule, x[left], y[left], names)
        hit = _covers(rule, x, names) & left
        if (hit & y).sum() <= (hit & ~y).sum():
            break
        rules.append(rule)
        left &= ~hit
    return rules


def _refit(rule: list[Condition], x: np.ndarray, y: np.ndarray, names: list[str]) -> list[Condition]:
    """Moves each cut outward over positives until the next negative among all rows left that meet the other conditions."""
    out = list(rule)
    for k, c in enumerate(out):
        rest = [r for i, r in enumerate(out) if i != k]
        m = _covers(rest, x, names) & ~np.isnan(x[:, names.index(c.feature)])
        v, lab = x[m, names.index(c.feature)], y[m]
        if not c.below:
            v = -v
        neg = v[~lab]
        limit = neg.min() if len(neg) else math.inf
        pos = v[lab & (v < limit)]
        if not len(pos) or (len(neg) and ((v <= (c.value if c.below else -c.value)) & ~lab).any()):
            continue
        a, b = float(pos.max()), float(limit)
        out[k] = Condition(c.feature, c.below, round_cut(a, b, True) if c.below else round_cut(-a, -b if math.isfinite(b) else math.inf, False))
    return out


def case_sql(rules: list[list[Condition]]) -> str:
    """The rule list as one CASE: number of the first rule that holds, from 1; 0 where none does."""
    whens = " ".join(f"WHEN {' AND '.join(c.sql() for c in r)} THEN {i}" for i, r in enumerate(rules, 1))
    return f"CASE {whens} ELSE 0 END" if rules else "0"


def fit_rules(stats: DataFrame, label: Column, ident: str = "doc_id", features: list[str] = FEATURES, fit_rows: int = FIT_ROWS) -> tuple[list[list[Condition]], DataFrame]:
    """(rule list for `label` (null counts as false), stats with the number of the rule that caught each row as `rule`).

    The list is learned from at most fit_rows documents: those under a threshold on the hash of their id, set from the count.
    Then all documents are gone through: labelled ones that no rule catches join the sample, fit_rows at most, and the list is
    learned anew, until none is missed or the last round brought no progress; what is missed then is rule -1, so it is not lost.
    """
    h = F.pmod(F.xxhash64(ident), F.lit(1 << 30))
    rows = stats.select(ident, h.alias("h"), F.coalesce(label, F.lit(False)).alias("y"), *[F.col(c).cast("double").alias(c) for c in features])
    n = stats.count()
    sample = rows.where(F.col("h") < int((1 << 30) * min(1.0, fit_rows / max(1, n)))).limit(fit_rows + fit_rows // 8)
    fit, missed = sample.toPandas(), None
    while True:
        rules = irep(fit[features].to_numpy(np.float64, na_value=np.nan), fit["y"].to_numpy(bool), features)
        caught = F.expr(case_sql(rules))
        lost = rows.where("y").where(caught == 0)
        before, missed = missed, lost.count()
        if not missed or (before is not None and missed >= before):
            break
        more = lost.where(F.col("h") < int((1 << 30) * min(1.0, fit_rows / missed))).limit(fit_rows).toPandas()
        fit = pd.concat([fit, more]).drop_duplicates(ident, ignore_index=True)
    return rules, stats.withColumn("rule", F.when((caught == 0) & F.coalesce(label, F.lit(False)), -1).otherwise(caught))


def junk_documents(docs: DataFrame, common_words: DataFrame) -> tuple[DataFrame, list[list[Condition]]]:
    """(statistics of every document with the rule that caught it, rules). Rule 0 means natural speech.

    The word list is read to the driver; it is refused beyond MAX_WORDS.
    """
    words = [r[0] for r in common_words.where("word IS NOT NULL").select(F.lower("word")).distinct().limit(MAX_WORDS + 1).collect()]
    stats = stage(text_stats(docs, words), "text-stats")
    rules, ruled = fit_rules(stats, not_speech())
    return ruled, rules
