"""Scorers over concept banks: every one reads an item's cosines to all concepts, an array from one matrix product a batch, and is
a set of JVM expressions on it. Banks are lists of positions in that array."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.functions.calib import band, capped, sigmoid
from lumenfold.functions.vector import products

Bank = Sequence[int]


def item_cosines(items: DataFrame, bank) -> DataFrame:
    """(id, ds, cos): cosines of each item to all concepts."""
    return products(items, ["id", "ds"], "e", bank)


def best(cos: Column, bank: Bank) -> Column:
    """Highest cosine to the concepts of a bank; 0 for an empty bank."""
    return F.array_max(F.array(*[cos[i] for i in bank])) if len(bank) else F.lit(0.0)


def which(cos: Column, bank: Bank, names: Sequence[str]) -> Column:
    """Name of the closest concept of a bank, the first of equal ones."""
    a = F.array(*[cos[i] for i in bank])
    return F.element_at(F.array(*[F.lit(n) for n in names]), F.array_position(a, F.array_max(a)).cast("int"))


def margin(cos: Column, bank: Bank, background: Bank) -> Column:
    """Best cosine to a bank over the best to its background."""
    return best(cos, bank) - best(cos, background)


@dataclass(frozen=True)
class Fit:
    """p = 1 / (1 + exp(-(slope * margin + bias)))."""

    slope: float
    bias: float

    def p(self, m: Column) -> Column:
        return sigmoid(self.slope * m + self.bias)


def escalation(df: DataFrame, down: Bank, down_bg: Bank, danger: Bank, danger_bg: Bank, fits: tuple[Fit, Fit], taus: tuple[float, float], danger_alone: bool = False) -> DataFrame:
    """Two-signal escalation: the first signal is the score and fires review, both together alert; the second alone fires only if
    asked for. The signals are never blended."""
    c = F.col("cos")
    p, pd = fits[0].p(margin(c, down, down_bg)), fits[1].p(margin(c, danger, danger_bg))
    tier = F.when((p >= taus[0]) & (pd >= taus[1]), "alert").when(p >= taus[0], "review")
    tier = tier.when(pd >= taus[1], "review") if danger_alone else tier
    return df.select("id", p.alias("p"), pd.alias("p_danger"), tier.otherwise("none").alias("tier"))


def worst_of(df: DataFrame, severe: Bank, violent: Bank, context: Bank, background: Bank, names: Sequence[str], fit: Fit, taus: tuple[float, float, float]) -> DataFrame:
    """The worse of two margins over one background, banded by alert, violation and review thresholds; the margin of innocent
    context is reported beside it and decides nothing."""
    c = F.col("cos")
    sev, vio, ctx = (margin(c, b, background) for b in (severe, violent, context))
    p = fit.p(F.greatest(sev, vio))
    tier = band(p, list(zip(("alert", "violation", "review"), taus)))
    return df.select("id", p.alias("p"), sev.alias("margin_severe"), vio.alias("margin_violent"), ctx.alias("margin_context"), which(c, violent, names).alias("concept"), tier.alias("tier"))


def two_bank(df: DataFrame, main: Bank, second: Bank, background: Bank, names: Sequence[str], fit: Fit, taus: tuple[float, float], lead: float, cap_rows: int, benign: Bank = (), benign_names: Sequence[str] = ()) -> DataFrame:
    """Two banks that look alike: violation only if the main bank clears its threshold and leads the second by `lead`; what loses,
    or clears the second's threshold, is for review. p is capped by the evidence, cap_rows fitting rows."""
    c = F.col("cos")
    m, mr = margin(c, main, background), margin(c, second, background)
    p, pr = capped(fit.p(m), cap_rows), capped(fit.p(mr), cap_rows)
    tier = F.when((p >= taus[0]) & (m >= mr + lead), "violation").when((pr >= taus[1]) | (p >= taus[0]), "review").otherwise("none")
    near = which(c, benign, benign_names) if len(benign) else F.lit(None).cast("string")
    return df.select("id", p.alias("p"), pr.alias("p_review"), tier.alias("tier"), which(c, main, names).alias("concept"), near.alias("nearest_benign"))


def review_only(df: DataFrame, groups: dict[str, Bank], negatives: Bank, fit: Fit, tau: float) -> DataFrame:
    """A queue for people: review where the margin clears tau, in margin space, with the sub-category of the closest concept."""
    c = F.col("cos")
    bank = [i for b in groups.values() for i in b]
    m = margin(c, bank, negatives)
    label = which(c, bank, [g for g, b in groups.items() for _ in b])
    return df.select("id", fit.p(m).alias("p"), m.alias("margin"), F.when(m >= tau, "review").otherwise("none").alias("tier"), label.alias("subcategory"))


def fitted_track(df: DataFrame, roles: dict[str, Bank], background: Bank, taus: dict[str, float], fit: Fit) -> DataFrame:
    """Tiers of a fitted track: the role whose margin exceeds its threshold most, if any does; of equal ones the first in roles."""
    c = F.col("cos")
    over = F.array(*[margin(c, b, background) - taus[r] for r, b in roles.items()])
    pick = F.element_at(F.array(*[F.lit(r) for r in roles]), F.array_position(over, F.array_max(over)).cast("int"))
    ps = F.array(*[fit.p(margin(c, b, background)) for b in roles.values()])
    p = F.element_at(ps, F.array_position(over, F.array_max(over)).cast("int"))
    return df.select("id", F.when(F.array_max(over) >= 0, pick).otherwise("none").alias("tier"), pick.alias("picked"), p.alias("p"))


def person_confidence(p1: Column, p2: Column, n_persons: Column, n_faces: Column, face: Column) -> Column:
    """Confidence of a person count by what decided it: faces if they carry the count, else the cascade's own probability."""
    by_faces = F.greatest(face, F.when(n_persons >= 1, p1).otherwise(1 - p1))
    by_cascade = F.when(n_persons == 0, 1 - p1).when(n_persons == 1, F.greatest(p1 - p2, F.lit(0.0))).otherwise(p2)
    return F.when((n_faces > 0) & (n_persons == n_faces), by_faces).otherwise(by_cascade)


def verdict(detections: DataFrame, tiers: DataFrame, ident: str = "id") -> DataFrame:
    """Verdict of each item over its detections (ident, cls, p): the highest tier that any class reaches, and the best p of each
    class with a tier, best first. tiers: (cls, tier, severity), small; classes without entry have tier none."""
    known = detections.join(F.broadcast(tiers), "cls", "left").withColumn("severity", F.coalesce("severity", F.lit(0))).withColumn("tier", F.coalesce("tier", F.lit("none")))
    per = known.groupBy(ident, "cls").agg(F.max("p").alias("p"), F.max("severity").alias("severity"), F.max("tier").alias("tier"))
    part = F.struct((-F.col("p")).alias("o"), "cls")
    got = per.groupBy(ident).agg(F.max_by("tier", "severity").alias("tier"), F.sort_array(F.collect_list(F.when(F.col("severity") > 0, part))).alias("s"))
    return got.select(ident, "tier", F.array_join(F.transform("s", lambda x: x.cls), ",").alias("subcategories"))


def records(items: DataFrame, parts: dict[str, tuple[Column, Column]], ident: str = "id") -> DataFrame:
    """One raw record of each item and a chip for each part that applies: parts gives (applies, p). 1-to-N without Python."""
    raw = F.struct(F.lit("raw").alias("kind"), F.lit(None).cast("double").alias("p"))
    chips = [F.when(on, F.struct(F.lit(name).alias("kind"), p.cast("double").alias("p"))) for name, (on, p) in parts.items()]
    return items.select(ident, F.explode(F.array_compact(F.array(raw, *chips))).alias("r")).select(ident, "r.kind", "r.p")
