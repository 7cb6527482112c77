import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import cutoff, topn

TRACK = "track_id long, dataset string, image_id string, category string, tier string, p double, extra int"


def tracks(spark, rows):
    return spark.createDataFrame(rows, TRACK)


def test_top_tracks_ties_copies_nulls_and_hot_group(spark):
    rows = [(1, "d", "b", " Cat", "None ", 0.5, 1), (1, "d", "b", "cat", "none", 0.5, 2), (2, "d", "a", "cat", "none", 0.5, 1), (3, "d", None, "cat", "none", 0.5, 1),
            (4, "d", "a", "cat", None, 0.9, 1), (5, "d", "a", "cat", "none", float("nan"), 1), (6, "d", "a", "cat", "none", 1.5, 1), (7, "d", "a", "cat", "none", None, 1), (None, "d", "a", "cat", "none", 0.9, 1),
            (8, None, "a", None, "none", 0.1, 1)]
    rows += [(100 + i, "hot", f"i{i % 50}", "cat", "none", (i % 97) / 100, 1) for i in range(3000)]
    got = topn.top_tracks(tracks(spark, rows), 2).collect()
    by = lambda d: [r.track_id for r in sorted((r for r in got if r.dataset == d), key=lambda r: r["rank"])]
    assert by("d") == [3, 2] and by(None) == [8]
    hot = sorted((r for r in rows if r[1] == "hot"), key=lambda r: (-r[5], r[2], r[0]))
    assert by("hot") == [r[0] for r in hot[:2]]
    assert topn.top_tracks(tracks(spark, []), 5).count() == 0
    with pytest.raises(ValueError):
        topn.top_n(tracks(spark, []), ["dataset"], [F.desc("p")], "track_id", 0)


def test_cutoffs_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cutoff, "BRACKET_SCORES", 8)  # several narrowing passes
    rng = np.random.default_rng(3)
    data = {"a": rng.random(2000), "b": np.round(rng.random(500), 1), "c": np.full(40, 0.25), "one": np.array([0.7]), "hot": rng.beta(2, 5, 6000)}
    targets = [(s, b, t) for s in [*data, "none"] for b, t in (("r", 100), ("v", 7), ("all", 1000), ("zero", 0), ("over", 1200))]
    rows = spark.createDataFrame([(s, float(v)) for s, vs in data.items() for v in vs], "source string, score double")
    rows = rows.union(spark.createDataFrame([("a", None), ("a", float("nan"))], rows.schema))
    got = {(r["source"], r["band"]): r for r in cutoff.cutoffs(rows, spark.createDataFrame(targets, "source string, band string, keep_pm int")).collect()}
    assert len(got) == len(targets)
    for s, b, t in targets:
        v = np.sort(data.get(s, np.array([])))[::-1]
        ok = [x for x in np.unique(v) if (v >= x).sum() * 1000 >= len(v) * t]
        r = got[(s, b)]
        if not ok:
            assert r["cutoff"] is None and r["n_kept"] == 0
        else:
            assert r["cutoff"] == max(ok) and r["n_kept"] == (v >= max(ok)).sum() and r["n_ties"] == (v == max(ok)).sum()


def test_weapons_rows_and_heads(spark):
    t = tracks(spark, [(1, "d", "a", "Weapons ", None, 0.9, 1), (2, "d", "a", "weapons", "x", 0.1, 1), (2, "d", "a", "weapons", "x", 0.1, 2), (3, "e", "a", "weapons", "x", 0.9, 1), (4, "d", "a", "drugs", "x", 0.9, 1)])
    h = spark.createDataFrame([("d", 500, None, "2025-01-01", "m")] * 2 + [("d", 900, None, "2024-01-01", "m"), ("z", 10, 10, None, "m")], "dataset string, keep_review_pm int, keep_violation_pm int, fitted_at string, model_id string")
    report, kept = cutoff.weapons_cutoffs(t, h)
    assert [(r.band, r.track_id) for r in kept.collect()] == [("review", 1)]
    assert {(r["source"], r.band): r.n_rows for r in report.collect()} == {("d", "review"): 2, ("z", "review"): 0, ("z", "violation"): 0}


def test_cutoffs_end_under_heavy_ties(spark, monkeypatch):
    monkeypatch.setattr(cutoff, "BRACKET_SCORES", 20)
    passes, stage = [], cutoff.stage

    def counted(df, name):
        passes.append(name)
        assert len(passes) < 16, "brackets do not narrow"
        return stage(df, name)

    monkeypatch.setattr(cutoff, "stage", counted)
    n, ties = 5_000, 50_000
    rows = spark.range(n + ties).select(F.lit("s").alias("source"), F.when(F.col("id") < ties, 0.0).otherwise((F.col("id") - ties + 1) / n).alias("score"))
    keep = [1, 45, 88, 90, 91, 1000]  # 88 in the thick of the scores, 90 beside the ties, from 91 on the ties
    targets = spark.createDataFrame([("s", str(k), k) for k in keep], "source string, band string, keep_pm int")
    got = {r["keep_pm"]: r for r in cutoff.cutoffs(rows, targets).collect()}
    for k in keep:
        need = -(-(n + ties) * k // 1000)
        want = (0.0, n + ties, ties) if need > n else ((n - need + 1) / n, need, 1)
        assert (got[k]["cutoff"], got[k]["n_kept"], got[k]["n_ties"]) == want
