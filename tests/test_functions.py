import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import calib as cal
from lumenfold.functions import text as tx
from lumenfold.functions.vector import cosine, dot, l2_normalise


def one(spark, expr, **cols):
    df = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).alias(k) for k, v in cols.items()])
    return df.select(expr.alias("x")).first()[0]


def test_vectors(spark):
    assert one(spark, dot("a", "b"), a=[1.0, 2.0], b=[3.0, 4.0]) == 11.0
    assert one(spark, l2_normalise("a"), a=[0.0, 0.0]) == [0.0, 0.0]
    assert one(spark, cosine("a", "b"), a=[2.0, 0.0], b=[1.0, 1.0]) == pytest.approx(math.sqrt(0.5))


def test_platt_null_and_clip(spark):
    s = F.col("s").cast("double")
    assert one(spark, cal.platt(s, -12.0, 6.0), s=1.0) == pytest.approx(0.9975, abs=1e-4)
    assert one(spark, cal.platt(s, -12.0, 6.0), s=None) is None
    assert one(spark, cal.platt(s, None, 6.0), s=1.0) is None
    assert 0 < one(spark, cal.platt(s, -1e9, 0.0), s=-1.0) < 1e-12


def test_band_and_arbitration(spark):
    rows = spark.createDataFrame([(0.95,), (0.5,), (0.05,), (None,)], "p double")
    got = [r[0] for r in rows.select(cal.band(F.col("p"), [("violation", 0.9), ("review", 0.4), ("alert", None)])).collect()]
    assert got == ["violation", "review", "none", "unknown"]
    rows = spark.createDataFrame([(0.30, 0.0), (0.30, 0.25), (-0.30, 0.30), (-0.30, -0.30), (None, 0.0)], "m double, r double")
    tier = cal.arbitrated(F.col("m"), F.col("r"), -10.0, 0.0, 0.5, 0.5, 0.1)
    assert [r[0] for r in rows.select(tier).collect()] == ["violation", "review", "review", "none", "unknown"]


def test_argmax_ties_rank_and_nan(spark):
    assert one(spark, cal.argmax_name(["a", "b"], [F.col("x"), F.col("y")]), x=1.0, y=1.0) == "a"
    assert one(spark, cal.tier_rank(F.col("t")), t="review") == 2
    assert one(spark, cal.tier_rank(F.col("t")), t="other") == 5
    assert one(spark, cal.clean_score(F.col("p")), p=float("nan")) is None
    lo, hi = cal.wilson(F.col("k"), F.col("n"))
    assert one(spark, lo, k=0, n=0) is None
    assert one(spark, cal.softmax(F.col("a")), a=[1000.0, 1000.0]) == [0.5, 0.5]
    assert one(spark, cal.count_confidence(F.col("k"), F.col("b")), k=[0.9, 0.8], b=0.5) == pytest.approx(0.4)


def test_terms(spark):
    assert tx.split_terms('red "big cat" and dog') == [("red", False), ("big cat", True), ("dog", False)]
    assert tx.split_terms("the of") == [("the of", True)]
    assert tx.split_terms("") == []
    assert tx.segment("big red dog".split(), {"big red", "dog", "red dog"}) == ["big red", "dog"]
    assert tx.segment("big cat".split(), {"big"}) is None
    assert one(spark, tx.normalise_name(F.col("n")), n="Fire_Truck (red)-Big") == "fire truck big"
    assert one(spark, tx.prompt(F.col("n")), n="owl") == "a photo of an owl."
    assert one(spark, tx.parse_pairs(F.col("p")), p=["a=1", " b = x=y ", "broken", "a=2"]) == {"a": "2", "b": "x=y"}
    assert tx.config_sha({"b": 1, "a": 2}) == tx.config_sha({"a": 2, "b": 1})


def test_running_counts_match_a_plain_window(spark):
    from lumenfold.operators.quality import auroc, average_precision, max_f1, running

    rng = np.random.default_rng(0)
    rows = [(int(i), int(i % 2), float(round(p, 2)), int(y)) for i, (p, y) in enumerate(zip(rng.random(500), rng.random(500) < 0.3))]
    df = spark.createDataFrame([*rows, (999, 0, None, 1), (998, 0, float("nan"), 1)], "id long, g int, p double, y int")
    for g in (0, 1):
        own = sorted((r for r in rows if r[1] == g), key=lambda r: (-r[2], r[0]))
        tp = np.cumsum([r[3] for r in own])
        got = {r["id"]: (r["rn"], r["tp"]) for r in running(df, ["g"]).where(F.col("g") == g).collect()}
        assert got == {r[0]: (i + 1, tp[i]) for i, r in enumerate(own)}
        ap = sum(t / (i + 1) for i, (t, r) in enumerate(zip(tp, own)) if r[3]) / tp[-1]
        assert average_precision(running(df, ["g"]), ["g"]).where(F.col("g") == g).first()["ap"] == pytest.approx(ap)
        pos, neg = [r[2] for r in own if r[3]], [r[2] for r in own if not r[3]]
        u = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
        assert auroc(df.where("NOT isnan(p)"), ["g"]).where(F.col("g") == g).first()["auroc"] == pytest.approx(u)
    assert max_f1(running(df.limit(0), ["g"]), ["g"]).count() == 0
    one_class = spark.createDataFrame([(1, 0, 0.5, 0)], "id long, g int, p double, y int")
    assert auroc(one_class, ["g"]).first()["auroc"] is None
    assert average_precision(running(one_class, ["g"]), ["g"]).first()["ap"] is None


def test_fits():
    from lumenfold.operators import fits

    rng = np.random.default_rng(1)
    s = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-3 * s))).astype(int)
    a, b = fits.platt_pair(s, y)
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    loss = lambda a, b: float(np.sum(t * (a * s + b) + np.logaddexp(0, -(a * s + b))))
    assert a < 0 and all(loss(a, b) <= loss(a + da, b + db) + 1e-9 for da in (-0.01, 0, 0.01) for db in (-0.01, 0, 0.01))
    assert all(v != v for v in fits.platt_pair(s, np.zeros(400)))
    ra, _ = fits.ridge_pair(s, y, 1.0)
    assert ra > fits.ridge_pair(s, y, 100.0)[0] > 0
    x = rng.normal(size=(400, 16))
    w, bias = fits.logistic(x, (x[:, 0] > 0).astype(int))
    assert (((x @ w + bias) > 0) == (x[:, 0] > 0)).mean() > 0.95
    boxes = np.array([[0, 0, 10, 10], [1, 1, 11, 11], [20, 20, 30, 30]], float)
    assert fits.suppress(boxes, np.array([0.5, 0.9, 0.1]), 0.4) == [1, 2]


def test_policy():
    assert cal.policy({"tau": 2, "tau_review": "x"}, 0.8, 0.5) == {"tau": 0.8, "tau_review": 0.5}
    assert cal.policy({"tau": 0.4}, 0.8, 0.5) == {"tau": 0.4, "tau_review": 0.2}
    with pytest.raises(ValueError):
        cal.policy({"taus": 1}, 0.8, 0.5)
