import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import leak, mix, quality

DOC = "doc_id long, text string, source string, junk int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 0) for i, t, s in rows], DOC)


def test_speech_words():
    t = "﻿WEBVTT\r\n\r\n1\r\n00:01 --> 00:02\r\nMARY ANN: <i>Hello</i> [DOOR\r\nCREAKS] big {\\an8}World\r\n\r\n2\n00:03 --> 00:04\n- BOB: café 42 (sighs) it's"
    assert leak.speech_words(t) == ["hello", "big", "world", "café", "it", "s"]
    assert leak.speech_words(None) == [] and leak.speech_words("") == []


def test_leaks_match_brute_force(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    items = [(i, " ".join(rng.choice(vocab, 20))) for i in range(40)] + [(90, "too short"), (91, None), (92, ""), (None, "x")]
    rows = []
    for d in range(120):
        w = list(rng.choice(vocab + ["the", "zz"], 150))
        if d % 3 == 0:
            it = items[int(rng.integers(40))][1].split()
            n = int(rng.integers(6, 12))
            s, at = int(rng.integers(0, 20 - n)), int(rng.integers(0, 140))
            w[at : at + n] = it[s : s + n]
        rows.append((d, " ".join(w).title(), "s"))
    rows += [(500, None, "s"), (501, "", "s"), (502, "word " * 200_000, "s"), (503, rows[0][1], None), (503, rows[0][1], None)]
    got = {tuple(r) for r in leak.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, item_text string")).collect()}
    grams = lambda ws: {tuple(ws[i : i + 8]) for i in range(len(ws) - 7)}
    ig = {i: grams(leak.words_of(t)) for i, t in items if i is not None and t}
    want = {(d, i) for d, t, _ in rows if t for i, g in ig.items() if g & grams(leak.speech_words(t))}
    assert got == want and len(want) > 10
    empty = spark.createDataFrame([], "item_id long, item_text string")
    assert leak.leaks(docs(spark, rows[:3]), empty).count() == 0 and leak.leaks(docs(spark, []), empty).count() == 0


def test_stats_and_rules(spark):
    rows = [(1, None, ""), (2, "", ""), (3, "1\n00:01 --> 00:02\n<i>The cat.</i>\n", ""), (4, "§$%&/ a", ""), (5, "abc def ghi\r\nxyz", "")]
    got = {r.doc_id: r for r in quality.text_stats(docs(spark, rows), ["the", "The", "def"]).collect()}
    assert got[1].n_words == 0 and got[2].mean_word_len is None
    assert (got[3].n_lines, got[3].n_words, got[3].end_share, got[3].common_share) == (1, 2, 1.0, 0.5)
    assert got[4].nonletter_share == pytest.approx(5 / 6)
    assert got[5].words_per_line == 2.0 and got[5].common_share == 0.25
    with pytest.raises(ValueError):
        quality.text_stats(docs(spark, rows), [f"w{i}" for i in range(quality.MAX_WORDS + 1)])


def test_rule_learning():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 6))
    x[rng.random(4000) < 0.05, 1] = np.nan
    with np.errstate(invalid="ignore"):
        y = (x[:, 1] < 0.3) | ((x[:, 4] < 0.4) & (x[:, 5] > 0.8))
    rules = quality.irep(x, y, quality.FEATURES)
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= quality._covers(r, x, quality.FEATURES)
    assert (hit == y).mean() > 0.995
    assert any("common_share < 0.3" == c.sql() for r in rules for c in r)
    fresh = rng.random((4000, 6))
    truth = (fresh[:, 1] < 0.3) | ((fresh[:, 4] < 0.4) & (fresh[:, 5] > 0.8))
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= quality._covers(r, fresh, quality.FEATURES)
    assert (hit == truth).mean() > 0.99  # held out
    assert quality.irep(x, np.zeros(4000, bool), quality.FEATURES) == [] and quality.irep(x[:0], y[:0], quality.FEATURES) == []
    assert quality.case_sql([]) == "0"
    assert quality.round_cut(0.298, 0.3012, True) == 0.3 and quality.round_cut(10.4, 9.7, False) == 10.0


def test_pivotal_keeps_mass_and_expectation():
    rng = np.random.default_rng(0)
    t = rng.integers(1, 100, 50).astype(float)
    p = np.full(50, 0.37)
    total = np.zeros(50)
    for s in range(400):
        out, carry = mix.pivotal(p, t, np.random.default_rng(s))
        frac = [i for i in range(50) if 0 < out[i] < 1]
        assert len(frac) <= 1 and (carry == -1 or frac == [carry])
        assert out @ t == pytest.approx(p @ t)
        total += out
    assert abs(total / 400 - 0.37).max() < 0.12
    assert mix.pivotal(np.array([]), np.array([]), rng)[1] == -1


def test_mixture(spark):
    text = lambda n: "word " * n
    rows = [(i, text(5 + i % 40), "Big " if i % 2 else "big") for i in range(300)] + [(1000 + i, text(20), "small") for i in range(5)] + [(2000, "", "small"), (2001, None, "small"), (2002, text(9), None), (None, text(9), "small"), (2003, text(9), "other")]
    targets = spark.createDataFrame([("big", 700, 1), ("small", 200, 4), ("gone", 100, 2)], "source string, target_pm int, max_repeats int")
    copies, report = mix.mixture(docs(spark, rows).repartition(9), targets)
    got = {r["source"]: r for r in report.collect()}
    assert got["gone"].mixed_tokens == 0
    assert got["small"].mixed_tokens == 4 * got["small"].tokens and got["small"].most_copies == 4
    assert got["big"].most_copies <= 1
    want = got["small"].mixed_tokens * 3.5
    assert abs(got["big"].mixed_tokens - want) <= 45
    ids = [r.doc_id for r in copies.collect()]
    assert len(ids) == len(set(ids)) and not {2000, 2001, 2002, 2003, None} & set(ids)
    assert sum(r.copies * r.n_tokens for r in copies.collect()) == sum(r.mixed_tokens for r in report.collect())
    again = mix.mixture(docs(spark, rows).repartition(9), targets)[0]
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, copies.collect()))
    none, empty = mix.mixture(docs(spark, []), targets)
    assert none.count() == 0 and empty.count() == 3


def test_items_beyond_the_bound_are_refused_though_some_are_short(spark, monkeypatch):
    import pytest

    from lumenfold.llm import leak

    monkeypatch.setattr(leak, "MAX_ITEMS", 2)
    docs = spark.createDataFrame([(1, "a b c d e f g h")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "short"), (2, "i j k l m n o p"), (3, "q r s t u v w x"), (4, "a b c d e f g h")], "item_id long, item_text string").coalesce(1)
    with pytest.raises(ValueError):
        leak.leaks(docs, items).count()


def test_short_items_do_not_count_against_the_bound(spark, monkeypatch):
    monkeypatch.setattr(leak, "MAX_ITEMS", 20)
    words = [chr(97 + i // 26) + chr(97 + i % 26) + "x" for i in range(400)]
    long_ = [(i, " ".join(words[i * 17 : i * 17 + 12])) for i in range(20)]
    items = spark.createDataFrame([(1000 + i, "too short") for i in range(60)] + long_, "item_id long, item_text string").coalesce(1)
    rows = [(i, "before all " + t + " and after", "s") for i, t in long_]
    assert {tuple(r) for r in leak.leaks(docs(spark, rows), items).collect()} == {(i, i) for i in range(20)}


def test_rules_miss_no_labelled_document(spark):
    rng = np.random.default_rng(4)
    x = rng.random((3000, 6))
    x[:, 0] = rng.integers(0, 50, 3000)
    stats = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], "doc_id long, " + ", ".join(f"{c} double" for c in quality.FEATURES))
    label = (F.col("common_share") < 0.03) | (F.col("mean_word_len") > 0.99) | ((F.col("n_words") == 7) & (F.col("end_share") < 0.4))
    rules, ruled = quality.fit_rules(stats, label, fit_rows=150)  # rare kinds are not in the first sample
    assert ruled.where(label).where("rule = 0").count() == 0 and len(rules) >= 2
    assert ruled.where("rule = -1").count() <= 3
