import numpy as np
import pytest

from lumenfold.operators import finder
from lumenfold.operators.lifecycle import Library, TrackStore
from lumenfold.operators.quality import top_neighbours
from lumenfold.operators.store import Table, UnknownDataset

NAMES = ["cat", "dog", "car", "red car"]
TAGS = finder.TagTable(NAMES, np.eye(4), {"cat": (-12.0, 1.2, 0.5)}, {}, {"animal": ["cat", "dog"], "dog": ["puppy", "animal"]})


class One:
    def embed_texts(self, texts):
        return np.eye(4)[[3] * len(texts)]


def items(spark, rows):
    return spark.createDataFrame(rows, "id long, ds int, e array<double>, extra string, tag string")


def test_plans():
    assert TAGS.below("animal") == ["animal", "cat", "dog", "puppy"]
    p = finder.plan(TAGS, "my cat")
    assert p.cands == [(0, "exact")] and not p.use_text and p.groups == []
    assert finder.plan(TAGS, "car").use_text  # named, but not calibrated
    assert [t for t, _ in finder.plan(TAGS, "red car dog").groups] == ["red car", "dog"]
    assert finder.plan(TAGS, "a red sports car at night").groups == []
    assert finder.plan(TAGS, '"red car" animal').groups == [("red car", [3]), ("animal", [0, 1])]
    assert finder.plan(None, "x", "never").use_text is False
    with pytest.raises(ValueError):
        finder.plan(TAGS, "x", "sometimes")


def test_search_edges(spark):
    rows = [(1, 0, [0.9, 0.1, 0.0, 0.0], "a", "t"), (2, 0, [0.9, 0.1, 0.0, 0.0], "b", "t"), (3, 1, None, "c", None), (4, 1, [0.0, 0.0, 0.0, 1.0], None, "t")]
    it = items(spark, rows)
    got = finder.search(it, TAGS, "cat", One(), 10).collect()
    assert [r.id for r in got] == [1, 2] and got[0].extra == "a" and got[0].path == "tag"  # ties by id; null vectors are no hits
    assert [r.id for r in finder.search(it, TAGS, "unheard of words", One(), 10).collect()] == [4]
    assert finder.search(it.limit(0), TAGS, "cat", One(), 10).count() == 0
    s = finder.summary(it, TAGS, "unheard of words", One(), text="never").first()
    assert s.no_match and s.text_path == "skipped"
    with pytest.raises(ValueError):
        finder.search(it, TAGS, "cat", One(), 0)


def test_tag_table_of_another_model(spark, tmp_path):
    path = f"file://{tmp_path}/tags"
    assert finder.TagTable.load(path, spark, "m") is None
    TAGS.model_sha = "m"
    TAGS.save(path, spark)
    back = finder.TagTable.load(path, spark, "m")
    assert back.names == NAMES and back.fits == TAGS.fits and back.edges == TAGS.edges and np.allclose(back.vectors, TAGS.vectors)
    with pytest.raises(finder.ModelMismatch):
        finder.TagTable.load(path, spark, "other")
    with pytest.raises(ValueError):
        finder.TagTable([], np.zeros((0, 4))).save(path, spark)


def test_track_store_keeps_other_columns(spark, tmp_path):
    t = TrackStore(Table(spark, f"file://{tmp_path}/t"))
    t.create(spark.createDataFrame([(1, "a", 0.2), (2, "a", None), (1, "b", 0.9)], "id long, category string, p double"))
    old = t.column("b")
    t.swap("b", spark.createDataFrame([(1, "b", 0.1), (2, "b", 0.8)], "id long, category string, p double"))
    assert sorted((r.category, r.p) for r in t.read().where("p IS NOT NULL").collect()) == [("a", 0.2), ("b", 0.1), ("b", 0.8)]
    assert old.first().p == 0.9  # a pinned reader keeps its rows
    t.recount([("review", 0.5)])
    assert {(r.category, r.tier): r.n for r in t.counts().collect()} == {("a", "none"): 1, ("a", "unknown"): 1, ("b", "none"): 1, ("b", "review"): 1}
    with pytest.raises(UnknownDataset):
        t.column("c")


def test_library_refuses(spark, tmp_path):
    lib = Library(spark, f"file://{tmp_path}/lib")
    assert lib.listing().count() == 0
    rows = spark.createDataFrame([(1,)], "x int")
    lib.create("a", rows)
    lib.create("b", rows)
    for bad in (lambda: lib.rename("a", "b"), lambda: lib.delete("a"), lambda: lib.rename("none", "c")):
        with pytest.raises((FileExistsError, ValueError, LookupError)):
            bad()
    lib.delete("a", force=True)
    assert lib.names() == ["b"]


def test_top_neighbours_against_brute_force(spark):
    x = np.random.default_rng(1).normal(size=(60, 4))
    x[7] = x[3]  # a tie
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, e array<double>").repartition(5)
    got = {(r.q, r["rank"]): r.id for r in top_neighbours(df, df.where("id % 20 = 0"), "e", 3).collect()}
    for q in (0, 20, 40):
        want = [i for i in np.lexsort((np.arange(60), -np.round(x @ x[q], 12))).tolist() if i != q][:3]
        assert [got[(q, k)] for k in (1, 2, 3)] == want
