import json
import time

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import ingest as ing
from lumenfold.operators.store import Conflict, Table, UnknownDataset
from lumenfold.sources import files
from lumenfold.plans.storage import Initials
from lumenfold.sources.pixels import apply_heads, embed, flat
from lumenfold.streaming import ingest as st


def test_versions_pin_refuse_and_recover(spark, tmp_path):
    t = Table(spark, f"file://{tmp_path}/t")
    with pytest.raises(UnknownDataset):
        t.read()
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "k long, e array<double>")
    assert t.create(rows) == 1
    pinned = t.read(1)
    assert t.append(spark.createDataFrame([(2, [1.0, 1.0]), (3, [1.0, 1.0])], rows.schema), "k", ("e", 2)) == 2
    assert pinned.count() == 2 and sorted(r.k for r in t.read().collect()) == [1, 2, 3]
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(4, [1.0]), (4, [1.0])], rows.schema), "k")
    with pytest.raises(ValueError):
        t.append(spark.createDataFrame([(4, [1.0])], rows.schema), "k", ("e", 2))
    with pytest.raises(Conflict):
        t._commit(1, [], "k long", {})
    rows.write.parquet(f"{tmp_path}/t/v=9-dead")
    assert t.read().count() == 3 and t.recover() == ["v=9-dead"]
    assert t.rewrite(t.read().where("k = 1")) == 3 and t.read().count() == 1 and t.read(2).count() == 3


def test_stream_replays_and_dedupes(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"h{i % 7}") for i in range(50)], "id long, h string")
    rows.repartition(5).write.parquet(f"{tmp_path}/in")
    t = Table(spark, f"file://{tmp_path}/out")
    for _ in range(2):  # the second run sees the same files from a fresh checkpoint
        src = st.stream(spark, f"{tmp_path}/in", "id long, h string", 2)
        st.ingest(src, t, "h", ["id"], f"{tmp_path}/cp", trigger={"availableNow": True}).awaitTermination()
    assert sorted(r.h for r in t.read().collect()) == [f"h{i}" for i in range(7)]


def test_rate_and_first_seen(spark, tmp_path):
    rows = spark.createDataFrame([("a", f"2025-01-01 00:00:{s:02d}") for s in (1, 2, 3, 20, 59)] + [("a", "2025-01-01 01:00:00")], "k string, ts string")
    rows.write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("k string, ts string").parquet(f"{tmp_path}/in")
    q = st.rate(src, "ts", "k", 10, 10, "1 second").writeStream.format("memory").queryName("rates").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {str(r["start"])[11:]: r["n"] for r in spark.table("rates").collect()}
    assert got["00:00:00"] == 3 and got["00:00:20"] == 1
    q = st.first_seen(src, "k", "ts").writeStream.format("memory").queryName("firsts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("firsts").count() == 1


def test_liveness(spark, tmp_path):
    spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, n long").write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("k string, n long").parquet(f"{tmp_path}/in")
    q = st.liveness(src, "k").writeStream.format("memory").queryName("alive").outputMode("append").start()
    end = time.time() + 60  # a processing-time timer never lets the query come to rest
    while spark.table("alive").count() < 2 and time.time() < end:
        time.sleep(0.5)
    q.stop()
    assert sorted((r.k, r.state) for r in spark.table("alive").collect())[:2] == [("a", "live"), ("b", "live")]


def test_dead_letters(spark):
    good, bad = st.dead_letters(spark.createDataFrame([(1, 0.5), (2, None), (3, 2.0)], "id long, p double"), {"null": F.col("p").isNotNull(), "range": F.col("p") <= 1})
    assert good.count() == 1 and {r.id: r.reason for r in bad.collect()} == {2: "null", 3: "range"}


def test_sources(spark, tmp_path):
    (tmp_path / "pics" / "a").mkdir(parents=True)
    for name in ("x.JPG", "notes.txt", "a/y.png"):
        (tmp_path / "pics" / name).write_bytes(name.encode())
    assert [r.path.rsplit("/", 1)[1] for r in files.scan(spark, f"{tmp_path}/pics").orderBy("path").collect()] == ["y.png", "x.JPG"]
    assert files.scan(spark, f"{tmp_path}/pics", recursive=False, content=True).select("image_id").first()[0].isalnum()
    (tmp_path / "m.csv").write_text("filename,who,empty\nx.JPG,ann,\n/abs/z.png,bob,1\n")
    got = {r.path: r.meta for r in files.meta_csv(spark, f"{tmp_path}/m.csv", "/root").collect()}
    assert got == {"/root/x.JPG": {"who": "ann"}, "/abs/z.png": {"who": "bob", "empty": "1"}}
    (tmp_path / "bad.csv").write_text("name\nx\n")
    with pytest.raises(ValueError):
        files.meta_csv(spark, f"{tmp_path}/bad.csv", "/")
    tree = {"LabelName": "Entity", "Subcategory": [{"LabelName": "Animal", "Subcategory": [{"LabelName": "Cat"}, {"LabelName": "Animal"}]}]}
    assert [tuple(r) for r in files.class_tree(spark, tree).collect()] == [("animal", "cat")]
    coco = {"images": [{"id": 1}], "categories": [{"id": 5, "name": "cat", "supercategory": "animal"}], "annotations": [{"image_id": 1, "category_id": 5}] * 2}
    (tmp_path / "i.json").write_text(json.dumps(coco))
    assert [tuple(r) for r in files.annotations(spark, f"{tmp_path}/i.json").collect()] == [(1, "cat", "animal")]
    lab = files.label_csv(spark.createDataFrame([("i", "a", "1"), ("i", "b", "0")], "ImageID string, LabelName string, Confidence string")).first()
    assert (lab.positive, lab.negative) == (["a"], ["b"])


def test_heads_are_isolated(spark):
    df = embed(spark.createDataFrame([(1, "apple"), (2, None)], "id long, t string"), "t", Initials)
    assert df.where("id = 2").first()["e"] is None and df.where("id = 1").first()["e"][0] == 1.0

    def broken(x):
        raise RuntimeError("no model")

    got = {r["head"]: (r.p, r.error) for r in apply_heads(df, "id", "e", {"ok": lambda x: x[:, 0], "bad": broken}).collect()}
    assert got["ok"] == (1.0, None) and got["bad"][0] is None and "no model" in got["bad"][1]
    import numpy as np

    assert flat(np.full((8, 8), 7)) and not flat(np.arange(64).reshape(8, 8) % 5 * 50)


def test_ingest_rules(spark):
    found = spark.createDataFrame([("a", 1.0, 5), ("b", None, 5), ("c", 1.0, 6)], "path string, mtime double, size long")
    known = spark.createDataFrame([("a", 1.0, 5), ("b", None, 5), ("c", 1.0, 5)], found.schema)
    assert [r.path for r in ing.unchanged(found, known).collect()] == ["c"]
    batch = spark.createDataFrame([(1, "x"), (2, "x"), (3, None), (4, "y"), (5, None)], "id long, h string")
    got = ing.new_rows(batch, spark.createDataFrame([("y",)], "h string"), "h", [F.asc("id")])
    assert sorted(r.id for r in got.collect()) == [1, 3, 5]
    assert ing.page(batch, ["id"], -3, 9999).count() == 5
    roots = ing.common_parent(spark.createDataFrame([("g", "/a/b/c.jpg"), ("g", "/a/b/d/e.jpg"), ("h", "/z/q.jpg")], "g string, p string"), "p", ["g"])
    assert {r.g: r.root for r in roots.collect()} == {"g": "/a/b", "h": "/z"}


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    q, s = e.queries(), e.oracle_sql()
    assert len(q) > 90 and set(s) <= set(q)
