"""The sample store, inventories of folders, stored scores and reports made from them."""

import pytest
from pyspark.sql import functions as F

from gridlight.operators import harness
from gridlight.sources import store
from tests.test_harness import some_scans


def test_inventory_of_folders(spark, tmp_path):
    for part in ("bagel/train/good/rgb/000.png", "bagel/train/good/xyz/000.tiff", "bagel/test/hole/rgb/003.png", "bagel/test/hole/xyz/003.tiff", "bagel/test/hole/gt/003.png", "rope/test/good/rgb/001.png"):
        file = tmp_path / "root" / part
        file.parent.mkdir(parents=True, exist_ok=True)
        file.write_bytes(b"x")
    files = store.listing(spark, f"file://{tmp_path}/root")
    assert [r.category for r in store.categories(files).collect()] == ["bagel", "rope"]
    rows = {r.sample_id: r for r in store.samples(files).collect()}
    assert set(rows) == {"bagel_train_good_000", "bagel_test_hole_003", "rope_test_good_001"}
    hole, rope = rows["bagel_test_hole_003"], rows["rope_test_good_001"]
    assert (hole.label, hole.has_gt) == (1, True) and hole.raw_xyz.endswith("hole/xyz/003.tiff")
    assert (rope.label, rope.has_gt, rope.raw_xyz, rope.raw_gt) == (0, False, None, None)
    assert store.param_key(256, 20, 2.0) == "s256_so20-2p0"


def test_store_is_built_once(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([(f"s{k}", "ab"[k % 2], "train" if k < 3 else "test", k % 2, [True, k > 1], [0, k % 2]) for k in range(5)], "sample_id string, category string, split string, label int, valid array<boolean>, gt array<int>")
    assert not store.exists(spark, path)
    assert store.build(rows.where("sample_id < 's3'"), path, "real", "p1").count() == 3
    added = store.build(rows, path, "real", "p1")
    assert sorted(r.sample_id for r in added.collect()) == ["s3", "s4"]  # also after the write
    assert store.build(rows, path, "real", "p2").count() == 5
    loaded = store.load(spark, path).where("param_key = 'p1'")
    assert {r.sample_id: (r.n_valid, r.defect_frac) for r in loaded.collect()} == {f"s{k}": (1 + (k > 1), (k % 2) / 2) for k in range(5)}
    assert sorted(r.sample_id for r in store.select(loaded, "train", 0).collect()) == ["s0", "s2"]
    assert sorted(r.sample_id for r in store.select(loaded, cats=["b"]).collect()) == ["s1", "s3"]
    with pytest.raises(ValueError, match="no samples"):
        store.select(loaded, "val")
    assert store.channels(loaded.withColumn("v", F.array(F.lit(1))), ["gt", "v"]).where("size(x) = 3").count() == 5


def test_runs_without_undefined_metrics(spark, tmp_path):
    runs = spark.createDataFrame([("r1", {"a": 1.0, "b": float("nan"), "c": None})], "run_id string, metrics map<string,double>")
    store.log_run(runs, f"file://{tmp_path}/runs")
    assert store.load(spark, f"file://{tmp_path}/runs").first().metrics == {"a": 1.0}


def test_nested_columns_under_dotted_names(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('c', 2, 'd.e', 3)) as p, 4 as q")
    assert df.select(*store.flat(df, "x.")).first().asDict() == {"x.p.a": 1, "x.p.b.c": 2, "x.p.b.d.e": 3, "x.q": 4}


def test_specifications(spark, tmp_path):
    (tmp_path / "ok.json").write_text('{"type": "npu", "label": "L", "op_support": {"conv": "yes"}, "instances": [{"name": "n", "label": "N", "precisions": {"int8": 4.0}, "memory_model": "fixed", "capacity_mib": 8}]}')
    row = store.specs(spark, f"file://{tmp_path}/ok.json").first()
    assert (row.accelerator, row.type, row.op_support, row.capacity_mib) == ("n", "npu", {"conv": "yes"}, 8.0)
    (tmp_path / "odd.json").write_text('{"type": "npu", "instances": [{"name": "n", "weight": 1}]}')
    with pytest.raises(ValueError, match="weight"):
        store.specs(spark, f"file://{tmp_path}/odd.json")


def test_report_from_stored_scores(spark, tmp_path):
    _, df = some_scans(spark)
    path = f"file://{tmp_path}/scores"
    with pytest.raises(ValueError, match="no stored scores"):
        store.load_scores(spark, path, "r1")
    plain = lambda r: sorted(map(str, r.collect()))
    want = plain(harness.report(df, 10))
    other = df.withColumn("amap", F.transform("amap", lambda v: 1 - v))
    store.store_scores(other.select(*harness.SCORES), path, "r1")
    store.store_scores(df.select(*harness.SCORES), path, "r1")  # a rerun replaces the first
    store.store_scores(other.where("category = 'a'").select(*harness.SCORES), path, "r2")
    assert store.load_scores(spark, path, "r1").count() == df.count()
    assert plain(store.recomputed(spark, path, "r1", 10)) == want
    assert store.load_scores(spark, path, "r1", ["a"]).select("category").distinct().collect()[0].category == "a"
    store.store_scores(df.where("category = 'b'").select(*harness.SCORES), path, "r2")  # other categories don't stay behind
    assert {r.category for r in store.load_scores(spark, path, "r2").select("category").distinct().collect()} == {"b"}
