"""Checkpoint tables: what they refuse, and round trips."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from pointweave.operators import fit
from pointweave.sources import artifacts as art
from pointweave.sources import checkpoints as ck
from pointweave.sources import readers as rd


def points(spark, n=6):
    rows = [(i, [float(i), 0.0, 1.0], [0.1, -9.0, 9.0], [0.0], [-1.0, -2.0, -3.0], [1.0, 0.0, 0.0, 0.0], 0.0, 2.0, 3.0, 1) for i in range(n)]
    return spark.createDataFrame(rows, "gid bigint, xyz array<double>, features_dc array<double>, features_rest array<double>, scaling array<double>, rotation array<double>, opacity double, max_radius double, gradient double, seen int")


def test_language_checkpoint(spark, tmp_path):
    p = points(spark)
    words = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0])], "gid bigint, feature array<double>")
    ck.save_language(p, words, f"file://{tmp_path}/c", {"level": 2, "a": "x"})
    assert [tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/c_config").orderBy("name").collect()] == [("a", "x"), ("level", "2")]
    back = {r["gid"]: r for r in ck.language(spark, f"file://{tmp_path}/c").collect()}
    assert len(back) == 6 and back[1]["valid"] and not back[2]["valid"] and back[0]["feature"] == [0.0, 0.0]
    geometry = ck.geometry(spark, f"file://{tmp_path}/c")
    assert ck.LANGUAGE not in geometry.columns
    look = ck.appearance(geometry).where("gid = 4").first()
    assert look["opacity"] == 0.5 and look["log_scale"] == -2.0 and look["rgb"][1:] == [0.0, 1.0] and abs(look["rgb"][0] - 0.528209479177) < 1e-9
    with pytest.raises(ValueError, match="lacks language_feature"):
        p.write.parquet(f"file://{tmp_path}/plain")
        ck.language(spark, f"file://{tmp_path}/plain")


def test_sources_keep_valid_rows(spark, tmp_path):
    rows = spark.createDataFrame([(1, [3.0, 4.0], 2.0), (2, [1.0, 0.0], 0.0)], "gid bigint, feature array<double>, total_w double")
    got = ck.consensus_source(rows).collect()
    assert [(r["gid"], r["vec"], r["capacity"]) for r in got] == [(1, [0.6, 0.8], None)]
    with pytest.raises(ValueError, match="lacks total_w"):
        ck.consensus_source(rows.drop("total_w"))
    rows.write.parquet(f"file://{tmp_path}/p")
    with pytest.raises(ValueError, match="shard lacks mean_norm"):
        ck.payload(spark, f"file://{tmp_path}/p", "shard")
    flat = spark.createDataFrame([(1, [0.0, 0.0], True), (2, [0.0, 2.0], False)], "gid bigint, vec array<double>, ok boolean")
    assert [r["gid"] for r in ck.feature_source(flat).collect()] == [2]
    assert [r["gid"] for r in ck.feature_source(flat, mask="ok").collect()] == [1]


def test_view_caches(spark, tmp_path):
    rows = spark.createDataFrame([(v, f"v{v}", [1, 2], [0.5, 0.5], s, "wide") for v in (0, 2) for s in range(3)], "view_index int, image_name string, point_ids array<bigint>, point_weights array<double>, segment_ids bigint, extra string")
    ck.save_views(rows, f"file://{tmp_path}/v")
    slim = ck.view_caches(spark, f"file://{tmp_path}/v")
    assert slim.columns == list(ck.SLIM) and slim.count() == 6
    assert ck.view_caches(spark, f"file://{tmp_path}/v", slim=False, views=[0, 1]).count() == 3
    with pytest.raises(ValueError, match="no view"):
        ck.view_caches(spark, f"file://{tmp_path}/v", views=[7])


def test_artifact_slots(spark):
    base = spark.createDataFrame([(1, 4), (2, 5)], "gid bigint, code_id bigint")
    codes = spark.range(4, 8).withColumnRenamed("id", "code_id")
    over = lambda *rows: spark.createDataFrame(rows, "gid bigint, slot int, code_id bigint, weight int")
    got = sorted(tuple(r) for r in ck.artifact_slots(base, over((2, 1, 7, 99)), codes, 3).collect())
    assert got == [(1, 0, 4, 255), (2, 0, 5, 255), (2, 1, 7, 99)]
    assert ck.artifact_slots(base, None, codes, 1).count() == 2
    for bad in ((2, 3, 7, 1),), ((2, 0, 7, 1),), ((9, 1, 7, 1),), ((2, 1, 99, 1),), ((2, 1, 7, 1), (2, 1, 6, 1)):
        with pytest.raises(ValueError):
            ck.artifact_slots(base, over(*bad), codes, 3)
    assert ck.stored_bytes({"ids": (base, 4), "codes": (codes, 16)}) == {"ids": 8, "codes": 64, "total": 72}


def test_ply_files_read_back(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ck, "PLY_ROWS", 1 << 20)
    files = ck.ply_files(points(spark, 50).coalesce(2), F.array(F.lit(7), F.lit(8), F.lit(255))).collect()
    for r in files:
        (tmp_path / f"{r['part']}.ply").write_bytes(r["content"])
    got = rd.ply_points(spark, f"{tmp_path}/*.ply").collect()
    assert sorted(r["props"]["x"] for r in got) == [float(i) for i in range(50)]
    assert {(r["props"]["red"], r["props"]["green"], r["props"]["blue"]) for r in got} == {(7.0, 8.0, 255.0)}


def test_growth_and_pruning(spark):
    p = points(spark, 1).drop("features_dc", "features_rest")
    big = fit.densify(p, 2.0, 0.1, 1.0, copies=2, seed=3).collect()
    assert [r["copy"] for r in big] == [1, 2] and np.allclose(big[0]["scaling"], np.array([-1.0, -2.0, -3.0]) - np.log(1.6))
    assert big[0]["xyz"] != big[1]["xyz"]
    assert sorted(r["copy"] for r in fit.densify(p, 2.0, 1.0, 1.0).collect()) == [0, 1]
    assert [r["copy"] for r in fit.densify(p, 4.0, 0.1, 1.0).collect()] == [0]
    assert fit.prune(p, 0.6, 1.0).count() == 0 and fit.prune(p, 0.4, 1.0).count() == 1
    assert fit.prune(p, 0.4, 100.0, 1.0).count() == 0 and fit.prune(p, 0.4, 1.0, 5.0).count() == 0 and fit.prune(p, 0.4, 100.0, 5.0).count() == 1
    assert abs(1 / (1 + np.exp(-fit.reset_opacity(p).first()["opacity"])) - 0.01) < 1e-12
    seen = spark.createDataFrame([(0, 3.0, 4.0), (0, 0.0, 1.0)], "gid bigint, gx double, gy double")
    r = fit.gradient_statistics(p, seen).first()
    assert (r["gradient"], r["seen"]) == (9.0, 3)
    lone = fit.initialise(spark.createDataFrame([(1, [0.0, 0.0, 0.0], [0.5, 0.5, 0.5])], "gid bigint, xyz array<double>, rgb array<double>"), 1.0).first()
    assert abs(lone["scaling"][0] - np.log(np.sqrt(1e-7))) < 1e-9 and lone["features_dc"] == [0.0] * 3


def test_images_of_frames(spark):
    frames = spark.createDataFrame([("a/1",), ("a/2.jpg",), ("a/3.png",), ("a/4",), ("b.c/5",)], "name string")
    present = spark.createDataFrame([("a/1.png",), ("a/2.png",), ("a/3.jpg",), ("b.c/5.jpg",)], "name string")
    got = {r["name"]: r["image"] for r in rd.resolve_images(frames, present).collect()}
    assert got == {"a/1": "a/1.png", "a/2.jpg": "a/2.png", "a/3.png": "a/3.jpg", "a/4": None, "b.c/5": "b.c/5.jpg"}
    px = spark.createDataFrame([([0.2, 0.4, 0.6, 0.5],)], "c array<double>")
    r = px.select(rd.over_background(F.col("c"), True).alias("w"), rd.over_background(F.col("c"), False).alias("b")).first()
    assert np.allclose(r["w"], [0.6, 0.7, 0.8]) and np.allclose(r["b"], [0.1, 0.2, 0.3])


def test_scene_kind_and_cameras(spark, tmp_path):
    for folder, kind in (("sparse", "colmap"), ("pose", "scannet")):
        (tmp_path / kind / folder).mkdir(parents=True)
        assert rd.scene_kind(spark, f"file://{tmp_path}/{kind}") == kind
    (tmp_path / "t").mkdir()
    with pytest.raises(ValueError, match="no scene"):
        rd.scene_kind(spark, f"file://{tmp_path}/t")
    (tmp_path / "t" / "transforms_train.json").write_text(json.dumps({"camera_angle_x": 0.7, "camera_angle_y": 0.5, "frames": [{"file_path": "a", "transform_matrix": np.eye(4).tolist()}]}))
    assert rd.open_scene(spark, f"file://{tmp_path}/t").first()["fovx"] == 0.7

    half = float(np.sqrt(0.5))  # a quarter turn about z
    views = spark.createDataFrame([("b.jpg", [half, 0.0, 0.0, half], [1.0, 2.0, 3.0], float(2 * np.arctan(0.5)), float(2 * np.arctan(0.25)), 640, 480), ("a.jpg", [1.0, 0.0, 0.0, 0.0], [1.0, 2.0, 3.0], 1.0, 1.0, 64, 48)], "name string, quat array<double>, t array<double>, fovx double, fovy double, width int, height int")
    docs = [json.loads(r["document"]) for r in rd.camera_documents(views).orderBy("id").collect()]
    assert [(d["id"], d["img_name"]) for d in docs] == [(0, "a.jpg"), (1, "b.jpg")]
    w2c = np.eye(4)
    w2c[:3, :3], w2c[:3, 3] = [[0, -1, 0], [1, 0, 0], [0, 0, 1]], [1, 2, 3]
    c2w = np.linalg.inv(w2c)
    assert np.allclose(docs[1]["position"], c2w[:3, 3]) and np.allclose(docs[1]["rotation"], c2w[:3, :3])
    assert abs(docs[1]["fx"] - 640) < 1e-9 and abs(docs[1]["fy"] - 960) < 1e-9


def test_metrics_round_trip(spark, tmp_path):
    grid = spark.createDataFrame([(0.2, 0.5, 3), (0.1, 0.4, 3)], "threshold double, miou double, n int")
    path = art.save_metrics(grid, f"file://{tmp_path}", "ramen", "base")
    assert path.endswith("ramen/base/metrics.json")
    got = sorted(tuple(r) for r in rd.metrics(spark, f"file://{tmp_path}").select("scene", "method", "threshold", "miou").collect())
    assert got == [("ramen", "base", 0.1, 0.4), ("ramen", "base", 0.2, 0.5)]
