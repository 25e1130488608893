import json
import struct

import numpy as np
import pytest

from pointweave.sources import artifacts as art
from pointweave.sources import readers as rd


def test_arrays(spark, tmp_path):
    v = np.arange(12, dtype=np.float32).reshape(3, 4)
    np.save(tmp_path / "a_f.npy", v)
    got = rd.npy_vectors(spark, f"{tmp_path}/*_f.npy").orderBy("row").collect()
    assert [r["vec"] for r in got] == v.tolist()
    np.save(tmp_path / "a_s.npy", np.array([[[0, -1], [2, 3]], [[-1, -1], [-1, 5]]], np.int32))
    got = rd.npy_raster(spark, f"{tmp_path}/*_s.npy", 1).collect()
    assert [(r["px"], r["py"], r["seg_id"]) for r in got] == [(1, 1, 5)]
    (tmp_path / "d.bin").write_bytes(b"2&1&1&" + np.array([1.5, 2.5], "<f4").tobytes())
    assert sorted((r["px"], r["value"]) for r in rd.colmap_array(spark, f"{tmp_path}/d.bin").collect()) == [(0, 1.5), (1, 2.5)]


@pytest.mark.parametrize("form", ["ascii", "binary_little_endian", "binary_big_endian"])
def test_ply(spark, tmp_path, form):
    rows = [(0.5, 1.5, -2.0, 7), (1.0, 2.0, 3.0, 255)]
    head = f"ply\nformat {form} 1.0\nelement vertex 2\nproperty float x\nproperty float y\nproperty float z\nproperty uchar red\nend_header\n"
    body = "\n".join(" ".join(map(str, r)) for r in rows).encode() if form == "ascii" else b"".join(struct.pack(("<" if "little" in form else ">") + "fffB", *r) for r in rows)
    (tmp_path / "p.ply").write_bytes(head.encode() + body)
    got = rd.ply_points(spark, f"{tmp_path}/p.ply").orderBy("gid").collect()
    assert [tuple(r["props"][k] for k in ("x", "y", "z", "red")) for r in got] == rows


def test_colmap(spark, tmp_path):
    (tmp_path / "cameras.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<iiQQ", 1, 1, 640, 480) + struct.pack("<4d", 500, 510, 320, 240))
    image = lambda i, n: struct.pack("<idddddddi", i, 1, 0, 0, 0, 0.1, 0.2, 0.3, 1) + n + b"\0" + struct.pack("<Q", 1) + bytes(24)
    (tmp_path / "images.bin").write_bytes(struct.pack("<Q", 2) + image(1, b"b.jpg") + image(2, b"a.jpg"))
    (tmp_path / "points3D.bin").write_bytes(struct.pack("<Q", 1) + struct.pack("<QdddBBBd", 9, 1, 2, 3, 10, 20, 30, 0.5) + struct.pack("<Q", 2) + bytes(16))
    images, cams = rd.colmap_images(spark, f"{tmp_path}/images.bin"), rd.colmap_cameras(spark, f"{tmp_path}/cameras.bin")
    present = spark.createDataFrame([("a.png",)], "name string")
    got = rd.cameras(images, cams, present).collect()
    assert [r["name"] for r in got] == ["a.jpg"] and abs(got[0]["fovx"] - 2 * np.arctan(640 / 1000)) < 1e-9
    p = rd.colmap_points(spark, f"{tmp_path}/points3D.bin").first()
    assert (p["gid"], p["xyz"], p["rgb"], p["track_length"]) == (9, [1, 2, 3], [10, 20, 30], 2)
    (tmp_path / "cameras.txt").write_text("# head\n1 SIMPLE_PINHOLE 640 480 500 320 240\n")
    assert rd.colmap_cameras_text(spark, f"{tmp_path}/cameras.txt").first()["params"] == [500, 320, 240]
    (tmp_path / "points3D.txt").write_text("5 1 2 3 9 8 7 0.25 1 2 3 4\n")
    assert rd.colmap_points_text(spark, f"{tmp_path}/points3D.txt").first()["track_length"] == 2
    (tmp_path / "images.txt").write_text("1 1 0 0 0 .1 .2 .3 1 a.jpg\n1.0 2.0 -1\n")
    assert rd.colmap_images_text(spark, f"{tmp_path}/images.txt").first()["name"] == "a.jpg"


def test_json_and_text(spark, tmp_path):
    doc = {"info": {"name": "f.jpg", "width": 4, "height": 4}, "objects": [{"category": " cup ", "segmentation": [[0, 0], [1, 0], [0, 1]]}, {"category": "x", "segmentation": [[0, 0]]}]}
    (tmp_path / "l.json").write_text(json.dumps(doc, indent=1))
    got = rd.labels(spark, f"{tmp_path}/l.json").collect()
    assert [(r["image"], r["category"]) for r in got] == [("f.jpg", "cup")]
    (tmp_path / "transforms_train.json").write_text(json.dumps({"camera_angle_x": 0.7, "w": 100, "h": 50, "fl_y": 80.0, "frames": [{"file_path": "a", "transform_matrix": np.eye(4).tolist()}]}))
    t = rd.transforms(spark, f"{tmp_path}/transforms_*.json").first()
    assert t["fovx"] == 0.7 and abs(t["fovy"] - 2 * np.arctan(50 / 160)) < 1e-9 and t["c2w"][1][1] == -1
    (tmp_path / "0.txt").write_text("1 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    (tmp_path / "1.txt").write_text("inf 0 0 0\n0 1 0 0\n0 0 1 0\n0 0 0 1\n")
    assert [(r["frame"], r["test"]) for r in rd.scannet_poses(spark, f"{tmp_path}/[01].txt").collect()] == [(0, True)]
    m = tmp_path / "m" / "ramen" / "base"
    m.mkdir(parents=True)
    (m / "metrics.json").write_text(json.dumps({"threshold_summary": [{"threshold": 0.5, "miou": 0.4}]}))
    assert tuple(rd.metrics(spark, f"{tmp_path}/m").first()) == ("ramen", "base", 0.5, 0.4)
    want = spark.createDataFrame([("metrics.json",), ("gone.json",)], "name string")
    assert [r["name"] for r in rd.missing_inputs(want, spark, f"{tmp_path}/m").collect()] == ["gone.json"]


def test_artifacts(spark, tmp_path):
    root = f"file://{tmp_path}"
    codes = spark.createDataFrame([(0, [1.0])], "code_id bigint, vec array<double>")
    ids = spark.createDataFrame([(7, 0), (8, 3)], "gid bigint, code_id bigint")
    art.save(codes, root, "x", "codes")
    with pytest.raises(Exception, match="exist"):
        art.save(codes, root, "x", "codes")
    art.register(spark, root, "x", "shared", {"k": 1}, {"bytes": 8}, {"cos": 0.9})
    assert art.load(spark, root, "x", "codes", "code_id bigint").count() == 1
    with pytest.raises(ValueError, match="lacks"):
        art.load(spark, root, "x", "codes", "nothing int")
    assert [r["gid"] for r in art.integrity(ids, codes).collect()] == [8]
    with pytest.raises(ValueError):
        art.remount(ids, codes)
