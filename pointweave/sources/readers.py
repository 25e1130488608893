"""File formats of scenes, as tables. Binary files come through ``binaryFile`` and are
decoded on the executors, one file a row; paths may lie in any store that Spark reads."""

from __future__ import annotations

import io
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.geometry import rotation
from pointweave.operators.order import numbered
from pointweave.operators.sample import every_nth

#: Camera models by number, with their parameter counts.
CAMERA_MODELS = {0: ("SIMPLE_PINHOLE", 3), 1: ("PINHOLE", 4), 2: ("SIMPLE_RADIAL", 4), 3: ("RADIAL", 5), 4: ("OPENCV", 8), 5: ("OPENCV_FISHEYE", 8), 6: ("FULL_OPENCV", 12), 7: ("FOV", 5), 8: ("SIMPLE_RADIAL_FISHEYE", 4), 9: ("RADIAL_FISHEYE", 5), 10: ("THIN_PRISM_FISHEYE", 12)}
#: Scalar types of PLY files.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _decoded(spark: SparkSession, path: str, decode: Callable[[str, bytes], Iterator[dict]], schema: str) -> DataFrame:
    """Rows of every file under ``path`` (a glob is fine)."""
    arrow = spark.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows: list[dict] = []
                for row in decode(name, content):
                    rows.append(row)
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_pylist(rows, arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, arrow)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def npy_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, vec): the rows of two-dimensional .npy arrays."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        a = np.load(io.BytesIO(content), allow_pickle=False)
        if a.ndim != 2:
            raise ValueError(f"{name}: two dimensions are needed, not {a.ndim}")
        for i, v in enumerate(a.astype(float)):
            yield {"path": name, "row": i, "vec": v.tolist()}

    return _decoded(spark, path, decode, "path string, row bigint, vec array<double>")


def npy_raster(spark: SparkSession, path: str, level: int) -> DataFrame:
    """(path, px, py, seg_id) of one level of [level, row, column] rasters; -1 is no row."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        a = np.load(io.BytesIO(content), allow_pickle=False)
        if a.ndim != 3 or not 0 <= level < a.shape[0]:
            raise ValueError(f"{name}: no level {level} in shape {a.shape}")
        for y, x in np.argwhere(a[level] >= 0):
            yield {"path": name, "px": int(x), "py": int(y), "seg_id": int(a[level, y, x])}

    return _decoded(spark, path, decode, "path string, px int, py int, seg_id bigint")


def ply_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, gid, props map): vertices of PLY files, ascii or binary of either order."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        head, _, body = content.partition(b"end_header\n")
        lines = head.decode("ascii").split("\n")
        form = next(x.split()[1] for x in lines if x.startswith("format"))
        count, props, inside = 0, [], False
        for x in map(str.split, lines):
            if x[:1] == ["element"]:
                inside = x[1] == "vertex"
                count = int(x[2]) if inside else count
            elif x[:1] == ["property"] and inside:
                props.append((x[-1], PLY_TYPES[x[1]]))
        if form == "ascii":
            rows = (line.split() for line in body.decode("ascii").split("\n")[:count])
            for i, r in enumerate(rows):
                yield {"path": name, "gid": i, "props": [(p, float(v)) for (p, _), v in zip(props, r, strict=False)]}
        else:
            order = "<" if "little" in form else ">"
            a = np.frombuffer(body, np.dtype([(p, order + k) for p, k in props]), count)
            for i, r in enumerate(a):
                yield {"path": name, "gid": i, "props": [(p, float(r[p])) for p, _ in props]}

    return _decoded(spark, path, decode, "path string, gid bigint, props map<string,double>")


def _names(f: io.BytesIO) -> str:
    out = bytearray()
    while (c := f.read(1)) not in (b"\0", b""):
        out += c
    return out.decode("utf-8")


def colmap_cameras(spark: SparkSession, path: str) -> DataFrame:
    """(camera_id, model, width, height, params) of binary camera files."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        f = io.BytesIO(content)
        for _ in range(struct.unpack("<Q", f.read(8))[0]):
            camera, model, width, height = struct.unpack("<iiQQ", f.read(24))
            kind, n = CAMERA_MODELS[model]
            yield {"camera_id": camera, "model": kind, "width": width, "height": height, "params": list(struct.unpack(f"<{n}d", f.read(8 * n)))}

    return _decoded(spark, path, decode, "camera_id int, model string, width bigint, height bigint, params array<double>")


def colmap_images(spark: SparkSession, path: str) -> DataFrame:
    """(image_id, quat, t, camera_id, name) of binary image files; 2D points are skipped."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        f = io.BytesIO(content)
        for _ in range(struct.unpack("<Q", f.read(8))[0]):
            v = struct.unpack("<idddddddi", f.read(64))
            image = _names(f)
            f.seek(24 * struct.unpack("<Q", f.read(8))[0], 1)
            yield {"image_id": v[0], "quat": list(v[1:5]), "t": list(v[5:8]), "camera_id": v[8], "name": image}

    return _decoded(spark, path, decode, "image_id int, quat array<double>, t array<double>, camera_id int, name string")


def colmap_points(spark: SparkSession, path: str) -> DataFrame:
    """(gid, xyz, rgb, error, track_length) of binary point files."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        f = io.BytesIO(content)
        for _ in range(struct.unpack("<Q", f.read(8))[0]):
            v = struct.unpack("<QdddBBBd", f.read(43))
            n = struct.unpack("<Q", f.read(8))[0]
            f.seek(8 * n, 1)
            yield {"gid": v[0], "xyz": list(v[1:4]), "rgb": list(v[4:7]), "error": v[7], "track_length": n}

    return _decoded(spark, path, decode, "gid bigint, xyz array<double>, rgb array<int>, error double, track_length bigint")


def colmap_array(spark: SparkSession, path: str) -> DataFrame:
    """(path, px, py, channel, value) of dense arrays: ``w&h&c&``, then column-major floats."""

    def decode(name: str, content: bytes) -> Iterator[dict]:
        w, h, c, body = content.split(b"&", 3)
        a = np.frombuffer(body, "<f4").reshape((int(w), int(h), int(c)), order="F")
        for (x, y, k), v in np.ndenumerate(a):
            yield {"path": name, "px": x, "py": y, "channel": k, "value": float(v)}

    return _decoded(spark, path, decode, "path string, px int, py int, channel int, value double")


def _text_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split(F.trim("value"), r"\s+").alias("p"))


def colmap_cameras_text(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("p")
    return _text_lines(spark, path).select(p[0].cast("int").alias("camera_id"), p[1].alias("model"), p[2].cast("long").alias("width"), p[3].cast("long").alias("height"), F.transform(F.slice(p, 5, F.size(p) - 4), lambda x: x.cast("double")).alias("params"))


def colmap_points_text(spark: SparkSession, path: str) -> DataFrame:
    p = F.col("p")
    number = lambda a, n, kind: F.transform(F.slice(p, a, n), lambda x: x.cast(kind))
    return _text_lines(spark, path).select(p[0].cast("long").alias("gid"), number(2, 3, "double").alias("xyz"), number(5, 3, "int").alias("rgb"), p[7].cast("double").alias("error"), F.floor((F.size(p) - 8) / 2).alias("track_length"))


def colmap_images_text(spark: SparkSession, path: str) -> DataFrame:
    """Image lines hold ten fields and a name; the lines of 2D points between them don't."""
    p = F.col("p")
    rows = _text_lines(spark, path).where((F.size(p) == 10) & p[9].rlike(r"[^0-9.+-]"))
    number = lambda a, n: F.transform(F.slice(p, a, n), lambda x: x.cast("double"))
    return rows.select(p[0].cast("int").alias("image_id"), number(2, 4).alias("quat"), number(6, 3).alias("t"), p[8].cast("int").alias("camera_id"), p[9].alias("name"))


def cameras(images: DataFrame, intrinsics: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """(name, quat, t, fovx, fovy, width, height, view_id): pinhole views whose image is
    there under any extension, in order of name; other models fail."""
    joined = images.join(F.broadcast(intrinsics), "camera_id")
    bad = joined.where(~F.col("model").isin("PINHOLE", "SIMPLE_PINHOLE"))
    if not bad.isEmpty():
        raise ValueError("only PINHOLE and SIMPLE_PINHOLE cameras can be read")
    stem = F.regexp_replace("name", r"\.[^.]*$", "")
    joined = joined.withColumn("stem", stem)
    if present is not None:
        joined = joined.join(present.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("stem")).distinct(), "stem", "left_semi")
    fx = F.col("params")[0]
    fy = F.when(F.col("model") == "PINHOLE", F.col("params")[1]).otherwise(fx)
    return joined.select("name", "quat", "t", (2 * F.atan(F.col("width") / (2 * fx))).alias("fovx"), (2 * F.atan(F.col("height") / (2 * fy))).alias("fovy"), "width", "height").orderBy("name")


#: Labels: one document an image.
LABELS = "info struct<name:string,width:int,height:int>, objects array<struct<category:string,segmentation:array<array<double>>>>"
#: Frames of a transforms document; intrinsics may be repeated per frame.
TRANSFORMS = "camera_angle_x double, camera_angle_y double, fl_x double, fl_y double, w int, h int, frames array<struct<file_path:string,transform_matrix:array<array<double>>,fl_x:double,fl_y:double>>"


def label_polygons(docs: DataFrame, column: str = "value") -> DataFrame:
    """(image, category, points): labelled polygons of three corners or more from JSON text;
    blank categories are left out."""
    d = docs.select(F.from_json(column, LABELS).alias("d")).select(F.col("d.info.name").alias("image"), F.explode("d.objects").alias("o"))
    rows = d.select("image", F.trim("o.category").alias("category"), F.transform("o.segmentation", lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))
    return rows.where((F.col("category") != "") & (F.size("points") >= 3))


def labels(spark: SparkSession, path: str) -> DataFrame:
    """:func:`label_polygons` of all files under ``path``; an error if there is none."""
    out = label_polygons(spark.read.text(path, wholetext=True))
    if out.isEmpty():
        raise ValueError(f"no label under {path}")
    return out


def transforms(spark: SparkSession, path: str, flip: bool = True) -> DataFrame:
    """(name, c2w, fovx, fovy): frames of transforms documents; a frame's own focal length
    goes before the document's, and that before the angle; y and z flip to look along +z."""
    d = spark.read.text(path, wholetext=True).select(F.from_json("value", TRANSFORMS).alias("d")).select("d.*").withColumn("f", F.explode("frames"))
    fov = lambda focal, side, angle: F.coalesce(2 * F.atan(F.col(side) / (2 * F.coalesce(F.col(f"f.{focal}"), F.col(focal)))), F.col(angle))
    sign = F.array(*map(F.lit, (1.0, -1.0, -1.0, 1.0) if flip else (1.0,) * 4))
    c2w = F.transform("f.transform_matrix", lambda row: F.zip_with(row, sign, lambda x, s: x * s))
    return d.select(F.col("f.file_path").alias("name"), c2w.alias("c2w"), fov("fl_x", "w", "camera_angle_x").alias("fovx"), fov("fl_y", "h", "camera_angle_y").alias("fovy"))


def scannet_poses(spark: SparkSession, path: str) -> DataFrame:
    """(frame, c2w, test): 4 x 4 text matrices by frame number; frames with infinite or
    missing values are skipped; every eighth is for testing."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_path", r"(\d+)\.[^./]*$", 1).cast("int").alias("frame"), F.transform(F.filter(F.split("value", r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double")).alias("c2w"))
    good = rows.where((F.size("c2w") == 16) & F.forall("c2w", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))))
    return every_nth(good, "frame")


def metrics(spark: SparkSession, path: str) -> DataFrame:
    """(method, scene, threshold, miou): metric documents anywhere under ``path``; scene and
    method are the last two folders."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "metrics.json").text(path, wholetext=True)
    d = rows.select(F.col("_metadata.file_path").alias("file"), F.from_json("value", "threshold_summary array<struct<threshold:double,miou:double>>").alias("d"))
    return d.select(F.regexp_extract("file", r"([^/]+)/[^/]+/metrics\.json$", 1).alias("scene"), F.regexp_extract("file", r"([^/]+)/metrics\.json$", 1).alias("method"), F.explode("d.threshold_summary").alias("t")).select("scene", "method", "t.threshold", "t.miou")


def missing_inputs(expected: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    """Expected relative paths that no file under ``path`` ends with."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"))
    return expected.join(found, F.expr("endswith(file, concat('/', name))"), "left_anti")


def open_scene(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The views of a scene by kind: colmap, transforms or scannet; by its folder if not given."""
    kind = kind or scene_kind(spark, path)
    if kind == "colmap":
        return cameras(colmap_images(spark, f"{path}/sparse/0/images.bin"), colmap_cameras(spark, f"{path}/sparse/0/cameras.bin"))
    if kind == "transforms":
        return transforms(spark, f"{path}/transforms_*.json")
    if kind == "scannet":
        return scannet_poses(spark, f"{path}/pose/*.txt")
    raise ValueError(f"no such scene kind: {kind}")


def resolve_images(frames: DataFrame, present: DataFrame) -> DataFrame:
    """Frames with ``image``: the file among ``present`` (name) that a frame's name means: itself,
    with .png where it has no extension, or with .jpg and .png the other way round; null if
    there is none."""
    named = F.when(F.col("name").rlike(r"\.[^./]+$"), F.col("name")).otherwise(F.concat("name", F.lit(".png")))
    other = F.when(F.lower(named).endswith(".png"), F.regexp_replace(named, r"(?i)\.png$", ".jpg")).when(F.lower(named).endswith(".jpg"), F.regexp_replace(named, r"(?i)\.jpg$", ".png"))
    files = present.select(F.col("name").alias("__file")).distinct()
    rows = frames.withColumn("__a", named).withColumn("__b", other)
    first = rows.join(files, F.col("__a") == F.col("__file"), "left").withColumn("image", F.col("__file")).drop("__file")
    both = first.join(files, F.col("image").isNull() & (F.col("__b") == F.col("__file")), "left")
    return both.withColumn("image", F.coalesce("image", "__file")).drop("__a", "__b", "__file")


def over_background(rgba: Column, white: bool) -> Column:
    """Colours of (r, g, b, a) in [0, 1] over white or black."""
    return F.transform(F.slice(rgba, 1, 3), lambda x: x * rgba[3] + (1.0 if white else 0.0) * (1 - rgba[3]))


def scene_kind(spark: SparkSession, path: str) -> str:
    """colmap, transforms or scannet, by what lies in the folder."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    has = lambda name: fs.exists(spark._jvm.org.apache.hadoop.fs.Path(folder, name))
    for name, kind in (("sparse", "colmap"), ("transforms_train.json", "transforms"), ("pose", "scannet")):
        if has(name):
            return kind
    raise ValueError(f"{path} is no scene of a known kind")


def camera_documents(views: DataFrame) -> DataFrame:
    """(id, document): what cameras.json says of views (name, quat, t, fovx, fovy, width, height):
    place and rotation in the world, and focal lengths; ids in order of the name."""
    r = rotation(F.col("quat"))
    # the world-to-camera rotation's transpose, and the centre -R't
    turned = [[r[3 * j + i] for j in range(3)] for i in range(3)]
    place = [-sum((turned[i][j] * F.col("t")[j] for j in range(3)), F.lit(0.0)) for i in range(3)]
    focal = lambda side, fov: F.col(side) / (2 * F.tan(F.col(fov) / 2))
    entry = F.struct(F.col("place").alias("id"), F.col("name").alias("img_name"), "width", "height", F.array(*place).alias("position"), F.array(*[F.array(*row) for row in turned]).alias("rotation"), focal("height", "fovy").alias("fy"), focal("width", "fovx").alias("fx"))
    return numbered(views, [F.col("name")]).select(F.col("place").alias("id"), F.to_json(entry).alias("document"))
