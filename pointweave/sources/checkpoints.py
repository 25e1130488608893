"""Tables that runs start from and end in: geometry, views, consensus, slots, payloads.

Each is a parquet table of rows in place of one tensor; readers name the columns that they
need, so scans are pruned, and say what is missing before anything runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pointweave.functions.geometry import sh_to_rgb
from pointweave.functions.vec import as_double, l2_normalize, norm, sigmoid
from pointweave.sources.artifacts import integrity

#: The columns of a geometry checkpoint; one with language has one more.
GEOMETRY = ("gid", "xyz", "features_dc", "features_rest", "scaling", "rotation", "opacity", "max_radius", "gradient", "seen")
LANGUAGE = "language_feature"
#: Fields that compact payloads must have.
PAYLOADS = {
    "consensus": ("gid", "feature", "total_w"),
    "split_consensus": ("gid", "feature", "total_w", "sa", "sb", "wa", "wb"),
    "shard": ("gid", "feature", "total_w", "mean_norm"),
    "query_bank": ("query_id", "vec"),
    "mode": ("gid", "candidate", "selected", "reliability"),
    "view_sums": ("view_index", "gid", "w", "s"),
}
SLIM = ("view_index", "image_name", "point_ids", "point_weights", "segment_ids")
#: Vertices of one PLY file.
PLY_ROWS = 1_000_000


def require(df: DataFrame, columns: tuple[str, ...], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks {', '.join(missing)}")
    return df


def payload(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """A payload of one of the known kinds, its required fields first."""
    df = require(spark.read.parquet(path), PAYLOADS[kind], kind)
    return df.select(*PAYLOADS[kind], *(c for c in df.columns if c not in PAYLOADS[kind]))


def geometry(spark: SparkSession, path: str) -> DataFrame:
    """A geometry checkpoint, with or without language, without the language column."""
    return require(spark.read.parquet(path), GEOMETRY, "geometry checkpoint").select(*GEOMETRY)


def appearance(points: DataFrame) -> DataFrame:
    """(gid, xyz, opacity, rgb, log_scale): activated opacity, colour of the lowest harmonics
    held in [0, 1], mean of the log scales."""
    rgb = F.transform("features_dc", lambda x: sh_to_rgb(x.cast("double")))
    mean = F.aggregate(as_double("scaling"), F.lit(0.0), lambda a, x: a + x) / F.size("scaling")
    return points.select("gid", "xyz", sigmoid("opacity").alias("opacity"), rgb.alias("rgb"), mean.alias("log_scale"))


def save_language(points: DataFrame, features: DataFrame, path: str, config: dict) -> None:
    """A checkpoint with the language column (gid, feature) and, beside it, how it was made;
    points without a feature have a zero vector."""
    width = features.select(F.size("feature").alias("n")).first()
    zero = F.transform(F.sequence(F.lit(1), F.lit(width["n"] if width else 1)), lambda _: F.lit(0.0))
    rows = points.select(*GEOMETRY).join(features.select("gid", as_double("feature").alias(LANGUAGE)), "gid", "left")
    rows.withColumn(LANGUAGE, F.coalesce(LANGUAGE, zero)).write.parquet(path)
    points.sparkSession.createDataFrame([(k, str(v)) for k, v in sorted(config.items())], "name string, value string").write.parquet(f"{path}_config")


def language(spark: SparkSession, path: str) -> DataFrame:
    """(gid, feature, valid): the language column; a zero vector is not valid."""
    df = require(spark.read.parquet(path), ("gid", LANGUAGE), "language checkpoint")
    return df.select("gid", F.col(LANGUAGE).alias("feature"), (norm(LANGUAGE) > 1e-8).alias("valid"))


def feature_source(rows: DataFrame, vec: str = "vec", mask: str | None = None) -> DataFrame:
    """Valid rows, by an explicit mask or a norm over 1e-8, with vectors of unit length."""
    valid = F.col(mask) if mask else norm(vec) > 1e-8
    return rows.where(valid).withColumn(vec, l2_normalize(vec))


def consensus_source(rows: DataFrame) -> DataFrame:
    """(gid, vec of unit length, capacity or null): rows with weight; a capacity is whole."""
    rows = require(rows, PAYLOADS["consensus"], "consensus")
    capacity = F.col("capacity").cast("int") if "capacity" in rows.columns else F.lit(None).cast("int")
    return rows.where("total_w > 0").select("gid", l2_normalize("feature").alias("vec"), capacity.alias("capacity"))


def save_views(rows: DataFrame, path: str) -> None:
    """View caches, one folder a view, so that a scan of some views reads no others."""
    rows.write.partitionBy("view_index").parquet(path)


def view_caches(spark: SparkSession, path: str, slim: bool = True, views: list[int] | None = None) -> DataFrame:
    """Rows of the views; ``slim``: only what linking needs. A view without pixels has no rows;
    at least one view must have some."""
    df = require(spark.read.parquet(path), SLIM, "view cache")
    if views is not None:
        df = df.where(F.col("view_index").isin(views))
    if df.isEmpty():
        raise ValueError("no view has any pixels")
    return df.select(*SLIM) if slim else df


def artifact_slots(base: DataFrame, overflow: DataFrame | None, codes: DataFrame, most: int) -> DataFrame:
    """(gid, slot, code_id, weight): base rows are slot 0 with full weight; overflow rows lie in
    slots 1 to ``most`` - 1. Ids outside the dictionary, points outside the base, slots
    beyond the bound and repeated slots are errors."""
    rows = base.select("gid", F.lit(0).alias("slot"), "code_id", F.lit(255).alias("weight"))
    if overflow is not None:
        if not overflow.where((F.col("slot") < 1) | (F.col("slot") >= most)).isEmpty():
            raise ValueError(f"overflow slots must lie in 1 to {most - 1}")
        if not overflow.join(base.select("gid").distinct(), "gid", "left_anti").isEmpty():
            raise ValueError("overflow refers to points outside the base")
        if not overflow.groupBy("gid", "slot").count().where("count > 1").isEmpty():
            raise ValueError("overflow holds a slot twice")
        rows = rows.unionByName(overflow.select("gid", F.col("slot").cast("int").alias("slot"), "code_id", F.col("weight").cast("int").alias("weight")))
    if not integrity(rows, codes).isEmpty():
        raise ValueError("slots refer to codes outside the dictionary")
    return rows


def stored_bytes(tables: dict[str, tuple[DataFrame, int]]) -> dict[str, int]:
    """Bytes of each table as exported, rows times declared width, and their total."""
    out = {name: df.count() * width for name, (df, width) in tables.items()}
    return out | {"total": sum(out.values())}


def ply_files(points: DataFrame, colour: Column | None = None, seed: int = 0) -> DataFrame:
    """(part, content): little-endian binary PLY files of (xyz array), up to PLY_ROWS vertices
    each. ``colour``: an array of three bytes; random by seed where there is none."""
    noise = F.array(*[F.floor(F.rand(seed + i) * 256).cast("int") for i in range(3)])
    rows = points.select(as_double("xyz").alias("xyz"), (noise if colour is None else F.coalesce(F.transform(colour, lambda x: x.cast("int")), noise)).alias("rgb"))
    kind = np.dtype([("p", "<f4", 3), ("n", "<f4", 3), ("c", "u1", 3)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, n, made = [], 0, 0

        def file() -> pa.RecordBatch:
            a = np.concatenate(held)
            head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(a)}\n" + "".join(f"property float {p}\n" for p in ("x", "y", "z", "nx", "ny", "nz")) + "".join(f"property uchar {p}\n" for p in ("red", "green", "blue")) + "end_header\n"
            return pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() * 4096 + made]), pa.array([head.encode() + a.tobytes()])], names=["part", "content"])

        for batch in batches:
            for i in range(0, batch.num_rows, PLY_ROWS):
                part = batch.slice(i, PLY_ROWS)
                a = np.zeros(part.num_rows, kind)
                a["p"], a["c"] = np.array(part.column(0).to_pylist()), np.array(part.column(1).to_pylist())
                if n + len(a) > PLY_ROWS:
                    yield file()
                    held, n, made = [], 0, made + 1
                held.append(a)
                n += len(a)
        if n:
            yield file()

    return rows.mapInArrow(run, "part bigint, content binary")
