"""Artifact tables and their manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "artifact_id string, representation string, params map<string,string>, storage map<string,bigint>, metrics map<string,double>"


def save(df: DataFrame, root: str, artifact_id: str, table: str, force: bool = False) -> None:
    """One table of an artifact; what exists stays unless ``force``."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(f"{root}/{artifact_id}/{table}")


def load(spark: SparkSession, root: str, artifact_id: str, table: str, schema: str | None = None) -> DataFrame:
    """A stored table; with a schema, missing columns fail here."""
    df = spark.read.parquet(f"{root}/{artifact_id}/{table}")
    if schema:
        want = spark.createDataFrame([], schema).schema
        missing = [f.name for f in want if f.name not in df.columns]
        if missing:
            raise ValueError(f"{artifact_id}/{table} lacks {', '.join(missing)}")
        df = df.select(*[F.col(f.name).cast(f.dataType) for f in want])
    return df


def register(spark: SparkSession, root: str, artifact_id: str, representation: str, params: dict, storage: dict, metrics: dict) -> None:
    row = (artifact_id, representation, {k: str(v) for k, v in params.items()}, storage, {k: float(v) for k, v in metrics.items()})
    spark.createDataFrame([row], MANIFEST).write.mode("append").parquet(f"{root}/artifacts")


def remount(point_codes: DataFrame, new_codes: DataFrame) -> DataFrame:
    """Old ids over another dictionary: a join, nothing copied; ids must all be known."""
    unknown = point_codes.join(new_codes.select("code_id"), "code_id", "left_anti")
    if not unknown.isEmpty():
        raise ValueError("the new dictionary lacks codes that points refer to")
    return point_codes.join(new_codes, "code_id")


def integrity(point_codes: DataFrame, codes: DataFrame) -> DataFrame:
    """Rows that refer to codes outside the dictionary."""
    return point_codes.join(codes.select("code_id").distinct(), "code_id", "left_anti")


def at_time(dynamic: DataFrame, t: int) -> DataFrame:
    return dynamic.where(F.col("t") == t)


def to_json(params: dict) -> str:
    return json.dumps(params, sort_keys=True)


def save_metrics(grid: DataFrame, root: str, scene: str, method: str) -> str:
    """Writes an evaluation's (threshold, miou, ..) as the document that the metrics scan reads,
    and returns its path. A grid is as long as its list of thresholds."""
    spark = grid.sparkSession
    rows = grid.orderBy("threshold").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("threshold", *(c for c in grid.columns if c != "threshold")))).alias("threshold_summary"))).alias("d")).first()["d"]
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{scene}/{method}/metrics.json")
    out = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(path, True)
    try:
        out.write(bytearray(rows.encode()))
    finally:
        out.close()
    return path.toString()
