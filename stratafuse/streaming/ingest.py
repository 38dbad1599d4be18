"""Streaming ingest: frames that arrive as files are fused into a voxel table batch by batch.

Fusion is a sum, so each micro-batch writes its own partial sums under its batch number; a
batch that is replayed overwrites itself, and reading adds the partial sums up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratafuse.operators import fusion as U
from stratafuse.operators import scenes as S


def fuse_stream(spark: SparkSession, frames: DataFrame, folder: str, checkpoint: str):
    """Start a query that fuses a streaming frames table into ``folder``: rows with images (depth, and as they are known
    sigma, confidence, K, T_world_camera), or camera centres (ox, oy, oz) whose view of the fixed room is rendered."""

    def batch(df: DataFrame, number: int) -> None:
        rows = df if "depth" in df.columns else S.render_frames(df)
        part = U.voxel_samples(rows).groupBy("ix", "iy", "iz").agg(F.sum(F.round(F.col("s") * F.col("w") * 1e9).cast("long")).alias("sw"), F.sum(F.round(F.col("w") * 1e9).cast("long")).alias("w"))
        part.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return frames.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def fused(spark: SparkSession, folder: str) -> DataFrame:
    """The volume so far: ix, iy, iz, tsdf, weight."""
    rows = spark.read.parquet(folder).groupBy("ix", "iy", "iz").agg(F.sum("sw").alias("sw"), F.sum("w").alias("w"))
    return rows.select("ix", "iy", "iz", (F.col("sw") / F.col("w")).cast("float").cast("double").alias("tsdf"), (F.col("w") / 1e9).cast("float").cast("double").alias("weight"))
