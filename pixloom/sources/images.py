"""Images from tables, raw array files and archives of programs."""

from __future__ import annotations

from io import BytesIO

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import PACKED
from . import arrays


def gray(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 gray image for each embedding, as planes; a projection of the scan."""
    return gray_of(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def gray_of(embeddings: DataFrame) -> DataFrame:
    level = "cast(floor(least(greatest((cast(e as double) + 1) * 127.5D, 0), 255)) as int)"
    return embeddings.selectExpr("vec_id as image_id", "8 as w", "8 as h", f"array(transform(embedding, e -> {level})) as planes")


def rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 8x8 RGB image for each three embeddings, as planes; incomplete triples are dropped."""
    flat = gray(spark, sf_dir).selectExpr("image_id div 3 as image_id", "cast(image_id % 3 as int) as c", "planes[0] as p")
    by = flat.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("c", "p"))).alias("s")).where("size(s) = 3")
    return by.selectExpr("image_id", "8 as w", "8 as h", "transform(s, e -> e.p) as planes")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of gray clips: eight images a clip."""
    return gray(spark, sf_dir).selectExpr("image_id", "image_id div 8 as clip_id", "cast(image_id % 8 as int) as frame_no", "w", "h", "planes")


def tiled(spark: SparkSession, sf_dir: str, factor: int) -> DataFrame:
    """PACKED images of 8 * factor pixels a side: the RGB images, repeated in both directions."""
    small = packed(rgb(spark, sf_dir))

    def run(batches):
        for b in batches:
            data = [np.tile(np.frombuffer(d, np.uint8).reshape(8, 8, 3), (factor, factor, 1)).tobytes() for d in b.column(4).to_pylist()]
            n = b.num_rows
            side = pa.array([8 * factor] * n, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), side, side, b.column(3), pa.array(data, pa.binary())], names=b.schema.names)

    return small.mapInArrow(run, PACKED)


def packed(images: DataFrame) -> DataFrame:
    """planes -> PACKED by Arrow, without a shuffle."""

    def run(batches):
        for b in batches:
            rows = [np.array(p, np.uint8).T.tobytes() if p else b"" for p in b.column(3).to_pylist()]
            size = pa.array([len(p or ()) for p in b.column(3).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), size, pa.array(rows, pa.binary())], names=["image_id", "width", "height", "channels", "data"])

    return images.select(F.col("image_id").cast("long"), "w", "h", "planes").mapInArrow(run, PACKED)


def unpacked(images: DataFrame) -> DataFrame:
    """PACKED -> planes by Arrow."""

    def run(batches):
        for b in batches:
            rows = [np.frombuffer(d, np.uint8).reshape(-1, c).T.astype(np.int32).tolist() for d, c in zip(b.column(4).to_pylist(), b.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(rows, pa.list_(pa.list_(pa.int32())))], names=["image_id", "w", "h", "planes"])

    return images.select("image_id", "width", "height", "channels", "data").mapInArrow(run, "image_id long, w int, h int, planes array<array<int>>")


def parse_npy(data: bytes) -> np.ndarray:
    """An array of a .npy file of uint8, version 1 to 3."""
    h = arrays.head(BytesIO(data))
    if h.kind != np.uint8:
        raise TypeError("images are uint8")
    return np.frombuffer(data, np.uint8, offset=h.at).reshape(h.shape, order="F" if h.fortran else "C")


def channels_last(a: np.ndarray, layout: str = "hwc") -> np.ndarray:
    """(H, W) becomes one channel; chw becomes hwc."""
    if a.ndim == 2:
        a = a[:, :, None]
    if a.ndim != 3:
        raise ValueError("an image has two or three dimensions")
    a = a.transpose(1, 2, 0) if layout == "chw" else a
    if not 1 <= a.shape[2] <= 4:
        raise ValueError("an image has one to four channels")
    return np.ascontiguousarray(a)


def read_arrays(spark: SparkSession, path: str, layout: str = "hwc") -> DataFrame:
    """PACKED images and their path, from .npy files of uint8; image_id is the stored one, else a hash of the path (and the place in a stack)."""
    rows = arrays.read(spark, path, layout, dtype="uint8")
    hashed = F.when(F.col("item") == 0, F.xxhash64("path")).otherwise(F.xxhash64("path", "item"))
    return rows.select(F.coalesce("image_id", hashed).alias("image_id"), "width", "height", "channels", "data", "path")


def write_packed(images: DataFrame, path: str) -> None:
    images.write.mode("overwrite").parquet(path)


def read_packed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(path)


def write_programs(programs: DataFrame, path: str) -> None:
    """Sampled programs, one JSON text a row, beside their keys."""
    programs.write.mode("overwrite").parquet(path)
