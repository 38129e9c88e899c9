"""Row layouts of images.

packed   one image a row, channel-interleaved bytes: for Arrow kernels
planes   one image a row, one array of samples a channel: for Catalyst expressions
pixels   one sample a row: for joins, windows and SQL
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PACKED = "image_id long, width int, height int, channels int, data binary"
PLANES = "image_id long, w int, h int, planes array<array<int>>"
PIXELS = "image_id long, c int, y int, x int, v int"


def pixels(images: DataFrame) -> DataFrame:
    """planes -> pixels; no shuffle."""
    flat = images.select("image_id", "w", F.posexplode("planes").alias("c", "plane"))
    return flat.select("image_id", "w", "c", F.posexplode("plane").alias("p", "v")).selectExpr("image_id", "c", "cast(p div w as int) as y", "cast(p % w as int) as x", "v")


def planes(samples: DataFrame) -> DataFrame:
    """pixels -> planes; one shuffle by image."""
    by = samples.groupBy("image_id").agg(F.sort_array(F.collect_list(F.struct("c", "y", "x", "v"))).alias("s"), (F.max("x") + 1).cast("int").alias("w"), (F.max("y") + 1).cast("int").alias("h"))
    cut = "transform(sequence(0, cast(size(s) div (w * h) as int) - 1), c -> transform(slice(s, c * w * h + 1, w * h), e -> e.v))"
    return by.selectExpr("image_id", "w", "h", f"{cut} as planes")


def packed_to_planes(images: DataFrame) -> DataFrame:
    """packed -> planes in Catalyst: bytes become integers by their hexadecimal form."""
    at = "cast(conv(substring(x, 2 * (i * channels + c) + 1, 2), 16, 10) as int)"
    grid = f"transform(sequence(0, channels - 1), c -> transform(sequence(0, width * height - 1), i -> {at}))"
    return images.select("image_id", "width", "height", "channels", F.hex("data").alias("x")).selectExpr("image_id", "width as w", "height as h", f"{grid} as planes")


def planes_to_packed(images: DataFrame) -> DataFrame:
    """planes -> packed in Catalyst."""
    text = "array_join(transform(sequence(0, w * h - 1), i -> array_join(transform(planes, p -> lpad(hex(cast(get(p, i) as bigint)), 2, '0')), '')), '')"
    return images.selectExpr("image_id", "w as width", "h as height", "size(planes) as channels", f"unhex({text}) as data")
