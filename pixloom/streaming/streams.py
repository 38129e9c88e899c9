"""Image pipelines on Structured Streaming.

A pipeline over single images or clips keeps no state: draws are keyed by id, so
the batch operators run on a stream as they are and a replayed micro-batch gives
the same rows.  Mixing by `mix_stream` finds partners within a micro-batch.
`mosaic_stream` keeps images that wait for others in the state store, so its
groups don't depend on how the stream is cut into micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.draws import unit_column
from ..operators import kernels, packed
from ..plans.pipeline import Compose
from ..schema import PACKED


def read_stream(spark: SparkSession, path: str, schema: str = PACKED, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def transform_stream(images: DataFrame, pipeline: Compose, seed: int = 0, key: str = "image_id", **more) -> DataFrame:
    return packed.transform(images, pipeline, seed, key, **more)


def write_stream(images: DataFrame, path: str, checkpoint: str, available_now: bool = True):
    """Parquet files, exactly once."""
    writer = images.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def mix_stream(images: DataFrame, mix: Callable[[DataFrame, int], DataFrame], path: str, checkpoint: str, seed: int = 0):
    """mix(micro-batch, seed + batch number), each to its own folder, so a repeated micro-batch overwrites itself."""

    def one(batch: DataFrame, number: int) -> None:
        mix(batch, seed + number).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return images.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: What a lane keeps of the images that wait, at most three.
WAITING = "ids array<bigint>, data array<binary>, labels array<array<double>>"
LABELLED = f"{PACKED}, label array<double>"


def mosaic_stream(images: DataFrame, lanes: int = 64, seed: int = 0) -> DataFrame:
    """Mosaics (LABELLED) of a stream or table of images (LABELLED): four of a lane at a time, in the order of their arrival.

    A lane is drawn by the id, and images of one size share one; within a
    micro-batch a lane's images come by id, so where ids rise along the stream
    the groups are the same for any cut of it, and after a restart.  Up to
    three images a lane wait in the state for the next.  Labels are
    concatenated, a null label as an empty one.  Rows without id or data can be
    in no group and are dropped.
    """
    names, size = ["image_id", "width", "height", "channels", "data", "label"], ["width", "height", "channels"]

    def grouped(key, frames, state):
        w, h, c = map(int, key[1:])
        waiting = list(zip(*state.get, strict=True)) if state.exists else []
        new = pd.concat(list(frames), ignore_index=True).sort_values("image_id", kind="stable")
        waiting += [(int(k), bytes(data), [] if label is None else [float(x) for x in label]) for k, data, label in zip(new["image_id"], new["data"], new["label"], strict=True)]
        whole = len(waiting) // 4 * 4
        out = []
        for at in range(0, whole, 4):
            four = waiting[at : at + 4]
            img = kernels.mosaic([np.frombuffer(bytes(data), np.uint8).reshape(h, w, c) for _, data, _ in four])
            out.append((four[0][0], w, h, c, img.tobytes(), [float(x) for *_, label in four for x in label]))
        if whole < len(waiting):
            state.update(tuple(list(x) for x in zip(*waiting[whole:], strict=True)))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=names)

    lane = F.floor(unit_column(seed, "lane") * lanes).cast("int")
    kept = images.where(F.col("image_id").isNotNull() & F.col("data").isNotNull()).select(*names)
    by = kept.withColumn("lane", lane).groupBy("lane", *size)
    return by.applyInPandasWithState(grouped, LABELLED, WAITING, "append", GroupStateTimeout.NoTimeout)
