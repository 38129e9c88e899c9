"""Mosaics over a stream: the same groups for any cut of it, and after a restart."""

import numpy as np
import pytest

from pixloom.functions.draws import unit
from pixloom.operators import kernels
from pixloom.streaming import streams

SIDE, LANES = 4, 3


def image(k):
    return ((np.arange(SIDE * SIDE) * 5 + k * 31) % 256).astype(np.uint8).reshape(SIDE, SIDE, 1)


def rows(ids):
    return [(k, SIDE, SIDE, 1, image(k).tobytes(), [float(k), 1.0]) for k in ids]


def wanted(n):
    """Four after another of a lane, by id."""
    lane = {k: int(unit(0, "lane", k) * LANES) for k in range(n)}
    out = []
    for at in range(LANES):
        mine = [k for k in range(n) if lane[k] == at]
        for four in (mine[i : i + 4] for i in range(0, len(mine) // 4 * 4, 4)):
            out.append((four[0], kernels.mosaic([image(k) for k in four]).tobytes(), [x for k in four for x in (float(k), 1.0)]))
    return sorted(out)


def through(spark, source, out, checkpoint, files):
    stream = streams.read_stream(spark, source, streams.LABELLED, files)
    streams.write_stream(streams.mosaic_stream(stream, LANES), out, checkpoint).awaitTermination()


@pytest.mark.parametrize("cuts", [[50], [1, 6, 7, 19, 33, 50], [25, 26, 27, 50]], ids=str)
def test_any_cut_and_a_restart_between_all_parts(spark, tmp_path, cuts):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    low = 0
    for high in cuts:  # each part is a run of its own that begins from the checkpoint
        spark.createDataFrame(rows(range(low, high)), streams.LABELLED).coalesce(1).write.mode("append").parquet(source)
        through(spark, source, out, checkpoint, 1)
        low = high
    got = sorted((r.image_id, bytes(r.data), list(r.label)) for r in spark.read.parquet(out).collect())
    assert got == wanted(50) and len(got) > 8


def test_odd_rows(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "state"))
    small = (3, 2, 2, 1, bytes(4), [0.0])
    odd = [(None, SIDE, SIDE, 1, image(0).tobytes(), [1.0]), (1, SIDE, SIDE, 1, None, None), *rows([0, 2]), small, *((k, SIDE, SIDE, 1, image(k).tobytes(), None) for k in range(4, 8))]
    spark.createDataFrame(odd, streams.LABELLED).coalesce(1).write.parquet(source)
    stream = streams.read_stream(spark, source, streams.LABELLED)
    streams.write_stream(streams.mosaic_stream(stream, 1), out, checkpoint).awaitTermination()
    assert [(r.image_id, bytes(r.data), r.label) for r in spark.read.parquet(out).collect()] == [(0, kernels.mosaic([image(k) for k in (0, 2, 4, 5)]).tobytes(), [0.0, 1.0, 2.0, 1.0])]


def test_mosaic_kernel_equals_planes(spark):
    from pixloom.operators import mixing as M

    w, h = 5, 6
    df = spark.range(4).selectExpr("id as image_id", f"{w} as w", f"{h} as h", f"array(transform(sequence(1, {w * h}), i -> cast((i * 7 + id * 13) % 256 as int))) as planes", "array(1D) as label")
    want = M.mosaic(df).first().planes[0]
    four = [np.array([(i * 7 + k * 13) % 256 for i in range(1, w * h + 1)], np.uint8).reshape(h, w, 1) for k in range(4)]
    assert kernels.mosaic(four).ravel().tolist() == want
