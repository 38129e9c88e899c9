"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR: folder of tables.  BENCH_CPUS: cores of the local master.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
#: Queries over the given 8x8 images, by the planes path.
PLANES = ("flagship", "lut_chain", "d4_chain", "crop_hoist", "equalize", "to_sepia", "gaussian3", "median3", "sharpen", "resize_bilinear", "mixup", "bbox_program")
#: Pixels a side and least number of the larger images of the packed path.
SIDE, IMAGES = 256, int(os.environ.get("BENCH_IMAGES", "20000"))


def main() -> None:
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from pixloom import queries as Q
    from pixloom.operators import packed as P
    from pixloom.plans.pipeline import Compose, Maybe, Transform
    from pixloom.plans.program import Op, Program
    from pixloom.schema import PACKED
    from pixloom.sources import images as S

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def timed(name: str, make, repeat: int = 2) -> None:
        best = None
        for _ in range(repeat):
            began = time.perf_counter()
            make().write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - began
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)

    # the machine's own speed, to tell it from the library's: hashes of numbers, in whole-stage code, no table and no library
    timed("machine", lambda: spark.range(0, 200_000_000, numPartitions=int(CPUS) * 4).select(F.sum(F.xxhash64("id") % 7)))
    for name in PLANES:
        timed(name, lambda n=name: Q.queries()[n](spark, SF_DIR))

    big = f"{os.environ.get('TMPDIR', '/tmp')}/bench-{os.getpid()}"
    few = S.tiled(spark, SF_DIR, SIDE // 8)
    copies = max(1, -(-IMAGES // max(1, few.count())))
    few.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))).repartition(int(CPUS) * 4, "image_id", "part").write.partitionBy("part").parquet(big)
    try:
        lut = Program([Op("brightness", {"delta": 20}), Op("contrast", {"factor": 1.2}), Op("gamma", {"gamma": 0.8}), Op("solarize")])
        square = Program([Op("horizontal_flip"), Op("vertical_flip")])
        crop = Program([Op("brightness", {"delta": 20}), Op("contrast", {"factor": 1.2}), Op("crop", {"x": 16, "y": 16, "width": SIDE // 2, "height": SIDE // 2})])
        heavy = Program([*lut, Op("horizontal_flip"), Op("rotate"), Op("to_sepia"), Op("color_temperature", {"temperature": 20}), Op("gaussian_blur"), Op("sharpen"), Op("equalize"), Op("invert"), Op("crop", {"x": 8, "y": 8, "width": 224, "height": 224})])
        clip = Compose([Maybe(Transform("horizontal_flip"), 0.5), Transform("brightness", delta=(-30, 30)), Transform("contrast", factor=(0.8, 1.2)), Transform("random_crop", width=224, height=224)])
        rates, counts = {}, {}

        def rated(name: str, make, share: float = 1.0, repeat: int = 2) -> None:
            """Images a second over the first `share` of the copies; the scan alone is `packed_scan`."""
            last = max(1, round(copies * share))
            source = spark.read.schema(f"{PACKED}, part int").parquet(big).where(F.col("part") < last)
            if last not in counts:
                counts[last] = source.count()
            timed(name, lambda: make(source).select("image_id", F.octet_length("data")), repeat)
            rates[name] = round(counts[last] / times[name], 1)

        rated("packed_scan", lambda df: df)
        for name, program, share in (("packed_lut4", lut, 1.0), ("packed_square", square, 1.0), ("packed_crop_lut", crop, 1.0), ("packed_heavy", heavy, 0.2)):
            for optimize in (True, False):
                rated(name + ("" if optimize else "_unplanned"), lambda df, p=program, o=optimize: P.transform(df, p, optimize=o), share)
        rated("packed_video", lambda df: P.transform_video(df.withColumn("clip_id", F.expr("image_id div 16")), clip, 7), 0.5)
        # the same operations, drawn for every image and fixed
        drawn = Compose([Maybe(Transform("horizontal_flip"), 0.5), Transform("brightness", delta=(-30, 30)), Transform("contrast", factor=(0.8, 1.2)), Transform("gamma", gamma=(0.8, 1.2)), Transform("random_crop", width=224, height=224)])
        fixed = Program([Op("horizontal_flip"), Op("brightness", {"delta": 20}), Op("contrast", {"factor": 1.2}), Op("gamma", {"gamma": 0.8}), Op("crop", {"x": 16, "y": 16, "width": 224, "height": 224})])
        rated("packed_random", lambda df: P.transform(df, drawn, 7), 0.5)
        rated("packed_random_fixed", lambda df: P.transform(df, fixed), 0.5)
        for name, op, share in (("transpose", Op("transpose"), 0.5), ("auto_contrast", Op("auto_contrast"), 0.5), ("sharpen", Op("sharpen"), 0.2), ("gaussian5", Op("gaussian_blur", {"kernel_size": 5}), 0.2)):
            rated(f"packed_{name}", lambda df, o=op: P.transform(df, Program([o])), share, 1)
    finally:
        import shutil

        shutil.rmtree(big, ignore_errors=True)
    scale = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(v for k, v in times.items() if k != "machine"), 3), "unit": "sec", "queries": times, "sf": float(scale[1]) if scale else None, "images_per_s": rates, "images_per_s_core": {k: round(v / int(CPUS), 1) for k, v in rates.items()}, "images": counts[copies], "side": SIDE}))
    spark.stop()


if __name__ == "__main__":
    main()
