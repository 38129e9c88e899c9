"""Plans as files: what was drawn, to be run again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..operators.mixing import PLAN


def folder(spark: SparkSession) -> str:
    """A new path in the folder that the driver and all executors share; on one machine, where none is set, in a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='plans-')}"
    return f"{base.rstrip('/')}/plan-{uuid.uuid4().hex}"


def write_plan(plan: DataFrame, path: str) -> None:
    plan.write.partitionBy("step").parquet(path)


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    """A mix plan; a step's rows alone are read where only they are asked for."""
    return spark.read.schema(PLAN).parquet(path).select(*(x.split(" ")[0] for x in PLAN.split(", ")))
