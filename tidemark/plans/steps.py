"""Cutting long plans: a step's table is written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame

_OWN: list[str] = []


def settle(df: DataFrame, name: str) -> DataFrame:
    """The table as written under ``spark.checkpoint.dir``, so that what follows has a short plan and a lost executor costs one step. Where that is unset, under a temporary folder, but only in a local session; elsewhere it raises. The files
    stay, for the result reads them; they go with the folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="tidemark-steps-"))
        base = _OWN[0]
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
