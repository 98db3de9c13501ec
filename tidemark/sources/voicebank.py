"""Voice banks of neural singers: a folder a bank, with its settings, token numbers, language numbers and voice modes."""

from __future__ import annotations

import json
import os
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = "configs/dsconfig.yaml"


def list_banks(spark: SparkSession, folder: str) -> DataFrame:
    """bank: the names of a folder's banks, those with settings, sorted. Contents are not read; a folder without banks gives no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", os.path.basename(SETTINGS)).load(folder).select("path")
    name = F.regexp_extract("path", f"/([^/]+)/{SETTINGS}$", 1)
    return files.select(name.alias("bank")).where("bank <> ''").distinct().orderBy("bank")


def settings(text: str) -> dict[str, str | float | int]:
    """The plain ``key: value`` lines of a settings file; nested ones, lists and comments are passed over."""
    out: dict[str, str | float | int] = {}
    for line in text.splitlines():
        key, mark, value = line.partition(":")
        value = value.split(" #")[0].strip().strip("'\"")
        if not mark or not value or line[:1] in " #-":
            continue
        try:
            out[key.strip()] = int(value)
        except ValueError:
            try:
                out[key.strip()] = float(value)
            except ValueError:
                out[key.strip()] = value
    return out


def read_bank(folder: str, rate: int = 44_100) -> dict:
    """A bank's settings, frame length in seconds, tokens, languages and embeddings (name -> vector of 32-bit floats). Another sample rate than ``rate`` raises. Model files are left to the engine that runs them."""
    base = os.path.join(folder, "configs")
    with open(os.path.join(folder, SETTINGS), encoding="utf-8") as f:
        own = settings(f.read())
    if own["sample_rate"] != rate:
        raise ValueError(f"{folder}: sample rate {own['sample_rate']}, not {rate}")

    def table(key: str) -> dict:
        with open(os.path.join(base, str(own[key])), encoding="utf-8") as f:
            return json.load(f)

    modes = os.path.join(base, "embeds")
    embeds = {name[:-4]: np.fromfile(os.path.join(modes, name), "<f4") for name in sorted(os.listdir(modes)) if name.endswith(".emb")} if os.path.isdir(modes) else {}
    return {"settings": own, "frame": own["hop_size"] / rate, "tokens": table("phonemes"), "languages": table("languages"), "embeds": embeds}


@lru_cache(maxsize=8)
def bank(folder: str) -> dict:
    """``read_bank``, once in a process."""
    return read_bank(folder)


def embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """bank, mode, vector: every voice mode of a folder's banks, read by tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.emb").load(folder).select("path", "content")

    @F.arrow_udf("array<float>")
    def floats(contents):
        import pyarrow as pa

        return pa.array([np.frombuffer(c, "<f4") for c in contents.to_pylist()], pa.list_(pa.float32()))

    return files.select(F.regexp_extract("path", "/([^/]+)/configs/embeds/[^/]+$", 1).alias("bank"), F.regexp_extract("path", "/([^/]+)[.]emb$", 1).alias("mode"), floats("content").alias("vector"))
