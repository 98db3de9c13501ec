"""What the operators share: reading tables, the shared folder, joins on hot keys, range buckets, ASCII words."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that go to a worker at once, and that it handles as objects at once. Texts can be long, so these are few.
BATCH_ROWS = 512
#: A key that holds more than one in so many of all rows is hot; there are at most so many of them, so they can be broadcast.
HOT_SHARE = 10_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the driver's folder, through Spark's reader (any file system)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """``df``, after a look at its session: where rows go to Python workers in larger batches than ``rows`` (by default 10,000 or 64 MB), the session's setting is lowered to that, as plans run later than this and
    the setting holds for a session as a whole. A smaller one is left alone. Every operator that sends texts to workers does this, so their memory does not depend on who calls them."""
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, str(rows))
    return df


def slices(batches, rows: int = BATCH_ROWS) -> Iterator:
    """The record batches in parts of at most so many rows."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def in_slices(column, make) -> list:
    """make(value) for each value of an Arrow array, BATCH_ROWS of which are Python objects at a time."""
    return [make(v) for i in range(0, len(column), BATCH_ROWS) for v in column.slice(i, BATCH_ROWS).to_pylist()]


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until ``df`` has no column of that name (case does not count)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary folder, but only in a local session: the executors of a
    cluster do not share one, so there it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_OWN: list[str] = []


def _own_dir() -> str:
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="tidemark-"))
    return _OWN[0]


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def temporaries():
    """Deletes, at its end, every table that ``materialize`` wrote within it, but those written with ``keep``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for df in _SCOPES.pop():
            discard(df)


def materialize(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors. The files stay until ``discard`` or the
    end of the ``temporaries`` around it (not with ``keep``)."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_path = path
    if _SCOPES and not keep:
        _SCOPES[-1].append(out)
    return out


def discard(df: DataFrame | None) -> None:
    """Delete the files of a table that ``materialize`` wrote."""
    path = getattr(df, "materialized_path", None)
    if path:
        jvm = df.sparkSession._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def join_counted(rows: DataFrame, table: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` joined to ``table`` by ``key``, which is unique in ``table``; its column ``n`` says how many of all ``total`` rows have the key.

    Keys of more than total / HOT_SHARE rows are at most HOT_SHARE, so theirs is a broadcast join at any size of the input, and the rows of a
    hot key stay where they are. All others meet by a shuffle, whose tasks then hold no large group. ``rows`` is read twice."""
    hot = F.col("n") > total // HOT_SHARE
    lots, few = table.where(hot), table.where(~hot)
    near = rows.join(F.broadcast(lots), key)
    return near.unionByName(rows.join(F.broadcast(lots.select(key)), key, "left_anti").join(few, key))


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


LEAST, GREATEST = -(1 << 63), (1 << 63) - 1


def range_bounds(df: DataFrame, column: str, n: int) -> list[tuple[int, int]]:
    """At most n - 1 ascending bounds (value, hash) that split the rows, in the order of the column and of a 64-bit hash, into about equal
    buckets (a sketch over that column alone). Nulls count as the least long. A value that holds several buckets' rows is split by the hash."""
    if n < 2:
        return []
    found = df.select(F.coalesce(F.col(column), F.lit(LEAST)).alias("v")).approxQuantile("v", [i / n for i in range(1, n)], 0.25 / n)
    times = Counter(min(max(int(x), LEAST), GREATEST) for x in found)
    return sorted((v, GREATEST if j == k else LEAST + (j << 64) // k) for v, k in times.items() for j in range(1, k + 1))


def range_bucket(column: Column, tie: Column, bounds: list[tuple[int, int]]) -> Column:
    """How many bounds lie below the row's (value, hash). Looks at 2 * sqrt(n) bounds for a row: first coarse, then fine ones."""
    if not bounds:
        return F.lit(0)
    value = F.coalesce(column, F.lit(LEAST))
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    pairs = lambda xs: F.array(*[F.struct(F.lit(v).cast("long").alias("v"), F.lit(h).cast("long").alias("h")) for v, h in xs])
    below = lambda b: (b["v"] < value) | ((b["v"] == value) & (b["h"] < tie))
    coarse = F.size(F.filter(pairs([g[-1] for g in groups]), below))
    fine = F.size(F.filter(F.element_at(F.array(*[pairs(g) for g in groups]), F.least(coarse + 1, F.lit(len(groups)))), below))
    return F.when(coarse >= len(groups), F.lit(len(bounds))).otherwise(coarse * step + fine).cast("int")


def whole_numbers(df: DataFrame, column: str) -> Column:
    """The ids as longs; ids of another type than a whole number raise, as their order would not be that of the column."""
    kind = df.schema[column].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint", "void"):
        raise TypeError(f"{column} is {kind}: ids must be whole numbers")
    return F.col(column).cast("long")


def crc32_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id written as text (null: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def text_hash(column: str = "text") -> Column:
    """XXH64 of the text; null gives the hash's seed, which no short text has."""
    return F.xxhash64(F.col(column))


def ascii_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` as UTF-8; bytes.split() splits at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def is_local(uri: str) -> str | None:
    """The local path of a file: URI or plain path, else None."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def _arrow_uri(uri: str) -> str:
    """Spark's names of object stores as pyarrow knows them."""
    for spark, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("wasbs://", "abfss://")):
        if uri.startswith(spark):
            return arrow + uri[len(spark) :]
    return uri


def open_output(uri: str):
    """A binary file to write: local paths directly, other stores through pyarrow's file systems (S3, GCS, Azure; HDFS with its native library)."""
    if (path := is_local(uri)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        return open(path, "wb")
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(_arrow_uri(uri))
    return where.open_output_stream(path)


def open_input(uri: str):
    """A binary file to read with seek."""
    if (path := is_local(uri)) is not None:
        return open(path, "rb")
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(_arrow_uri(uri))
    return where.open_input_file(path)
