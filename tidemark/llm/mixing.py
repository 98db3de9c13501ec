"""Mixing sources to target weights by Poisson replication, in Spark expressions only.

Every document gets a count from a Poisson distribution whose mean is its source's repetition rate: the source's share of the
mixture over its size. The distribution is inverted at a uniform number made of a hash of seed, id and text, so the result depends on
the rows alone, not on partitions or attempts. A mean above MOST_MEAN is split into equal parts, whose counts, each with its own hash, are summed.
Documents are exploded by their counts and dealt out by a second hash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialize, n_partitions, read, text_hash

#: The Poisson distribution is tabulated up to mean + WIDE * sqrt(mean) + 20; what lies beyond has a probability below 1e-15.
WIDE = 12
#: A larger mean is the sum of equal parts of at most this, so that a table has at most 1,985 entries.
MOST_MEAN = 1500
#: Copies that are made of one row in one task at most, and the greatest mean; a larger one raises.
COPIES, GREATEST_MEAN = 10_000, 1e9
#: Rates of more sources than these (each some hundred bytes) are not broadcast.
BROADCAST_SOURCES = 10_000


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) of 48 bits of the md5 of the seed and the columns; nulls count as their own value."""
    digest = F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("\\N")) for c in columns]))
    return (F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def cdf(mean: Column) -> Column:
    """Array of P(count <= k) for k = 0, 1, ...; the terms are products in logarithms, so large means do not underflow."""
    top = F.ceil(mean + WIDE * F.sqrt(mean) + 20).cast("int")

    def step(acc: Column, k: Column) -> Column:
        log_p = F.when(k == 0, -mean).otherwise(acc["log_p"] + F.log(mean) - F.log(k.cast("double")))
        total = acc["total"] + F.exp(log_p)
        return F.struct(log_p.alias("log_p"), total.alias("total"), F.array_append(acc["all"], total).alias("all"))

    start = F.struct(F.lit(0.0).alias("log_p"), F.lit(0.0).alias("total"), F.array().cast("array<double>").alias("all"))
    return F.when(mean > 0, F.aggregate(F.sequence(F.lit(0), top), start, step, lambda acc: acc["all"])).otherwise(F.array(F.lit(1.0)))


def rates(df: DataFrame, weights: Mapping[str, float] | None = None, source_column: str = "source", text_column: str = "text") -> DataFrame:
    """One row for each source: source (null is a source too), size (code points of its texts), mean (copies of a document on average), parts (of the mean, each at
    most MOST_MEAN), cdf (of a part).

    ``weights``: relative shares of the mixture in code points, sources without one get none; default: equal shares. The mixture is as
    large as the input. A source without any text gets mean 0.
    """
    sizes = df.select(F.col(source_column).alias("__source"), F.col(text_column).alias("__text")).groupBy("__source").agg(F.sum(F.coalesce(F.length("__text"), F.lit(0)).cast("long")).alias("size"))
    if weights is None:
        weight = F.lit(1.0)
    elif weights:
        table = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
        weight = F.coalesce(F.try_element_at(table, F.coalesce(F.col("__source"), F.lit("\\N"))), F.lit(0.0))
    else:
        weight = F.lit(0.0)
    shares = sizes.withColumn("weight", F.when(F.col("size") > 0, weight).otherwise(0.0))
    whole = shares.agg(F.sum("size").alias("all"), F.sum("weight").alias("weights"))  # one row
    mean = F.when(F.col("weights") * F.col("size") > 0, F.col("weight") / F.col("weights") * F.col("all") / F.col("size")).otherwise(0.0)
    return shares.crossJoin(F.broadcast(whole)).withColumn("mean", mean).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("mean") / MOST_MEAN).cast("int"))).withColumn("cdf", cdf(F.col("mean") / F.col("parts"))).select("__source", "size", "mean", "parts", "cdf")


def mix(df: DataFrame, weights: Mapping[str, float] | None = None, seed: int = 0, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", shuffle: bool = True) -> DataFrame:
    """The rows of ``df``, each as often as its count says, with ``copy`` (from 1), ``n_copies`` and ``shuffle_key`` (a uniform number), dealt out
    by that key and sorted by it in each partition.

    All columns are kept; columns of these three names are replaced. Null texts count as empty, null sources as a source; equal rows get
    equal counts. An empty table stays empty. A hot source costs nothing but its rows: sizes are summed before the shuffle, and the rates (a row
    for each source) meet the documents in a broadcast join if they are at most BROADCAST_SOURCES, counted first, else in a sort-merge join, which
    Spark splits where it is skewed. A document of more than COPIES copies is dealt out in blocks of them before they are made. A mean above
    GREATEST_MEAN raises.
    """
    df = df.drop("copy", "n_copies", "shuffle_key")
    source, parts, table, u, block, salt = fresh(df, "mix_source", "mix_parts", "mix_cdf", "mix_u", "mix_block", "mix_salt")
    means = materialize(rates(df, weights, source_column, text_column).select(F.col("__source").alias(source), "mean", F.col("parts").alias(parts), F.col("cdf").alias(table)), "rates")
    known = means.agg(F.count("*").alias("n"), F.max("mean").alias("mean")).first()
    if (top := known["mean"] or 0.0) > GREATEST_MEAN:
        raise ValueError(f"a source would be repeated {top:.3g} times on average; more than {GREATEST_MEAN:.0e} is refused")
    means = means.drop("mean")
    if known["n"] <= BROADCAST_SOURCES:
        means = F.broadcast(means)
    with_cdf = df.join(means, df[source_column].eqNullSafe(F.col(source))).drop(source)
    digest = F.md5(F.coalesce(F.col(text_column), F.lit("")))
    below = lambda x: F.size(F.filter(table, lambda c: c < x))
    # the parts after the first hash their number as well; the array of one digest keeps it from being made for each part
    more = lambda t: F.aggregate(F.transform(F.sequence(F.lit(1), F.col(parts) - 1), lambda p: uniform(seed, F.col(id_column), t, p)), F.lit(0), lambda n, x: n + below(x))
    rest = F.when(F.col(parts) > 1, F.element_at(F.transform(F.array(digest), more), 1)).otherwise(0)
    counted = with_cdf.withColumn(u, uniform(seed, F.col(id_column), digest)).withColumn("n_copies", below(F.col(u)) + rest).drop(table, parts, u).where("n_copies > 0")
    n_out = n_partitions(df.sparkSession)
    every = lambda rows: rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n_copies"))))
    if top + WIDE * top**0.5 + 20 <= COPIES:
        out = every(counted)
    else:
        blocks = counted.where(F.col("n_copies") > COPIES).withColumn(block, F.explode(F.sequence(F.lit(0), F.floor((F.col("n_copies") - 1) / COPIES).cast("int"))))
        dealt = blocks.repartition(n_out, F.col(block), F.col(id_column), text_hash(text_column))
        made = F.explode(F.sequence(F.col(block) * COPIES + 1, F.least(F.col("n_copies"), (F.col(block) + 1) * COPIES)))
        out = every(counted.where(F.col("n_copies") <= COPIES)).unionByName(dealt.withColumn("copy", made).drop(block))
    out = out.withColumn("shuffle_key", uniform(seed + 1, F.col(id_column), F.col("copy")))
    if not shuffle:
        return out
    # null and repeated ids share their keys, so texts and the tasks that rows come from deal them out as well
    out = out.withColumn(salt, F.xxhash64(F.spark_partition_id(), F.col(text_column)))
    return out.repartition(n_out, "shuffle_key", "copy", salt).sortWithinPartitions("shuffle_key", "copy").drop(salt)


def op8_poisson_mix(spark, sf_dir):
    """Every document by its count, equal shares of all sources: doc_id, source, copy, n_copies, shuffle_key, text."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "source", "copy", "n_copies", "shuffle_key", "text")


ORACLE_SQL = f"""
    WITH sizes AS (SELECT source, sum(coalesce(length(text), 0))::BIGINT AS size FROM documents GROUP BY source),
    shares AS (SELECT *, CASE WHEN size > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM sizes),
    means AS (SELECT source, CASE WHEN weight > 0 THEN weight / (SELECT sum(weight) FROM shares) * (SELECT sum(size) FROM shares)::DOUBLE / size ELSE 0.0::DOUBLE END AS mean FROM shares),
    terms AS (SELECT source, mean, k, CASE WHEN mean > 0 THEN exp(-mean + k * ln(mean) - lgamma(k + 1)) ELSE CASE WHEN k = 0 THEN 1.0 ELSE 0.0 END END AS p
        FROM means, generate_series(0, 2000) AS g(k) WHERE k <= ceil(mean + {WIDE} * sqrt(mean) + 20)),
    cdfs AS (SELECT source, list(c ORDER BY k) AS cdf FROM (SELECT source, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS c FROM terms) GROUP BY source),
    counted AS (SELECT d.doc_id, d.source, d.text, len(list_filter(c.cdf, lambda x: x < (('0x' || md5('0|' || coalesce(d.doc_id::VARCHAR, '\\N') || '|' || md5(coalesce(d.text, '')))[1:12])::BIGINT::DOUBLE + 0.5) / {1 << 48}::DOUBLE))::INT AS n_copies
        FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.source),
    copies AS (SELECT *, unnest(generate_series(1, n_copies))::INT AS copy FROM counted WHERE n_copies > 0)
    SELECT doc_id, source, copy, n_copies, (('0x' || md5('1|' || coalesce(doc_id::VARCHAR, '\\N') || '|' || copy)[1:12])::BIGINT::DOUBLE + 0.5) / {1 << 48}::DOUBLE AS shuffle_key, text FROM copies"""
