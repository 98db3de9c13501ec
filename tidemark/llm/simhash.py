"""SimHash near-duplicates by covering locality-sensitive hashing.

Every position of the 64-bit fingerprint carries a non-zero vector of radius + 1 bits, and each non-zero vector v of that size is a
table, whose mask keeps the positions that have an odd number of bits in common with v. The vectors at the (at most radius)
positions where two fingerprints differ span less than the whole space, so some v is orthogonal to all of them: that
table's mask keeps none of these positions, and the two fingerprints collide there. No pair within the radius is lost.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_SHARE, discard, fresh, in_slices, join_counted, materialize, n_partitions, read, small_batches, text_hash
from .components import components

BITS, RADIUS, SHINGLE, SEED = 64, 4, 4, 42
#: A bucket of more fingerprints is not compared pairwise in its task, but through midpoints, spread over all tasks.
DIRECT = 4096


def simhash(text: str | None) -> int:
    """Unsigned fingerprint: a bit is 1 if more than half of the shingles' XXH64 have it."""
    import numpy as np
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []  # bytes: only A-Z change, six separators
    if not words:
        return 0
    whole = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(whole, SEED)
    digest, votes = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[:n].tolist()
    stops = (ends[SHINGLE - 1 :] - 1).tolist()
    for i in range(0, n, 1 << 15):  # bounded working memory
        h = np.array([digest(whole[a:b], SEED) for a, b in zip(starts[i : i + (1 << 15)], stops[i : i + (1 << 15)], strict=True)], "<u8")
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > n, bitorder="little").view("<u8")[0])


def fingerprint(column: Column) -> Column:
    """The fingerprints of a text column as signed longs."""

    @F.arrow_udf("long")
    def run(texts):
        import numpy as np
        import pyarrow as pa

        return pa.array(np.array(in_slices(texts, simhash), np.uint64).view(np.int64))

    return run.asNondeterministic()(column)


def masks(radius: int = RADIUS) -> list[int]:
    """The covering masks: 2 ** (radius + 1) - 1 of them, each of about half the bits."""
    top = (1 << (radius + 1)) - 1
    vectors = [i % top + 1 for i in range(BITS)]
    return [sum(1 << i for i, x in enumerate(vectors) if (x & v).bit_count() % 2) for v in range(1, top + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(prints: DataFrame, radius: int = RADIUS, direct: int = DIRECT) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` (long), enough to connect all that links within the radius connect.

    A fingerprint goes to one bucket for each mask (one shuffle of 16-byte rows). A task streams its buckets, sorted by key, and holds
    at most ``direct`` fingerprints of one: these are compared, and each group that hangs together gives a star of
    edges, not its pairs. Members of a larger bucket are passed on: fingerprints within the radius share a midpoint
    within half of it, so linking each to all points within radius / 2, and grouping by point, connects exactly those; a point has few members,
    whatever the size of the bucket.
    """
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks(radius))])
    rows = prints.select("fp", F.explode(keys).alias("key"))
    n = n_partitions(prints.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def result(a, b, hot):
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(hot, pa.bool_())], names=["a", "b", "hot"])

        held: list = []  # of the bucket at the end of the batch before
        held_key, held_n, over = None, 0, False

        def close(members):
            """The star edges of a bucket."""
            left = np.unique(np.concatenate(members)) if len(members) > 1 else np.unique(members[0])
            a, b = [], []
            while len(left) > 1:
                root, todo, left = left[0], [left[0]], left[1:]
                while todo and len(left):
                    near = np.bitwise_count((left ^ todo.pop()).view(np.uint64)) <= radius
                    if near.any():
                        found = left[near].tolist()
                        left = left[~near]
                        todo += [np.int64(x) for x in found]
                        a += found
                        b += [int(root)] * len(found)
            return a, b

        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            key = batch.column(1).to_numpy(zero_copy_only=False)
            if not len(key):
                continue
            cuts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
            sizes = np.diff(cuts)
            out_a, out_b, hot = [], [], []
            # buckets of two within the batch, all at once
            inner = np.arange(len(sizes))
            two = inner[(sizes == 2) & (inner > 0) & (inner < len(sizes) - 1)]
            x, y = fp[cuts[two]], fp[cuts[two] + 1]
            near = (np.bitwise_count((x ^ y).view(np.uint64)) <= radius) & (x != y)
            out_a += x[near].tolist()
            out_b += y[near].tolist()
            rest = inner[((sizes > 1) & ((sizes != 2))) | (inner == 0) | (inner == len(sizes) - 1)]
            for k in rest.tolist():
                members, name = fp[cuts[k] : cuts[k + 1]], key[cuts[k]]
                if name != held_key:
                    if held_n > 1 and not over:
                        a, b = close(held)
                        out_a += a
                        out_b += b
                    held, held_key, held_n, over = [], name, 0, False
                held_n += len(members)
                if not over:
                    held.append(members)
                    if held_n > direct:
                        over = True
                        hot += np.concatenate(held).tolist()
                        held = []
                else:
                    hot += members.tolist()
            if out_a or hot:
                yield result(out_a + hot, out_b + hot, [False] * len(out_a) + [True] * len(hot))
        if held_n > 1 and not over:
            a, b = close(held)
            if a:
                yield result(a, b, [False] * len(a))

    found = materialize(rows.repartition(n, "key").sortWithinPartitions("key").mapInArrow(run, "a long, b long, hot boolean"), "links")
    direct_edges = found.where("not hot").select("a", "b")
    if found.where("hot").isEmpty():
        direct_edges.materialized_path = found.materialized_path
        return direct_edges
    half = radius // 2
    points = [0] + [sum(1 << i for i in c) for k in range(1, half + 1) for c in combinations(range(BITS), k)]
    if radius % 2:
        raise ValueError("the radius must be even")
    around = F.transform(F.lit([_signed(p) for p in points]), lambda m: F.col("fp").bitwiseXOR(m))
    reach = found.where("hot").select(F.col("a").alias("fp")).distinct().select("fp", F.explode(around).alias("point"))
    least = reach.groupBy("point").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1")
    edges = direct_edges.unionByName(reach.join(least, "point").where("fp <> b").select(F.col("fp").alias("a"), "b").distinct())
    edges.materialized_path = found.materialized_path
    return edges



def near_duplicates(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each input row: id, text_hash (XXH64 of the text), fingerprint (long), component_id (the smallest id that links reach),
    root (the fingerprint that names the component; ids may repeat, roots do not).

    Fingerprints link at ``radius`` or fewer differing bits. Null, empty and blank texts have fingerprint zero and link
    like any other. Repeated rows stay; null ids stay, and count for the component only if it has no other (then its id is null). Ids of any
    type that can be ordered will do. An empty table gives no rows. Further columns are not carried. Equal fingerprints meet before anything is
    compared, so large groups of copies cost one fingerprint, and neither copies of a text nor members of a component are
    gathered in a task (``join_counted``). Two tables of some 30 bytes a row stay in the shared folder, as the result reads them.
    """
    rows = materialize(small_batches(df).select(F.col(id_column).alias("id"), text_hash(text_column).alias("text_hash"), fingerprint(F.col(text_column)).alias("fp")), "prints")
    prints = materialize(rows.groupBy("fp").agg(F.min("id").alias("first"), F.count("*").alias("copies")), "distinct")
    found = links(prints.select("fp"), radius)
    labels = components(found)
    roots = materialize(prints.join(labels, F.col("fp") == F.col("node"), "left").select("fp", "first", "copies", F.coalesce("component", "fp").alias("root")), "roots")
    for done in (found, labels, prints):
        discard(done)
    size = roots.agg(F.count("*").alias("prints"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    ids = roots.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    named = materialize(join_counted(roots.drop("first"), ids, "root", size["prints"]).select("fp", F.col("copies").alias("n"), "component_id", "root"), "named")
    discard(roots)
    return join_counted(rows, named, "fp", size["rows"]).select(F.col("id").alias(id_column), "text_hash", F.col("fp").alias("fingerprint"), "component_id", "root")


def deduplicate(df: DataFrame, id_column: str = "doc_id", text_column: str = "text", radius: int = RADIUS) -> DataFrame:
    """The rows of ``df``, one of each component: that of the smallest (id, hash of its text). All columns are kept.

    Of rows that are equal in both one is kept; a component whose ids are all null keeps one as well (null ids come last). Null, empty and blank
    texts are one component; an empty table stays empty. Texts are shuffled once, by id and hash; where one
    such pair (a null or repeated id, and equal texts) holds more than one in HOT_SHARE of all rows, its rows are combined before they are sent.
    """
    table = near_duplicates(df, id_column, text_column, radius)
    found = materialize(table.select(F.col(id_column).alias("i"), F.col("text_hash").alias("h"), "root"), "members")
    kind = df.schema[id_column].dataType.simpleString()
    plain = lambda c: F.coalesce(c, F.lit(0).cast(kind)) if kind in ("tinyint", "smallint", "int", "bigint") else F.coalesce(c.cast("string"), F.lit(""))
    # join and dropDuplicates deal rows by the same three plain columns: null or not, id, hash
    pair = fresh(df, "no_id", "plain_id", "text_hash")
    key_of = lambda i, h: {pair[0]: i.isNull(), pair[1]: plain(i), pair[2]: h}
    lowest = F.min(F.struct(F.col("i").isNull().alias("n"), "i", "h")).alias("low")
    keep = found.groupBy("root").agg(lowest).select(*[c.alias(n) for n, c in key_of(F.col("low.i"), F.col("low.h")).items()])
    keyed = df.withColumns(key_of(F.col(id_column), text_hash(text_column)))
    pairs = found.select(*[c.alias(n) for n, c in key_of(F.col("i"), F.col("h")).items()]).groupBy(*pair).agg(F.count("*").alias("n"))
    hot = materialize(pairs.where(F.col("n") > max(1, found.count() // HOT_SHARE)).select(*pair), "hot-pairs")  # at most HOT_SHARE rows
    if hot.isEmpty():
        return keyed.join(keep, pair, "left_semi").dropDuplicates(pair).drop(*pair)
    cold = keyed.join(F.broadcast(hot), pair, "left_anti").join(keep, pair, "left_semi").dropDuplicates(pair)
    return cold.unionByName(keyed.join(F.broadcast(hot.join(keep, pair, "left_semi")), pair, "left_semi").dropDuplicates(pair)).drop(*pair)


def op5_simhash(spark, sf_dir):
    """doc_id, fingerprint (16 hex digits) and component_id of every whole document."""
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
