"""Document fingerprints: a Merkle tree over sections, paragraphs and their segments.

A text is cut into lines (paragraphs); a line is cut into segments of a few words. Where a segment ends depends on its last word
only, by one rule for the whole text, so an edit moves no cut far from it, and equal segments have equal digests wherever they stand. A run of
paragraphs that ends with a blank line, a heading ('#'), or a paragraph whose digest falls on a fixed pattern, is a section. Inner digests are
BLAKE2b of the children's digests, so equal roots mean equal texts.

The fingerprint is text: the root (32 hex digits), ``:``, then the sections, separated by ``/``, each its digest (8 hex digits), ``=`` and its
paragraphs, separated by ``,``; a paragraph is a run of 4 characters (24 bits in the URL-safe base 64) for each segment. The root compares
whole texts; sections whose digests differ, and in them the paragraphs that do, locate edits.
"""

from __future__ import annotations

from base64 import urlsafe_b64encode
from collections import Counter
from hashlib import blake2b
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_slices, n_partitions, range_bounds, range_bucket, read, slices, small_batches, text_hash, whole_numbers

#: A segment ends after a word whose crc32 is divisible by this, or after MOST_WORDS words, or with its line.
CUT_EVERY, MOST_WORDS = 3, 12
#: A section ends after a paragraph whose digest is divisible by this.
SECTION_EVERY = 8
#: Characters of a segment at most (texts without spaces).
MOST_CHARS = 400
#: Characters of a segment in the fingerprint.
LEAF = 4


def segments(line: str) -> list[str]:
    """Pieces of a line whose concatenation is the line."""
    out, held = [], []
    for word in line.split(" "):
        held.append(word)
        if len(held) == MOST_WORDS or not crc32(word.encode("utf-8", "surrogatepass")) % CUT_EVERY:
            out.append(" ".join(held) + " ")
            held = []
    if held:
        out.append(" ".join(held))
    elif out:
        out[-1] = out[-1][:-1]
    return [s[i : i + MOST_CHARS] for s in out for i in range(0, max(1, len(s)), MOST_CHARS)]


def tree(text: str | None) -> tuple[str, list[tuple[str, list[str]]]]:
    """Root digest, and for each section its short digest and its paragraphs' runs of segments. Null is as the empty text."""
    sections: list[tuple[str, list[str]]] = []
    roots: list[bytes] = []
    paragraphs: list[str] = []
    held: list[bytes] = []

    def end() -> None:
        roots.append(blake2b(b"S" + b"".join(held), digest_size=16).digest())
        sections.append((roots[-1][:4].hex(), paragraphs.copy()))
        held.clear()
        paragraphs.clear()

    for line in (text or "").split("\n"):
        if line.startswith("#") and held:
            end()
        digests = [blake2b(s.encode("utf-8", "surrogatepass"), digest_size=16).digest() for s in segments(line)]
        digest = blake2b(b"P" + b"".join(digests), digest_size=16).digest()
        held.append(digest)
        paragraphs.append(urlsafe_b64encode(b"".join([d[:3] for d in digests])).decode())
        if not line.strip() or not digest[0] % SECTION_EVERY:
            end()
    if held:
        end()
    return blake2b(b"R" + b"".join(roots), digest_size=16).hexdigest(), sections


def render(root: str, sections: list[tuple[str, list[str]]]) -> str:
    return root + ":" + "/".join(digest + "=" + ",".join(paragraphs) for digest, paragraphs in sections)


def parse(fingerprint: str) -> tuple[str, list[tuple[str, list[str]]]]:
    root, _, body = fingerprint.partition(":")
    return root, [(s[:8], s[9:].split(",")) for s in body.split("/")]


def _known(t: tuple[str, list[tuple[str, list[str]]]]):
    """A tree with the bag of its segments and their number."""
    bag = Counter(p[i : i + LEAF] for _, paragraphs in t[1] for p in paragraphs for i in range(0, len(p), LEAF))
    return t, bag, sum(bag.values())


def _likeness(a, b) -> float:
    if a[0][0] == b[0][0]:
        return 1.0
    common = sum((a[1] & b[1]).values())
    return min(2 * common / (a[2] + b[2]), 1 - 1e-9)


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the part of segments (with repeats) that the two have in common, below 1."""
    return _likeness(_known(parse(a)), _known(parse(b)))


def _differing(a, b) -> list[tuple[int, int]]:
    if a[0] == b[0]:
        return []
    whole = Counter(digest for digest, _ in b[1])
    rest = []
    for i, (digest, _) in enumerate(a[1]):
        if whole[digest]:
            whole[digest] -= 1
        else:
            rest.append(i)
    left: Counter = Counter()
    for digest, paragraphs in b[1]:
        if whole[digest]:
            whole[digest] -= 1
            left.update(paragraphs)
    out = []
    for i in rest:
        for j, p in enumerate(a[1][i][1]):
            if left[p]:
                left[p] -= 1
            else:
                out.append((i, j))
    return out


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """Where a text differs from another: (section, paragraph) of a's paragraphs that b lacks, by descending only into sections whose digests differ."""
    return _differing(parse(a), parse(b))


def fingerprint(column):
    """Column of fingerprints of a text column."""

    @F.arrow_udf("string")
    def run(texts):
        import pyarrow as pa

        return pa.array(in_slices(texts, lambda t: render(*tree(t))), pa.string())

    return run(column)


def edited_fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text (the last third of its code points replaced by the first as many of
    the next document, in descending order of ids; after the last comes the first), with both likenesses.

    Returns id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_differing (paragraphs of the edited text that the
    text lacks) and first_differing (``section.paragraph`` of the first of them, null without any). Null and empty texts are
    equal; a single document is its own next; an empty table gives no rows. Null ids come last in descending order; equal ids are ordered by the
    texts' hashes; ids that are no whole numbers raise; further columns are not carried. One shuffle by ranges of ids, where an id (or null)
    with many rows takes several ranges of the texts' hashes; a range also gets the last row of the range below it.
    """
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_differing long, first_differing string"
    spark = df.sparkSession
    rows = small_batches(df).select(whole_numbers(df, id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text")).withColumn("h", text_hash("text"))
    bounds = range_bounds(rows, "id", n_partitions(spark))
    n = len(bounds) + 1
    placed = rows.withColumn("bucket", range_bucket(F.col("id"), F.col("h"), bounds))
    # the greatest row of each range, a few bytes each, at most one for each range
    tops = sorted((r["bucket"], r["top"]["known"], r["top"]["id"], r["top"]["h"]) for r in placed.groupBy("bucket").agg(F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("top")).collect())
    if not tops:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_column)
    goes = spark.createDataFrame([(k, i, h, tops[(at + 1) % len(tops)][0]) for at, (k, _, i, h) in enumerate(tops)], "bucket int, top_id long, top_h long, goes_to int")
    # at most one row for each range: small enough to broadcast at any size of the input
    same = (placed.bucket == goes.bucket) & placed.id.eqNullSafe(goes.top_id) & (placed.h == goes.top_h)
    carried = placed.select("id", "text", "h", "bucket").join(F.broadcast(goes), same, "left").select(
        F.explode(F.when(F.col("goes_to").isNull(), F.array(F.struct(placed.bucket.alias("bucket"), F.lit(1).alias("own")))).otherwise(F.array(F.struct(placed.bucket.alias("bucket"), F.lit(1).alias("own")), F.struct(F.col("goes_to").alias("bucket"), F.lit(0).alias("own"))))).alias("at"),
        "id", "text", "h",
    )
    sorted_rows = carried.select("at.bucket", "at.own", "id", "text", "h").repartitionById(n, "bucket").sortWithinPartitions("bucket", "own", F.col("id").asc_nulls_first(), "h")

    def run(batches):
        import hashlib

        import pyarrow as pa

        before = bucket = None  # of the row before: text and what is known of it
        for batch in slices(batches):
            out = []
            for at, own, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if at != bucket:
                    bucket, before = at, None
                mine = text, _known(tree(text))
                if own:
                    after, known_after = before
                    k = len(text) // 3
                    edited = text[: len(text) - k] + after[:k]
                    known = _known(tree(edited))
                    where = _differing(known[0], mine[1][0])
                    first = f"{where[0][0]}.{where[0][1]}" if where else None
                    sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    out.append((doc_id, len(text), sha, render(*mine[1][0]), render(*known[0]), _likeness(mine[1], known), _likeness(mine[1], known_after), len(where), first))
                before = mine
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    import pyarrow as pa

    names = [part.split()[0] for part in schema.split(", ")]
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[part.split()[1]] for part in schema.split(", ")]
    return sorted_rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def op2_merkle(spark, sf_dir):
    """Fingerprints of all documents and their edited texts."""
    return edited_fingerprints(read(spark, sf_dir, "documents"))
