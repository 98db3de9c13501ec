"""Quality rules: plain counts, and the log-likelihood ratio of hashed n-grams between trusted texts and the whole corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, in_slices, read, slices, small_batches
from .statistics import counts

#: Buckets of hashed n-grams, the smoothing of a bucket, and the ratio per n-gram below which a document is dropped.
DIM, SMOOTH, KEEP_AT = 1 << 15, 1.0, -0.3
#: Ids of documents labelled good that are broadcast at once (8 bytes each). More of them take more scans, so that all are counted.
BLOCK = 5_000_000
#: Base rules: fewest words, and most words of a hundred that stand in repeated windows.
LEAST_WORDS, MOST_REPEATED = 50, 50


def grams(text: str | None):
    """Counts of hashed character n-grams (3 code points, case kept, digits as one) over the whole text."""
    import numpy as np

    out = np.zeros(DIM, np.int64)
    if not text:
        return out
    for i in range(0, len(text), 1 << 20):  # bounded working memory; the next part starts with the last two characters
        c = np.frombuffer(text[max(0, i - 2) : i + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.where((c >= 48) & (c < 58), np.uint32(48), c)
        if len(c) > 2:
            h = ((c[:-2] * np.uint32(2654435761) ^ c[1:-1]) * np.uint32(2246822519) ^ c[2:]) * np.uint32(3266489917)
            out += np.bincount((h >> np.uint32(17)).astype(np.intp), minlength=DIM)
    return out


def totals(df: DataFrame, flag: str, text_column: str = "text"):
    """Counts of every bucket over the rows where ``flag`` is true, and over all rows: one scan, 2 * DIM numbers of a task, summed
    before they reach the driver."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        total, flagged = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
        for batch in slices(batches):
            for t, good in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = grams(t)
                total += g
                if good:
                    flagged += g
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(flagged[at], pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "flagged", "n"])

    flagged, out = np.zeros(DIM, np.int64), np.zeros(DIM, np.int64)
    counted = small_batches(df).select(text_column, flag).mapInArrow(run, "bucket int, flagged long, n long")
    for r in counted.groupBy("bucket").agg(F.sum("flagged").alias("flagged"), F.sum("n").alias("n")).collect():
        flagged[r["bucket"]], out[r["bucket"]] = r["flagged"], r["n"]
    return flagged, out


def log_ratios(trusted, raw):
    """log of the trusted over the raw multinomial, by bucket; zeros if either has no n-gram."""
    import numpy as np

    if not trusted.sum() or not raw.sum():
        return np.zeros(DIM)
    p, q = trusted + SMOOTH * trusted.sum() / raw.sum(), raw + SMOOTH
    return np.log(p / p.sum()) - np.log(q / q.sum())


def judge(df: DataFrame, ratios, text_column: str = "text") -> DataFrame:
    """``df`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr (mean log ratio of an n-gram; 0 without
    any) and kept. Null texts have no words and fail. Columns of these names in the input are replaced. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(ratios)  # DIM numbers
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

    @F.arrow_udf(", ".join(f"{n} long" for n in names) + ", llr double")
    def run(texts):
        import pyarrow as pa

        def score(text):
            g = grams(text)
            return counts(text), float(g @ sent.value) / max(1, int(g.sum()))

        rows = in_slices(texts, score)
        found, llr = [c for c, _ in rows], [x for _, x in rows]
        return pa.StructArray.from_arrays([pa.array([f[n] for f in found], pa.int64()) for n in names] + [pa.array(llr, pa.float64())], names=[*names, "llr"])

    (j,) = fresh(df, "j")
    out = small_batches(df).withColumn(j, run.asNondeterministic()(F.col(text_column)))
    out = out.withColumns({n: F.col(f"{j}.{n}") for n in (*names, "llr")}).drop(j)
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= KEEP_AT))


def good_ids(labels: DataFrame) -> DataFrame:
    """``id``: the distinct ids labelled good, as longs."""
    return labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("id")).where("id is not null").distinct()


def with_trusted(docs: DataFrame, labels: DataFrame, block: int = 0, blocks: int = 1) -> DataFrame:
    """doc_id, text and ``good`` of ``docs``: whether the document is labelled good and its id falls into this one of ``blocks`` parts by hash. The ids
    of the part are broadcast as a sorted array, so no text is shuffled."""
    import numpy as np

    part = good_ids(labels).where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block)
    sent = docs.sparkSession.sparkContext.broadcast(np.sort(part.toArrow()["id"].to_numpy()))

    @F.arrow_udf("boolean")
    def known(ids):
        import pyarrow as pa

        at, all_ids = ids.fill_null(0).to_numpy(zero_copy_only=False), sent.value
        if not len(all_ids):
            return pa.array(np.zeros(len(at), bool))
        found = all_ids[np.minimum(np.searchsorted(all_ids, at), len(all_ids) - 1)] == at
        return pa.array(found & ids.is_valid().to_numpy(zero_copy_only=False))

    return docs.select("doc_id", "text", known(F.col("doc_id").cast("long")).alias("good"))


def trusted_and_raw(docs: DataFrame, labels: DataFrame, most: int = BLOCK):
    """Counts over all documents labelled good, and over all documents: one scan for each ``most`` good ids, of which only the first
    counts the other documents."""
    blocks = max(1, -(-good_ids(labels).count() // most))
    trusted, raw = totals(with_trusted(docs, labels, 0, blocks), "good")
    for block in range(1, blocks):
        trusted += totals(with_trusted(docs, labels, block, blocks).where("good"), "good")[0]
    return trusted, raw


def ratios_of(spark, sf_dir: str):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return log_ratios(*trusted_and_raw(docs, read(spark, sf_dir, "labels")))


def op10_likelihood_ratio(spark, sf_dir):
    """The counts, base_failed, llr and kept of every whole document."""
    found = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), ratios_of(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr")
