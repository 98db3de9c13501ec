"""Language identification by the nearest of several clustered centroids of TF-IDF n-gram vectors."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import crc32_of_id, fresh, in_slices, read, small_batches

#: Hashed n-grams of 1 to 3 letters; centroids of a language.
DIM, CENTROIDS = 4096, 3
#: Bound of the training sample: documents of a language, and of all languages together.
PER_LANGUAGE, IN_ALL = 400, 8000
#: A document is rejected if its cosine with the nearest centroid is below this part of the least that the centroid's own
#: training documents have, or if it has no letter. On sf0.1 two of 10,000 documents are below 0.4 (one word, and shouted junk), 13 below 0.63;
#: random letters are at 0.23 to 0.26, random consonants at 0.19 to 0.22, unseen languages in Latin script at 0.17 to 0.71.
REJECT_BELOW = 0.4
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters():
    """For each code point of the basic plane, itself in lower case if it is a letter, else a space."""
    import numpy as np

    table = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        x = chr(c)
        if not 0xD800 <= c < 0xE000 and x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return table


def counts(text: str | None):
    """Counts of hashed n-grams over the whole text (float32), or None if it has no letter. Other characters count as one space."""
    import numpy as np

    if not text:
        return None
    out = np.zeros(DIM, np.float32)
    table, some, tail = _letters(), False, np.array([32], np.uint32)
    for i in range(0, len(text), 1 << 20):  # bounded working memory; n-grams across the cut are counted by the tail
        c = np.frombuffer(text[i : i + (1 << 20)].encode("utf-32-le", "surrogatepass"), np.uint32)
        far = c >= 1 << 16
        low = table[np.where(far, 32, c)]
        if far.any():
            low = np.where(far & np.array([chr(x).isalpha() for x in c.tolist()]), c, low)
        some = some or bool((low != 32).any())
        c = np.concatenate([tail, low] + ([np.array([32], np.uint32)] if i + (1 << 20) >= len(text) else []))
        c = c[np.concatenate([[True], (c[1:] != 32) | (c[:-1] != 32)])]
        h1 = c * np.uint32(2654435761)
        h2 = (h1[:-1] ^ (c[1:] * np.uint32(2246822519))) * np.uint32(3266489917)
        h3 = (h2[:-1] ^ (c[2:] * np.uint32(668265263))) * np.uint32(374761393)
        for h in (h1, h2, h3):
            out += np.bincount((h >> np.uint32(20)).astype(np.intp), minlength=DIM)
        tail = c[-2:]
    return out if some else None


class Model:
    """Centroids by language, the inverse document frequencies and the least own cosine of each centroid."""

    def __init__(self, idf, centroids, languages: list[str], least):
        self.idf, self.centroids, self.languages, self.least = idf, centroids, languages, least

    def vector(self, n):
        import numpy as np

        v = np.log1p(n) * self.idf
        norm = float(np.linalg.norm(v))
        return v / norm if norm else v

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, cosine from 0 to 1, rejected)."""
        n = counts(text)
        if n is None or not len(self.languages):
            return UNKNOWN, 0.0, True
        cos = self.centroids @ self.vector(n)
        k = int(cos.argmax())
        return self.languages[k], float(min(max(cos[k], 0.0), 1.0)), bool(cos[k] < REJECT_BELOW * self.least[k])


def cluster(x, k: int, rounds: int = 10):
    """Spherical k-means; starts from the vector nearest to the mean, then each time one far from those chosen: farther than nine in ten
    others, but no outlier."""
    import numpy as np

    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=-1, keepdims=True), 1e-12)
    start = [int((x @ x.mean(axis=0)).argmax())]
    while len(start) < min(k, len(x)):
        start.append(int(np.argsort((x @ x[start].T).max(axis=1), kind="stable")[len(x) // 10]))
    c = unit(x[start])
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = unit(np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))]))
    return c, (x @ c.T).argmax(axis=1)


def fit(rows: list[tuple[str, bytes]]) -> Model:
    """Of (language, float32 counts of a document)."""
    import numpy as np

    rows = sorted(rows)
    if not rows:
        return Model(np.zeros(DIM, np.float32), np.zeros((0, DIM), np.float32), [], np.zeros(0))
    x = np.stack([np.frombuffer(b, np.float32) for _, b in rows])
    idf = (np.log((1 + len(x)) / (1 + (x > 0).sum(axis=0))) + 1).astype(np.float32)
    model = Model(idf, None, [], None)
    x = np.stack([model.vector(v) for v in x])
    langs = np.array([lang for lang, _ in rows])
    centroids, names, least = [], [], []
    for lang in sorted(set(langs)):
        own = x[langs == lang]
        c, member = cluster(own, CENTROIDS)
        for j in range(len(c)):
            if (member == j).any():
                centroids.append(c[j])
                names.append(str(lang))
                least.append(float(np.quantile((own[member == j] @ c[j]), 0.01)))
    return Model(idf, np.stack(centroids), names, np.array(least))


def train(df: DataFrame, lang_column: str = "lang", text_column: str = "text", per_language: int = PER_LANGUAGE, in_all: int = IN_ALL) -> Model:
    """Fit on at most ``in_all`` labelled texts, the same number of each language (``per_language``, or fewer where there are many languages, but at
    least CENTROIDS; all that a smaller one has), chosen by the text's hash. Every language is learned: more of them than in_all / CENTROIDS
    raise. Texts without a language or a letter are left out; equal texts count once. What reaches the driver is bounded by ``in_all`` vectors."""
    rows = small_batches(df).where(F.col(lang_column).isNotNull() & F.col(text_column).isNotNull()).select(F.col(lang_column).alias("lang"), F.col(text_column).alias("text"), F.xxhash64(F.lit("train"), F.col(text_column)).alias("h"))
    sizes = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    n = {r["lang"]: r["n"] for r in sizes.limit(in_all // CENTROIDS + 1).collect()}
    if not n:
        return fit([])
    if len(n) * CENTROIDS > in_all:
        raise ValueError(f"more than {in_all // CENTROIDS} languages: give a larger in_all")
    each = max(CENTROIDS, min(per_language, in_all // len(n)))
    # a part of each language that has surely enough, then exactly ``each`` of those, found before they are sent
    part = df.sparkSession.createDataFrame([(lang, min(1.0, (1.5 * each + 40) / k)) for lang, k in n.items()], "lang string, part double")
    chosen = rows.join(F.broadcast(part), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("part") * (1 << 30))

    @F.arrow_udf("binary")
    def vectors(texts):
        import pyarrow as pa

        found = in_slices(texts, counts)
        return pa.array([None if v is None else v.tobytes() for v in found], pa.binary())

    found = chosen.withColumn("v", vectors.asNondeterministic()("text")).where("v is not null").groupBy("lang", "h").agg(F.first("v").alias("v"))
    first = found.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("h"))).where(F.col("k") <= each)
    return fit([(r["lang"], bytes(r["v"])) for r in first.select("lang", "v").collect()])


def predict(df: DataFrame, model: Model, text_column: str = "text"):
    """``df`` with ``lang_pred``, ``lang_score`` (cosine) and ``lang_rejected``; only the text is looked at. Null texts and texts
    without a letter get ``und``, score 0 and are rejected. Columns of these names in the input are replaced. No shuffle."""
    sent = df.sparkSession.sparkContext.broadcast(model)  # CENTROIDS vectors of a language

    @F.arrow_udf("lang string, score double, rejected boolean")
    def run(texts):
        import pyarrow as pa

        found = in_slices(texts, sent.value.predict)
        return pa.StructArray.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.float64(), pa.bool_()))], names=["lang", "score", "rejected"])

    (p,) = fresh(df, "p")
    out = small_batches(df).withColumn(p, run.asNondeterministic()(F.col(text_column)))
    return out.withColumns({"lang_pred": F.col(f"{p}.lang"), "lang_score": F.col(f"{p}.score"), "lang_rejected": F.col(f"{p}.rejected")}).drop(p)


def for_training(df: DataFrame) -> DataFrame:
    return df.where(crc32_of_id() % 3 != 1)


def op7_language_id(spark, sf_dir):
    """doc_id, held_out, lang_pred, score, rejected of every whole document."""
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), train(for_training(docs)))
    return found.select("doc_id", (crc32_of_id() % 3 == 1).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))
