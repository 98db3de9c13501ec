"""Quality classifier: a sparse ensemble of rules.

Shallow boosted trees over statistics of the text are grown on the labelled sample; every path from a root to a node is a conjunctive
rule. A logistic regression with an L1 penalty (proximal gradient) over the rules keeps few of them, and these are
compiled into one Spark column expression over the statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import crc32_of_id, fresh, in_slices, read, small_batches
from .statistics import NAMES, vector

#: Bound of the training sample (labelled documents), trees, their depth, the L1 penalty, its steps, and the fewest documents of a node.
SAMPLE, TREES, DEPTH, PENALTY, STEPS, LEAF = 20_000, 12, 3, 1e-3, 400, 3
#: A document with a lower score is rejected.
ACCEPT_AT = 0.3


def _grow(x, residual, hessian, cuts, bins, rows, depth, path, paths, out):
    """Split greedily, at the ``cuts`` of a statistic, by the gain of a Newton step; note the path of each node; add the leaves' steps to ``out``."""
    import numpy as np

    if path:
        paths.append(tuple(path))
    g, h = residual[rows].sum(), hessian[rows].sum() + 1.0
    best = (1e-6, None, None)
    if depth and len(rows) >= 2 * LEAF:
        for f in range(x.shape[1]):
            b = bins[rows, f]
            gl, hl = np.cumsum(np.bincount(b, residual[rows], 33)), np.cumsum(np.bincount(b, hessian[rows], 33)) + 1.0
            n = np.cumsum(np.bincount(b, minlength=33))
            gain = gl**2 / hl + (g - gl) ** 2 / np.maximum(h - hl + 1.0, 1e-9) - g * g / h
            gain[(n < LEAF) | (n > len(rows) - LEAF)] = 0
            if gain.max() > best[0]:
                best = (float(gain.max()), f, int(gain.argmax()))
    if best[1] is None:
        out[rows] += 0.5 * g / h
        return
    _, f, k = best
    cut, left = cuts[f][k], bins[rows, f] <= k
    for part, side in ((rows[left], "<="), (rows[~left], ">")):
        _grow(x, residual, hessian, cuts, bins, part, depth - 1, [*path, (f, side, cut)], paths, out)


def fires(rule, x):
    """Rows of statistics for which the rule holds."""
    import numpy as np

    ok = np.ones(len(x), bool)
    for f, side, cut in rule:
        ok &= x[:, f] <= cut if side == "<=" else x[:, f] > cut
    return ok


def fit(x, y) -> tuple[list[tuple], list[float], float]:
    """(rules, weights, bias) of statistics and labels 0 or 1. Without both labels there are no rules, and the bias gives the share of 1 (no rows: one half)."""
    import numpy as np

    x, y = np.asarray(x, np.float64).reshape(-1, len(NAMES)), np.asarray(y, np.float64)
    share = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    prior = float(np.log(share / (1 - share)))
    if len(set(y.tolist())) < 2:
        return [], [], prior
    cuts = [np.append(np.unique(np.quantile(x[:, f], np.linspace(0, 1, 33)[1:-1])), np.inf) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    at, paths = np.full(len(y), prior), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-at))
        step = np.zeros(len(y))
        _grow(x, y - p, p * (1 - p), cuts, bins, np.arange(len(y)), DEPTH, [], paths, step)
        at += step
    rules = list(dict.fromkeys(paths))
    if not rules:  # too few documents for a split
        return [], [], prior
    z = np.stack([fires(r, x) for r in rules], axis=1).astype(np.float64)
    mean = z.mean(axis=0)
    keep = (mean > 0) & (mean < 1)
    rules, z = [r for r, k in zip(rules, keep, strict=True) if k], z[:, keep]
    w, b = np.zeros(z.shape[1]), prior
    step = 4 / max(1.0, float(np.linalg.eigvalsh(z.T @ z / len(z)).max() + 1))
    u, c, t = w.copy(), b, 1.0  # accelerated proximal gradient
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(z @ u + c)))
        nw = u - step * (z.T @ (p - y) / len(y))
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * PENALTY, 0)
        nb, nt = c - step * float((p - y).mean()), (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    used = np.flatnonzero(np.abs(w) > 1e-4)
    return [rules[i] for i in used], [float(w[i]) for i in used], float(b)


def score_column(model, stats: Column) -> Column:
    """The probability of label 1 as an expression over the struct of statistics."""
    rules, weights, bias = model
    z = F.lit(bias)
    for rule, w in zip(rules, weights, strict=True):
        holds = None
        for f, side, cut in rule:
            one = stats[NAMES[f]] <= float(cut) if side == "<=" else stats[NAMES[f]] > float(cut)
            holds = one if holds is None else holds & one
        z = z + F.when(holds, F.lit(w)).otherwise(F.lit(0.0))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def statistics_of(column: Column) -> Column:
    """Struct of the statistics of a text column."""

    @F.arrow_udf(", ".join(f"{n} double" for n in NAMES))
    def run(texts):
        import numpy as np
        import pyarrow as pa

        m = np.array(in_slices(texts, vector), np.float64).reshape(-1, len(NAMES))
        return pa.StructArray.from_arrays([pa.array(m[:, i].copy()) for i in range(len(NAMES))], names=list(NAMES))

    return run.asNondeterministic()(column)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text"):
    """Fit on at most ``sample`` labelled ids, chosen by the id's hash. Labels that are null and ids without a text row are left out;
    a repeated id counts once, with its least label and text."""
    chosen = labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("labelled")).agg(F.min(label).alias("y")).orderBy(F.xxhash64("labelled"), "labelled").limit(sample)
    # at most ``sample`` rows of 12 bytes: small enough to broadcast at any size of the input
    texts = small_batches(docs).select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    found = texts.join(F.broadcast(chosen), F.col("id") == F.col("labelled")).select("id", "y", statistics_of(F.col("text")).alias("s"))
    rows = found.groupBy("id").agg(F.min("y").alias("y"), F.min("s").alias("s")).collect()
    rows.sort(key=lambda r: r["id"])
    return fit([list(r["s"]) for r in rows], [r["y"] for r in rows])


def score(df: DataFrame, model, text_column: str = "text") -> DataFrame:
    """``df`` with ``quality_score`` (0 to 1); only the text is looked at, null as the empty text. A column of this name in the input is
    replaced. No shuffle."""
    (s,) = fresh(df, "s")
    return small_batches(df).withColumn(s, statistics_of(F.col(text_column))).withColumn("quality_score", score_column(model, F.col(s))).drop(s)


def trained(spark, sf_dir: str):
    """The model of the labelled documents that are not held out."""
    labels = read(spark, sf_dir, "labels")
    return train(read(spark, sf_dir, "documents").select("doc_id", "text"), labels.where(crc32_of_id() % 5 != 0))


def op9_rule_ensemble(spark, sf_dir):
    """doc_id, held_out, score, predicted of every whole document."""
    found = score(read(spark, sf_dir, "documents").select("doc_id", "text"), trained(spark, sf_dir))
    return found.select("doc_id", (crc32_of_id() % 5 == 0).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= ACCEPT_AT).cast("int").alias("predicted"))
