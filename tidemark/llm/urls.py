"""URL filter: host and path rules, and for the rest a logistic regression on hashed character n-grams."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import lru_cache
from zlib import crc32

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, read

#: Hashed features, n-gram lengths, and the score from which a URL is blocked: of 0.05, 0.1, ... the least at which at most one in a hundred wanted
#: URLs of the labelled table is blocked when scored by a fit without its name's fold (``cross_validated``).
DIM, GRAMS, BLOCK_AT = 1 << 14, (3, 4, 5), 0.5
#: The rules of the query: (verdict, host, start of the path).
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))
#: Words of unwanted names, words of wanted names, words that join either, and further wanted names of one word. Common words, no hosts of a table.
_UNWANTED = "casino poker jackpot roulette betting bets viagra pills meds porn sex adult escort dating loan lottery prizes ads popup tracker spam malware phishing replica".split()
_WANTED = "library museum weather garden school cooking history music theatre recipes travel science hospital football market university parliament newspaper railway mountain poetry chess orchestra records".split()
_JOINED = "town best royal city home world first direct".split()
_PLAIN = """river forest bridge village airport church kitchen painting language physics chemistry harbour island festival bakery cycling swimming astronomy geography
    medicine engineering furniture photography architecture literature philosophy economics agriculture sailing climate volunteer community heritage workshop
    stadium pottery carpentry glacier observatory aquarium botany archive gallery cinema ceramics""".split()
_FORMS = ("https://www.{}.example.{}/{}/{}", "http://blog.{}.example.{}/{}/{}.html", "https://{}.example.{}/{}/{}/", "http://m.{}.example.{}/{}/{}?page=2")
FOLDS = 3


def _compounds(words: list[str]) -> list[str]:
    """Each word in three names, with the same other words for wanted and unwanted ones."""
    n = len(_JOINED)
    return [name for i, w in enumerate(words) for name in (f"{_JOINED[i % n]}-{w}", f"{w}-{_JOINED[(i + 3) % n]}", f"{w}{_JOINED[(i + 5) % n]}")]


def training_table() -> list[tuple[str, int]]:
    """The small labelled URL table (1: unwanted): every name in two forms, with ends and languages dealt evenly over both classes. The name at
    place i, and so the URLs at 2 * i and 2 * i + 1, is of fold i % FOLDS; the three names of a word are of three folds."""
    out = []
    for names, label in ((_compounds(_UNWANTED), 1), (_compounds(_WANTED), 0), (_PLAIN, 0)):
        for i, name in enumerate(names):
            for j in (i % 4, (i + 1) % 4):
                out.append((_FORMS[j].format(name, ("com", "net", "org")[(i + j) % 3], ("en", "fr", "de", "es")[(i + 2 * j) % 4], 100 + 37 * i + j), label))
    return out


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null and without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    end = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    path = rest[end:]
    stop = min((k for k in map(path.find, "?#") if k >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


_LOWER = {c: c + 32 for c in range(65, 91)}


def features(host: str, path: str) -> dict[int, float]:
    """Hashed counts of character n-grams, host and path apart, of unit length."""
    counts: dict[int, float] = {}
    for part, text in (("h", f"^{host}$"), ("p", f"^{path}$")):
        for n in GRAMS:
            for i in range(len(text) - n + 1):
                k = crc32(f"{part}{n}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % DIM
                counts[k] = counts.get(k, 0.0) + 1
    norm = sum(v * v for v in counts.values()) ** 0.5
    return {k: v / norm for k, v in counts.items()} if norm else {}


def fit(table: Sequence[tuple[str, int]], steps: int = 600, rate: float = 4.0, l2: float = 1e-4):
    """(weights, bias) by full-batch gradient descent with momentum; for the small labelled table only, on the driver."""
    import numpy as np

    x = np.zeros((len(table), DIM), np.float64)
    for i, (url, _) in enumerate(table):
        for k, v in features(*split_url(url)).items():
            x[i, k] = v
    y = np.array([label for _, label in table], np.float64)
    used = np.flatnonzero(x.any(axis=0))
    z = x[:, used]
    w, b, vw, vb = np.zeros(len(used)), 0.0, np.zeros(len(used)), 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ w + b)))
        vw = 0.9 * vw - rate * (z.T @ (p - y) / len(y) + l2 * w)
        vb = 0.9 * vb - rate * float((p - y).mean())
        w, b = w + vw, b + vb
    out = np.zeros(DIM)
    out[used] = w
    return out, b


def probability(model, host: str, path: str) -> float:
    """The chance that a URL is unwanted."""
    weights, bias = model
    z = bias + sum(float(weights[k]) * v for k, v in features(host, path).items())
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


def cross_validated(table: Sequence[tuple[str, int]]) -> list[tuple[float, int]]:
    """(score, label) of each URL, by a fit on the names of the other folds."""
    out = []
    for fold in range(FOLDS):
        model = fit([row for i, row in enumerate(table) if i // 2 % FOLDS != fold])
        out += [(probability(model, *split_url(url)), label) for i, (url, label) in enumerate(table) if i // 2 % FOLDS == fold]
    return out


@lru_cache(maxsize=1)
def _default_model():
    return fit(training_table())


def host_path(url: Column) -> tuple[Column, Column]:
    """The same split as ``split_url`` in Spark."""
    has = F.coalesce(F.instr(url, "://"), F.lit(0)) > 0
    rest = F.when(has, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"(?s)\A([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"(?s)\A[^/?#]*(/[^?#]*)", 1)


def judge(df: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, table: Sequence[tuple[str, int]] | None = None, url_column: str = "url") -> DataFrame:
    """``df`` with host, path, rule, verdict and ``score`` (probability that the method blocks).

    The longest rule that fits decides; else the method: block from BLOCK_AT. Null URLs and those without ``://`` have empty host and path; no rule fits
    them, and the method judges the empty strings. Columns of these names in the input are replaced. No shuffle; URLs of any length
    are scored whole.
    """
    weights, bias = _default_model() if table is None else fit(table)
    sent = df.sparkSession.sparkContext.broadcast((weights.astype("f4"), float(bias)))  # DIM numbers, whatever the input

    @F.arrow_udf("double")
    def score(hosts, paths):
        import pyarrow as pa

        known: dict[tuple, float] = {}
        out = []
        for key in zip(hosts.to_pylist(), paths.to_pylist(), strict=True):
            if key not in known:
                known[key] = probability(sent.value, *key)
            out.append(known[key])
        return pa.array(out, pa.float64())

    host, path = host_path(F.col(url_column))
    out = df.withColumns({"host": host, "path": path})
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), r[1], r[2])):  # the longest last, so it decides
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    (decided,) = fresh(out, "decided")
    out = out.withColumn("score", score("host", "path")).withColumns({"rule": rule, decided: verdict})
    return out.withColumn("verdict", F.coalesce(decided, F.when(F.col("score") >= BLOCK_AT, "block").otherwise("allow"))).drop(decided)


def op4_url_filter(spark, sf_dir):
    """page_id, host, path, rule, verdict, score of every page."""
    return judge(read(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
