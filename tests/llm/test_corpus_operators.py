"""Operators on whole corpora, and the pipeline."""

import math
import os
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, language, mixing, simhash

SF = "/root/testdata/sf0.001"
#: Has enough labels to hold some out.
LABELLED = "/root/testdata/sf0.01"
#: Has enough documents for centroids that are near those of larger tables.
LARGER = "/root/testdata/sf0.1"


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    n = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * n[b] > len(shingles))


def brute_roots(prints, radius=4):
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, p in enumerate(prints):
        for j in range(i):
            if (p ^ prints[j]).bit_count() <= radius:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    rnd, masks = random.Random(1), simhash.masks()
    assert len(masks) == 31
    for _ in range(3000):
        differing = sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4)))
        assert any(not m & differing for m in masks)


def test_components_equal_brute_force(spark):
    rnd = random.Random(2)
    edges = [(rnd.randint(0, 300), rnd.randint(0, 300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(100)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("direct", [4096, 3])
def test_links_connect_what_brute_force_connects(spark, direct):
    rnd = random.Random(3)
    centres = [rnd.getrandbits(64) for _ in range(12)]
    prints = list({c ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 5))) for c in centres for _ in range(25)})
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = components.components(simhash.links(df, direct=direct)).collect()
    label = {r["node"] % (1 << 64): r["component"] for r in found}
    roots = brute_roots(prints)
    got = {}
    for p, r in zip(prints, roots, strict=True):
        got.setdefault(r, set()).add(label.get(p, ("alone", p)))
    assert all(len(v) == 1 for v in got.values()) and len({next(iter(v)) for v in got.values()}) == len(got)


def test_near_duplicates(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [None, "", " \n", "a", "A", "a b c", base, base + " end", base.upper(), "other words than those " * 50, base, None]
    ids = [9, 8, 7, 20, 21, 22, 33, 30, 31, 40, 33, None]
    df = spark.createDataFrame([(i, t, "clash") for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, fp string")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == len(texts)
    prints = [brute_print(t) for t in texts]
    assert sorted(r["fingerprint"] % (1 << 64) for r in out) == sorted(prints)
    roots = brute_roots(prints)
    least = {r: min(i for i, x in zip(ids, roots, strict=True) if x == r and i is not None) for r in set(roots)}
    want = sorted((str(i), least[r]) for i, r in zip(ids, roots, strict=True))
    assert sorted((str(r["doc_id"]), r["component_id"]) for r in out) == want
    kept = simhash.deduplicate(df).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values()) and all(r["fp"] == "clash" for r in kept)
    assert simhash.near_duplicates(df.limit(0)).collect() == [] and simhash.deduplicate(df.limit(0)).collect() == []
    nobody = simhash.deduplicate(spark.createDataFrame([(None, "a"), (None, "a"), (None, "zz y x w v")], "doc_id long, text string")).collect()
    assert len(nobody) == 2


def test_components_that_share_their_smallest_id_keep_a_row_each(spark):
    one, two = " ".join(f"w{i}" for i in range(400)), "other words than those " * 50
    df = spark.createDataFrame([(1, one), (1, two), (2, one), (3, two)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicates(df).collect()} == {1}
    assert sorted(map(tuple, simhash.deduplicate(df).collect())) == sorted([(1, one), (1, two)])


def poisson_count(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while total < u and k < 10_000:
        k += 1
        p *= mean / k
        total += p
    return k


def test_mixing(spark):
    rows = [(i, "x" * (50 + i % 7), "hot" if i % 3 else "rare", 1) for i in range(900)] + [(5000, None, None, 1), (5001, "", "empty", 1), (5001, "", "empty", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_copies int")
    out = mixing.mix(df, {"hot": 1.0, "rare": 3.0}).collect()
    means = {r["__source"]: r["mean"] for r in mixing.rates(df, {"hot": 1.0, "rare": 3.0}).collect()}
    sizes = {s: sum(len(t or "") for _, t, x, _ in rows if x == s) for s in ("hot", "rare")}
    assert means["rare"] == pytest.approx(0.75 * sum(sizes.values()) / sizes["rare"]) and means[None] == 0 and means["empty"] == 0
    import hashlib

    got = {}
    for r in out:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    for i, t, s, _ in rows[:900]:
        h = hashlib.md5(f"0|{i}|{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()
        assert got.get(i, 0) == poisson_count(means[s], (int(h[:12], 16) + 0.5) / (1 << 48))
    n = [0, 0]
    for r in out:
        n[r["source"] == "rare"] += len(r["text"])
    assert n[1] / sum(n) == pytest.approx(0.75, abs=0.05)
    assert mixing.mix(df.limit(0)).collect() == [] and mixing.mix(df, {}).collect() == []
    # a large mean does not underflow
    big = mixing.mix(spark.createDataFrame([(1, "a", "few", 1)] + [(i, "b" * 1000, "many", 1) for i in range(2, 4)], df.schema).select("doc_id", "text", "source"), {"few": 1.0, "many": 1.0})
    assert 850 < sum(r["source"] == "few" for r in big.collect()) < 1150


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_pipeline_against_its_stages(spark):
    import corpus_pipeline as p

    from tidemark.llm import bpe, language, rules
    from tidemark.llm.common import materialize, read

    assert [n for n, _ in p.STAGES] == ["language_id", "quality_classifier", "near_dedup", "mix_sources", "bpe_encode"] and p.ORACLE_SQL is None
    docs, kept = read(spark, SF, "documents"), []
    for name, stage in p.STAGES[:-1]:
        after = materialize(stage(spark, docs, SF), name)
        assert after.columns == docs.columns
        kept.append((docs.collect(), after.collect()))
        docs = after
    (a, b), (c, d), (e, f), (g, h) = kept
    model = language.train(language.for_training(read(spark, SF, "documents")))
    assert {r["doc_id"] for r in b} == {r["doc_id"] for r in a if not model.predict(r["text"])[2]}
    ensemble = rules.trained(spark, SF)
    from tidemark.llm.statistics import vector

    x = np.array([vector(r["text"]) for r in c])
    z = ensemble[2] + sum(w * rules.fires(r, x) for r, w in zip(ensemble[0], ensemble[1], strict=True))
    assert {r["doc_id"] for r in d} == {r["doc_id"] for r, s in zip(c, 1 / (1 + np.exp(-z)), strict=True) if s >= rules.ACCEPT_AT}
    roots = brute_roots([brute_print(r["text"]) for r in e])
    assert {r["doc_id"] for r in f} == {min(r["doc_id"] for r, x in zip(e, roots, strict=True) if x == k) for k in set(roots)}
    assert {r["doc_id"] for r in h} <= {r["doc_id"] for r in g}
    done = p.STAGES[-1][1](spark, docs, SF).collect()
    enc = bpe.encoder(p.public_tokenizers.path("byte_bpe_50k.json"))
    text = {r["doc_id"]: r["text"] for r in h}
    assert len(done) == len(h) and all(enc.decode(bytes(r["ids"])) == text[r["doc_id"]] for r in done)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op6_licence_scan", "op8_poisson_mix"])
def test_oracle(spark, name):
    import duckdb

    from tidemark.llm import queries

    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", ["op7_language_id", "op9_rule_ensemble"])
def test_held_out_accuracy(spark, name):
    from tidemark.llm import queries

    out = queries.QUERIES[name](spark, LABELLED).where("held_out")
    if name == "op7_language_id":
        r = out.join(spark.read.parquet(f"{LABELLED}/documents.parquet"), "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    else:
        r = out.join(spark.read.parquet(f"{LABELLED}/labels.parquet"), "doc_id").agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0]
    assert r >= 0.9


def test_tables_do_not_grow_with_the_mean(spark):
    """Means of about 5,000 and 2,000,000: a table of a bounded length, and the sum of the parts' counts."""
    import hashlib

    rows = [(1, "a", "few"), (2, "b" * 9_999, "many")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    rates = {r["__source"]: r for r in mixing.rates(df).collect()}
    mean, parts = rates["few"]["mean"], 4
    assert mean == 5000 and len(rates["few"]["cdf"]) < 2000
    us = [(int(hashlib.md5(f"0|1|{hashlib.md5(b'a').hexdigest()}{x}".encode()).hexdigest()[:12], 16) + 0.5) / (1 << 48) for x in ("", "|1", "|2", "|3")]
    c, t, cdf = 0.0, -mean / parts, []
    for k in range(2000):
        c += math.exp(t)
        cdf.append(c)
        t += math.log(mean / parts / (k + 1))
    want = sum(sum(x < u for x in cdf) for u in us)
    assert mixing.mix(df).where("source = 'few'").count() == want and 4500 < want < 5500
    tiny = spark.createDataFrame([(1, "a", "few"), (2, "b" * 4_000_000, "many")], df.schema)
    n = mixing.mix(tiny, shuffle=False).where("source = 'few'").select("n_copies").first()[0]
    assert abs(n - 2_000_000) < 10_000


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="no tables")
def test_text_in_no_known_language_is_rejected(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet")
    model = language.train(language.for_training(docs))
    rnd = random.Random(1)
    letters = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(2, 9))) for _ in range(200))
    polish = "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa."
    assert model.predict(letters)[2] and model.predict(polish)[2]
    assert language.predict(docs, model).where("lang_rejected").count() <= 5  # of 10,000; the texts without a letter would count as well


def test_rows_of_hot_keys_are_joined_where_they_are(spark):
    from tidemark.llm.common import HOT_SHARE, join_counted

    rows = spark.range(50_000).select((F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id"))).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("low"))
    assert table.where(F.col("n") > 50_000 // HOT_SHARE).count() == 1
    out = join_counted(rows, table, "k", 50_000)
    assert out.count() == 50_000 and out.where("k = -1 and low <> 0 or k <> -1 and low <> k").isEmpty()
    assert join_counted(rows.limit(0), table.limit(0), "k", 0).collect() == []


def test_many_equal_rows_and_ids_of_any_type(spark):
    """A third of the rows is one text without an id; a column clashes; ids are strings; an id is the least long."""
    one, two = " ".join(f"w{i}" for i in range(400)), "other words than those " * 50
    rows = [(None, one, 1)] * 30_000 + [(str(i), f"{i} " + two, 2) for i in range(3)] + [("z", one, 3)]
    df = spark.createDataFrame(rows, "doc_id string, text string, k int")
    assert sorted((r["doc_id"], r["k"]) for r in simhash.deduplicate(df).collect()) == [("0", 2), ("z", 3)]
    low = spark.createDataFrame([(-(1 << 63), "a b c d e f"), (None, "zz y x w v u"), (None, "zz y x w v u")], "doc_id long, text string")
    assert sorted(map(str, (r["doc_id"] for r in simhash.deduplicate(low).collect()))) == [str(-(1 << 63)), "None"]


def test_many_copies_are_dealt_out_in_blocks(spark, monkeypatch):
    rows = [(1, "a", "few", 9), (None, "a", "few", 8), (2, "b" * 9_999, "many", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, __u int")
    want = sorted(map(repr, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "COPIES", 100)
    assert sorted(map(repr, mixing.mix(df).collect())) == want and any(r["__u"] == 9 for r in mixing.mix(df).collect())
    monkeypatch.setattr(mixing, "GREATEST_MEAN", 100)
    with pytest.raises(ValueError, match="refused"):
        mixing.mix(df)
    same = spark.createDataFrame([(None, "ab", "s")] * 4000, "doc_id long, text string, source string").repartition(8)
    sizes = mixing.mix(same.unionByName(spark.range(9_000).select(F.col("id").alias("doc_id"), F.lit("cd").alias("text"), F.lit("t").alias("source")))).groupBy(F.spark_partition_id()).count().collect()
    assert max(r["count"] for r in sizes) < 2 * sum(r["count"] for r in sizes) / 4


def test_every_language_is_learned(spark):
    rows = [(i, chr(0x4E00 + i % 2000) * 5 + chr(0x4E00 + i % 2000 + 1), f"l{i % 2000}") for i in range(6000)] + [(10_000 + i, f"q{i}", "l0") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(docs)
    assert len(set(model.languages)) == 2000
    with pytest.raises(ValueError, match="languages"):
        language.train(docs, in_all=3000)


def test_language_model_equals_brute_force():
    """Counts, TF-IDF, cosines and the cut, by their formulas."""
    rnd = random.Random(5)
    words = {"xx": "kalo miru senta pola vireni".split(), "yy": "thzgrt brkk shtrum wnflk grrzt".split()}
    texts = [(x, " ".join(rnd.choice(words[x]) for _ in range(30))) for x in ("xx", "yy") * 30]

    def brute(t):
        s = re.sub(r"[^a-z]+", " ", " " + t.lower() + " ")
        out = np.zeros(language.DIM)
        m = 1 << 32
        for n in (1, 2, 3):
            for i in range(n - 1 if n > 1 else 1, len(s) if n > 1 else len(s)):
                c = [ord(x) for x in s[i - n + 1 : i + 1]]
                h = c[0] * 2654435761 % m
                if n > 1:
                    h = (h ^ c[1] * 2246822519 % m) * 3266489917 % m
                if n > 2:
                    h = (h ^ c[2] * 668265263 % m) * 374761393 % m
                out[h >> 20] += 1
        out[ord(" ") * 2654435761 % m >> 20] += 1
        return out

    for _, t in texts:
        assert (language.counts(t) == brute(t)).all()
    model = language.fit([(x, language.counts(t).tobytes()) for x, t in texts])
    n = np.array([brute(t) for _, t in texts])
    idf = np.log((1 + len(n)) / (1 + (n > 0).sum(axis=0))) + 1
    assert np.allclose(model.idf, idf) and np.allclose(np.linalg.norm(model.centroids, axis=1), 1)
    for _, t in [*texts, ("", "mirka thz pola"), ("", "zzz")]:
        v = np.log1p(brute(t)) * idf
        cos = model.centroids @ v / np.linalg.norm(v)
        lang, score, rejected = model.predict(t)
        assert lang == model.languages[int(cos.argmax())] and score == pytest.approx(cos.max(), abs=1e-5) and rejected == (cos.max() < language.REJECT_BELOW * model.least[int(cos.argmax())])


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and long texts, repeats, ties, rejected rows, a clashing column; and an empty table."""
    import corpus_pipeline as p

    rnd = random.Random(6)
    good = lambda: " ".join(rnd.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split()) + "." * (rnd.random() < 0.1) for _ in range(60))
    rows = [(i, good(), "xx", "s" if i % 3 else "t", 5) for i in range(60)] + [(100 + i, " ".join(["%%% zq&|x"] * 40 + [str(i)]), "xx", "s", 5) for i in range(20)]
    odd = [(None, None, None, None, None), (None, good(), None, None, None), (7, "", "xx", "s", 1), (200, "русский текст совсем другой", None, "s", 1), (201, "12 34", None, "s", 1), rows[3], rows[3], (3, rows[3][1], "xx", "t", 5), (300, " ".join(good() for _ in range(300)), None, "t", 1)]
    schema = "doc_id long, text string, lang string, source string, s int"
    for name, data in (("full", rows + odd), ("empty", [])):
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    full = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    first = p.language_id(spark, full, f"{tmp_path}/full")
    left = {(r["doc_id"], r["text"]) for r in full.collect()} - {(r["doc_id"], r["text"]) for r in first.collect()}
    assert left == {(None, None), (7, ""), (200, odd[3][1]), (201, "12 34")} and first.columns == full.columns
    second = p.quality(spark, first, f"{tmp_path}/full")
    assert all("%%%" not in r["text"] for r in second.collect()) and second.where("doc_id = 3").count() == 4
    third = p.near_dedup(spark, second, f"{tmp_path}/full")
    assert third.where("doc_id = 3").count() == 1 and third.where("doc_id is null").count() == 1
    done = p.run(spark, f"{tmp_path}/full").collect()
    assert {r["doc_id"] for r in done} <= {r["doc_id"] for r in third.collect()} and len(done) > 20
    assert p.encode(spark, full.where("doc_id = 300"), "").first()["n_tokens"] > 10_000
    assert p.run(spark, f"{tmp_path}/empty").collect() == []


def test_tables_of_a_scope_are_deleted(spark, tmp_path):
    from tidemark.llm.common import materialize, temporaries

    with temporaries():
        a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b", keep=True)
        assert a.count() == 3
    where = [x.materialized_path.removeprefix("file://") for x in (a, b)]
    assert not os.path.exists(where[0]) and os.path.exists(where[1]) and b.count() == 4
