"""Queries of the operators on sung sounds and samples. An order is a voice, its lines are sounds; events are samples."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import constants, phonetics
from .operators import signal, singing
from .queries import LINE, events, query, read
from .queries import EVENTS as _EVENTS
from .queries_scalars import _BY, _LINES, entry, lines, numbers, sql_list, sql_map

_SOUNDS = ("A", "b", "A", "i", "_")


@query(f"""WITH RECURSIVE {_LINES}, v AS (SELECT l_orderkey AS o, row_number() OVER ({_BY}) AS k, {sql_list(_SOUNDS)}[(l_partkey % 5)::INT + 1] AS ph, l_linenumber * 10 + l_suppkey % 8 AS s, l_linenumber * 10 + l_suppkey % 8 + q % 15 AS e FROM r),
    w AS (SELECT DISTINCT o, 0::BIGINT AS k, 0::BIGINT AS cb, 0::BIGINT AS s, 0::BIGINT AS c, false AS silent, '' AS ph FROM v
        UNION ALL SELECT v.o, v.k, w.c, greatest(v.s, w.c), greatest(v.e, greatest(v.s, w.c) + 2), v.s > w.c + 1, v.ph FROM w JOIN v ON v.o = w.o AND v.k = w.k + 1),
    t AS (SELECT *, ph IN ('A', 'i') AND lag(ph) OVER z = ph AND NOT silent AND s - cb < 1 AS twice FROM w WINDOW z AS (PARTITION BY o ORDER BY k)), x AS (SELECT *, coalesce(lead(twice) OVER (PARTITION BY o ORDER BY k), false) AS cut FROM t)
    SELECT o AS l_orderkey, k, 1 AS part, ph AS phone, s AS start, c - CASE WHEN cut THEN 1 ELSE 0 END AS stop FROM x WHERE k > 0 UNION ALL SELECT o, k, 0, '_', cb, s FROM x WHERE k > 0 AND silent UNION ALL SELECT o, k, 0, '_', cb - 1, s FROM x WHERE k > 0 AND twice""")
def laid_out(spark, sf_dir):
    r = lines(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE)).cast("long"))
    start = (F.col("l_linenumber") * 10 + F.col("l_suppkey") % 8).cast("double")
    r = r.withColumns({"ph": entry(_SOUNDS, F.col("l_partkey")), "s": start, "e": start + F.col("q") % 15})
    found = singing.lay_out(r, ["l_orderkey"], ["k"], "ph", "s", "e", least=2.0, gap=1.0, pause=1.0)
    return found.select("l_orderkey", "k", F.col("slot").alias("part"), "phone", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("stop"))


_CONS = ("b", "m", "s", "N", "l", "tS")


@query(f"""WITH {_LINES}, v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, {sql_list(_CONS)}[(l_partkey % 6)::INT + 1] AS p, {sql_list(_CONS)}[(l_suppkey % 6)::INT + 1] AS c, CASE WHEN q % 2 = 0 THEN '@' ELSE 'i' END AS nuc, q / 50.0::DOUBLE AS len FROM r),
    d AS (SELECT *, {sql_map(constants.CONSONANT_MS)}[p] / 1000.0::DOUBLE AS don, CASE WHEN c IN ('m', 'n', 'N') THEN least(0.16, greatest(0.07, len * 0.28)) ELSE {sql_map(constants.CONSONANT_MS)}[c] / 1000.0::DOUBLE END AS dco FROM v),
    k AS (SELECT *, CASE WHEN don + dco > 0.55 * len THEN 0.55 * len / (don + dco) ELSE 1.0 END AS k FROM d), e AS (SELECT *, 1 - least(0.55 * don * k, 0.07) AS early, 1 + len - dco * k AS vend FROM k),
    o AS (SELECT *, CASE WHEN nuc = '@' THEN CASE WHEN vend - early - don * k > 0.4 THEN 'V' ELSE '@' END WHEN 440 * 2 ** ((60 + l_linenumber * 3 - 69) / 12) >= 800 THEN '{{' WHEN 440 * 2 ** ((60 + l_linenumber * 3 - 69) / 12) >= 640 THEN 'E' WHEN 440 * 2 ** ((60 + l_linenumber * 3 - 69) / 12) >= 500 THEN 'I' ELSE 'i' END AS sung FROM e)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, 0 AS at_, p AS phone, round(early, 9) AS start, NULL::DOUBLE AS stop, round(don * k, 9) AS dur FROM o
    UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, 1, sung, NULL, round(vend, 9), NULL FROM o UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, 2, c, NULL, NULL, round(dco * k, 9) FROM o""")
def placed_syllables(spark, sf_dir):
    r = lines(spark, sf_dir).withColumns({
        "onset": F.array(entry(_CONS, F.col("l_partkey"))), "coda": F.array(entry(_CONS, F.col("l_suppkey"))), "nucleus": F.when(F.col("q") % 2 == 0, "@").otherwise("i"),
        "start": F.lit(1.0), "end": 1 + F.col("q") / 50.0, "lead": F.lit(True), "midi_high": 60 + F.col("l_linenumber") * 3,
    })
    found = singing.place_syllables(r, ["l_orderkey"], LINE)
    return found.select("l_orderkey", *LINE, F.col("at").alias("at_"), "phone", F.round("start", 9).alias("start"), F.round("end", 9).alias("stop"), F.round("dur", 9).alias("dur"))


@query(f"""WITH {_LINES}, v AS (SELECT l_orderkey AS o, row_number() OVER ({_BY}) AS k, CASE WHEN l_partkey % 3 = 0 THEN '_' ELSE 'a' END AS ph, (l_linenumber * 900 + q * 7) / 1000.0::DOUBLE AS a, (l_linenumber * 900 + q * 7 + l_suppkey % 50 * 70) / 1000.0::DOUBLE AS b FROM r),
    c AS (SELECT *, CASE WHEN ph = '_' AND b - a > 1.2 THEN floor((b - a) / 1.2) + 1 ELSE 1 END AS n FROM v), p AS (SELECT *, unnest(range(n::INT)) AS j FROM c),
    m AS (SELECT o, k, ph, j, round_even((a + (b - a) * j / n) * 1000, 0)::BIGINT AS s, round_even(CASE WHEN n = 1 THEN b ELSE a + (b - a) * (j + 1) / n END * 1000, 0)::BIGINT AS e FROM p),
    t AS (SELECT *, greatest(0, coalesce(max(CASE WHEN ph <> '_' THEN greatest(s, e) ELSE e END) OVER (PARTITION BY o ORDER BY k, j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS pos FROM m),
    f AS (SELECT *, CASE WHEN ph <> '_' THEN greatest(pos, s) ELSE pos END AS begins FROM t)
    SELECT o AS l_orderkey, k, j::INT AS piece, 0 AS line, '_ ' || (begins - pos) AS text FROM f WHERE begins > pos UNION ALL SELECT o, k, j, 1, ph || ' ' || (e - begins) || ' ' FROM f WHERE e > begins""")
def pho_lines(spark, sf_dir):
    r = lines(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE)).cast("long"))
    ms = F.col("l_linenumber") * 900 + F.col("q") * 7
    r = r.withColumns({"phone": F.when(F.col("l_partkey") % 3 == 0, "_").otherwise("a"), "start": ms / 1000.0, "end": (ms + F.col("l_suppkey") % 50 * 70) / 1000.0})
    return singing.pho_lines(r, ["l_orderkey"], ["k"]).withColumn("piece", F.col("piece").cast("long"))


_NEURAL = ("b", "m", "s", "ng", "r", "q")
_CLIP = lambda p, v: "CASE " + " ".join(f"WHEN {p} IN ({', '.join(chr(39) + x + chr(39) for x in ps)}) THEN least(greatest({v}, {lo}), {hi})" for ps, (lo, hi) in constants.CLIPS) + f" ELSE least(greatest({v}, 0.04), 0.15) END"  # noqa: E731, E501


@query(f"""WITH {_LINES}, v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, {sql_list(_NEURAL)}[(l_partkey % 6)::INT + 1] AS p, {sql_list(_NEURAL)}[(l_suppkey % 6)::INT + 1] AS c, l_linenumber * 0.3::DOUBLE AS t, l_linenumber * 0.3::DOUBLE + 0.29 + q % 4 * 0.005 - q % 5 * 0.05 AS e FROM r),
    d AS (SELECT *, {_CLIP("p", "q / 200.0::DOUBLE")} AS don, CASE WHEN c IN ('m', 'n', 'ng') THEN greatest({_CLIP("c", "q / 300.0::DOUBLE")}, least(0.18, (e - t) * 0.25)) ELSE {_CLIP("c", "q / 300.0::DOUBLE")} END AS dco FROM v),
    n AS (SELECT *, CASE WHEN lead(t) OVER ({_BY}) - e < 0.02 THEN lead(don) OVER ({_BY}) ELSE 0 END AS nxt, least((e - t) * 0.5, (e - greatest(t, t + 0.05)) * 0.6) AS budget FROM d),
    k AS (SELECT *, CASE WHEN dco + coalesce(nxt, 0) > budget THEN budget / (dco + coalesce(nxt, 0)) ELSE 1.0 END AS k FROM n)
    SELECT l_orderkey, l_linenumber, q, round(don * coalesce(lag(CASE WHEN nxt > 0 THEN k ELSE 1.0 END) OVER ({_BY}), 1.0), 9) AS onset, round(dco * k, 9) AS coda FROM k""")
def consonant_plan(spark, sf_dir):
    t = F.col("l_linenumber") * 0.3
    r = lines(spark, sf_dir).withColumns({
        "onset": F.array(entry(_NEURAL, F.col("l_partkey"))), "coda": F.array(entry(_NEURAL, F.col("l_suppkey"))), "onset_p": F.array(F.col("q") / 200.0), "coda_p": F.array(F.col("q") / 300.0),
        "t": t, "end": t + 0.29 + F.col("q") % 4 * 0.005 - F.col("q") % 5 * 0.05, "last_t": t + 0.05,
    })
    done = singing.consonant_plan(r, ["l_orderkey"], LINE)
    return done.select("l_orderkey", "l_linenumber", "q", F.round(F.get("on_d", F.lit(0)), 9).alias("onset"), F.round(F.get("co_d", F.lit(0)), 9).alias("coda"))


@query()
def phrase_segments(spark, sf_dir):
    """Orders as phrases of neural voices; tests/test_singing.py holds them against a plain form."""
    t = F.col("k") * 0.7
    r = lines(spark, sf_dir).withColumn("k", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*LINE)))
    r = r.withColumns({
        "onset": F.array(entry(_NEURAL, F.col("l_partkey"))), "coda": F.array(entry(_NEURAL, F.col("l_suppkey"))), "on_d": F.array(F.col("q") / 400.0), "co_d": F.array(F.col("q") / 500.0),
        "vowel": entry(("aa", "ay", "iy"), F.col("q")), "t": t, "end": t + 0.5 + F.col("q") % 5 * 0.05, "t0": F.lit(0.1),
    })
    return singing.phrase_segments(r, ["l_orderkey"], ["k"])


@query(f"""{_EVENTS}, s AS (SELECT unnest([0, 1, 2]) AS singer, unnest([0, 3, 5]) AS shift, unnest([4, 2, 1]) AS gain) SELECT user_id % 20 AS voice, event_id + shift AS idx, sum(cents * gain)::BIGINT AS value FROM e JOIN s ON s.singer = e.event_id % 3 WHERE event_id + shift < 9000 GROUP BY ALL""")
def section_sum(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("user_id") % 20).alias("voice"), (F.col("event_id") % 3).cast("int").alias("singer"), F.col("event_id").alias("idx"), F.col("cents").alias("value"))
    singers = spark.createDataFrame([(0, 0, 4), (1, 3, 2), (2, 5, 1)], "singer int, shift int, gain int")
    return singing.section(e, singers, ["voice"], 9000)


_MIX = """x AS (SELECT event_type AS part, event_id % 500 AS idx, cents / 10000.0::DOUBLE AS value FROM e), l AS (SELECT part, coalesce(sqrt(avg(CASE WHEN abs(value) > 0.001 THEN value * value END)), 1.0) AS rms FROM x GROUP BY part)"""


@query(f"""{_EVENTS}, {_MIX}, g AS (SELECT part, -0.7 + 1.4 * (row_number() OVER (ORDER BY part) - 1) / greatest(1, count(*) OVER () - 1) AS pos FROM (SELECT DISTINCT part FROM x)), c AS (SELECT event_id % 500 AS idx, 0.35 * 0.25::DOUBLE AS v FROM e WHERE event_id % 50 = 0),
    a AS (SELECT idx, value * (0.2 / rms * cos((pos + 1) * (pi() / 4))) AS lft, value * (0.2 / rms * sin((pos + 1) * (pi() / 4))) AS rgt FROM x JOIN l USING (part) JOIN g USING (part) UNION ALL SELECT idx, v, v FROM c)
    SELECT idx, round(sum(lft), 6) AS lft, round(sum(rgt), 6) AS rgt FROM a GROUP BY idx""")
def tutti_mix(spark, sf_dir):
    x, clicks = _parts(spark, sf_dir)
    gains = singing.mix_gains(x.select("part").distinct(), "part")
    return singing.dry_mix(x, gains, clicks).select("idx", F.round("left", 6).alias("lft"), F.round("right", 6).alias("rgt"))


def _parts(spark, sf_dir):
    e = events(spark, sf_dir)
    x = e.select(F.col("event_type").alias("part"), (F.col("event_id") % 500).alias("idx"), (F.col("cents") / 10000.0).alias("value"))
    return x, e.where("event_id % 50 = 0").select((F.col("event_id") % 500).alias("idx"), F.lit(0.25).alias("value"))


@query(f"""{_EVENTS}, {_MIX}, c AS (SELECT event_id % 500 AS idx, 0.35 * 1.3 * 0.25::DOUBLE AS v FROM e WHERE event_id % 50 = 0),
    a AS (SELECT idx, CASE WHEN part = 'click' THEN value * (0.2 / rms * 1.2) ELSE 0 END AS lft, CASE WHEN part = 'click' THEN 0 ELSE value * (0.2 / rms * 0.1) END AS rgt FROM x JOIN l USING (part) UNION ALL SELECT idx, 0, v FROM c)
    SELECT idx, round(sum(lft), 6) AS lft, round(sum(rgt), 6) AS rgt FROM a GROUP BY idx""")
def focus_mix(spark, sf_dir):
    x, clicks = _parts(spark, sf_dir)
    gains = singing.mix_gains(x.select("part").distinct(), "part", "click")
    return singing.dry_mix(x, gains, clicks, "click").select("idx", F.round("left", 6).alias("lft"), F.round("right", 6).alias("rgt"))


@query(f"""{_EVENTS}, b AS (SELECT event_id * 0.005::DOUBLE AS t, (event_id % 3)::INT AS level FROM e WHERE event_id < 400 AND event_type <> 'error'), c AS (SELECT unnest([0, 1, 2]) AS level, unnest([1100, 1320, 1760])::DOUBLE AS f, unnest([25, 35, 35]) AS n, unnest([0.45, 0.8, 1.0])::DOUBLE AS g),
    k AS (SELECT floor(t * 1000)::BIGINT AS i, f, g, unnest(range(n)) AS k FROM b JOIN c USING (level)), s AS (SELECT i + k AS idx, (sin(2 * pi() * f * (k / 1000.0::DOUBLE)) + 0.3 * sin(2 * pi() * 2.01 * f * (k / 1000.0::DOUBLE))) * exp(-90 * (k / 1000.0::DOUBLE)) * g AS v FROM k)
    SELECT idx, round(sum(v), 6) AS value FROM s WHERE idx < 1900 GROUP BY idx""")
def metronome(spark, sf_dir):
    beats = events(spark, sf_dir).where("event_id < 400 and event_type <> 'error'").select((F.col("event_id") * 0.005).alias("t"), (F.col("event_id") % 3).cast("int").alias("level"))
    return singing.metronome(beats, 1000, 1900).select("idx", F.round("value", 6).alias("value"))


def _mirror(source: str, value: str, size: int, how: str, name: str) -> str:
    before, after = size // 2, size - size // 2 - 1
    return f"""{name}p AS (SELECT *, i AS p, true AS own FROM {source} UNION ALL SELECT *, -1 - i, false FROM {source} WHERE i < {before} UNION ALL SELECT *, 2 * n - 1 - i, false FROM {source} WHERE i >= n - {after}),
    {name} AS (SELECT * EXCLUDE (p, own) FROM (SELECT *, {how}({value}) OVER (PARTITION BY track ORDER BY p ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING) AS {name}_v FROM {name}p) WHERE own)"""


@query(f"""{_EVENTS}, x0 AS (SELECT event_id % 20 AS track, event_id // 20 AS i, cents / 5000.0::DOUBLE AS v FROM e), x AS (SELECT *, abs(v) AS a, count(*) OVER (PARTITION BY track) AS n FROM x0), {_mirror("x", "a", 7, "max", "m")},
    g AS (SELECT *, least(1.0, 0.93 / greatest(m_v, 1e-9)) AS gain FROM m), {_mirror("g", "gain", 48, "min", "h")}, {_mirror("h", "h_v", 6, "avg", "s")}
    SELECT track, i, round(greatest(-0.93, least(0.93, v * s_v)), 9) AS limited FROM s""")
def limited_peaks(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("event_id") % 20).alias("track"), F.floor(F.col("event_id") / 20).alias("i"), (F.col("cents") / 5000.0).alias("v"))
    return signal.limit_peaks(e, ["track"], "i", "v", 600).select("track", "i", F.round("limited", 9).alias("limited"))


@query(f"""{_EVENTS}, x AS (SELECT user_id, event_id, s, ln(abs(cents) / 100.0::DOUBLE + 1e-12) AS g FROM e), y AS (SELECT event_id, exp(0.0 + 0.25 * coalesce(lag(g) OVER w, 0) + 0.5 * g + 0.25 * coalesce(lead(g) OVER w, 0)) AS v FROM x WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, round(v, 6) AS smooth, round(tanh(v * 2.5) / 2.5, 9) AS clipped FROM y""")
def smooth_frames(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.abs("cents") / 100.0)
    done = signal.smooth_frames(e, ["user_id"], "event_id", "v")
    return done.select("event_id", F.round("smooth", 6).alias("smooth"), F.round(signal.soft_clip(F.col("smooth")), 9).alias("clipped"))


_B, _A = signal.shelf(44_100, 3000, -5.0, True)


@query(f"""WITH RECURSIVE {_EVENTS[5:]}, r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, cents::DOUBLE AS x FROM e),
    w AS (SELECT DISTINCT user_id, 0::BIGINT AS event_id, 0::BIGINT AS k, 0.0::DOUBLE AS x1, 0.0::DOUBLE AS x2, 0.0::DOUBLE AS y, 0.0::DOUBLE AS y2 FROM r
        UNION ALL SELECT r.user_id, r.event_id, r.k, r.x, w.x1, {_B[0]!r}::DOUBLE * r.x + {_B[1]!r}::DOUBLE * w.x1 + {_B[2]!r}::DOUBLE * w.x2 - {_A[1]!r}::DOUBLE * w.y - {_A[2]!r}::DOUBLE * w.y2, w.y FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
    SELECT event_id, round(y, 3) AS y FROM w WHERE k > 0""")
def shelf_filter(spark, sf_dir):
    """A second-order shelf over each user's events."""
    return signal.recursive_filter(events(spark, sf_dir), ["user_id"], ["event_id"], "cents", _B, _A).select("event_id", F.round("y", 3).alias("y"))


@query("""WITH n AS (SELECT DISTINCT (event_id % 200)::INT AS n FROM events) SELECT n, round(least(1.0, n / 40.0::DOUBLE, (200 - 1 - n) / 40.0::DOUBLE), 9) AS gain FROM n""")
def faded_phrase(spark, sf_dir):
    return numbers(spark, sf_dir, 200).select("n", F.round(singing.faded(F.col("n"), F.lit(200), 41), 9).alias("gain"))


_IPA = "|".join(k for k, _ in constants.IPA)


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(replace(text, '_', ' '), '({_IPA})', 1) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string(list_transform(t, lambda x: {sql_map(dict(constants.IPA))}[x]), ' ') AS phones FROM t""")
def ipa_phones(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", F.array_join(phonetics.ipa_phones(F.col("text")), " ").alias("phones"))


_SUNG = ("la", "ding-dong", "Doo doo", "hm la", "river", "Mm!", "oh-oh", "ba-da x", "", "da da da")


@query(f"""WITH n AS (SELECT DISTINCT (event_id % {len(_SUNG)})::INT AS n FROM events), v AS (SELECT n, {sql_list(_SUNG)}[n + 1] AS word FROM n), c AS (SELECT *, trim(regexp_replace(lower(word), '[^a-z''\\- ]', '', 'g'), '-'' ') AS w FROM v),
    s AS (SELECT *, {sql_map(constants.SCAT)} AS m FROM c), p AS (SELECT n, word, w, m[w] AS whole, list_transform(string_split(w, ' '), lambda x: m[x]) AS parts FROM s)
    SELECT n, word, CASE WHEN w = '' THEN '' WHEN whole IS NOT NULL THEN whole WHEN len(list_filter(parts, lambda x: x IS NULL)) = 0 THEN array_to_string(parts, ' ') WHEN w = 'river' THEN 'r I v @' END AS phones FROM p""")
def word_phones(spark, sf_dir):
    words = numbers(spark, sf_dir, len(_SUNG)).select("n", entry(_SUNG, F.col("n")).alias("word"), F.lit("en-us").alias("lang"))
    lexicon = spark.createDataFrame([("river", "en-us", "ˈɹɪvə"), ("other", "en-us", "ʌðə")], "word string, lang string, ipa string")
    return phonetics.pronounce(words, lexicon).select("n", "word", F.array_join("phones", " ").alias("phones"))
