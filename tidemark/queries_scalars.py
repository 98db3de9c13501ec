"""Queries of the scalar expressions, and of ordered operators on notes made of order lines: an order is a voice, its lines in order are the notes."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import constants, phonetics, scalars, text
from .operators import aggregates, joins, ordered, pages, structure
from .queries import LINE, events, query, read
from .queries import EVENTS as _EVENTS

_LINES = """r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, l_returnflag AS f, l_linestatus AS st FROM lineitem)"""
_BY = "PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q"


def lines(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st"))


def numbers(spark, sf_dir, n: int):
    """0 to n - 1, as far as events have such ids modulo n."""
    return read(spark, sf_dir, "events").select((F.col("event_id") % n).cast("int").alias("n")).distinct()


def entry(names, column):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (column % len(names) + 1).cast("int"))


def sql_list(names) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in names) + "]"


def sql_map(table) -> str:
    return "MAP {" + ", ".join("'" + str(k).replace("'", "''") + "': " + (f"'{v}'" if isinstance(v, str) else str(v)) for k, v in table.items()) + "}"


NAMES = ("Soprano", "Alto", "T.", "Bar.", "Bass", "Mezzo", "Choir", "S1", "Tenor 2", "Xylophone", "Baritone", "b", "Kontra", "a")


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, q, (l_partkey + l_partkey + q) / 2 AS centre,
    CASE WHEN 0.5 * (l_suppkey % 12) > 4 - 2.4 AND 0.5 * (l_suppkey % 12) < 4 + 0.6 THEN 'up' WHEN 0.5 * (l_suppkey % 12) > 0 - 0.6 AND 0.5 * (l_suppkey % 12) < 0 + 1.2 THEN 'down' END AS side,
    (l_partkey + l_partkey + q + l_suppkey + l_suppkey + 4) / 2 / 2 AS heads,
    CASE WHEN abs(q / 2 + l_suppkey % 9 - 4) <= abs(l_suppkey % 9) THEN q / 2 + l_suppkey % 9 ELSE l_suppkey % 9 + 4 END::DOUBLE AS anchor FROM r""")
def symbol_places(spark, sf_dir):
    """Centres of words and heads, sides of stems, anchors of lyrics."""
    r = lines(spark, sf_dir)
    head = lambda a, b: F.struct(a.cast("double").alias("x0"), b.cast("double").alias("x1"))
    heads = F.array(head(F.col("l_partkey"), F.col("l_partkey") + F.col("q")), head(F.col("l_suppkey"), F.col("l_suppkey") + 4))
    x0 = (F.col("l_suppkey") % 9).cast("double")
    return r.select(
        "l_orderkey", "l_linenumber", "q", scalars.word_centre(F.col("l_partkey"), F.col("l_partkey") + F.col("q")).alias("centre"),
        scalars.stem_side(0.5 * (F.col("l_suppkey") % 12), F.lit(0.0), F.lit(4.0), F.lit(4.0)).alias("side"),
        scalars.head_centre(heads).alias("heads"), scalars.lyric_anchor(x0, x0 + F.col("q"), F.lit(4.0), F.lit(0.0)).alias("anchor"),
    )


@query(f"""WITH {_LINES} SELECT l_orderkey, l_linenumber, q, q AS top, q + 4 * (l_suppkey % 5) AS bottom, (l_suppkey % 5)::DOUBLE AS space, q + 2 * (l_suppkey % 5) AS mid FROM r""")
def staff_geometry(spark, sf_dir):
    r = lines(spark, sf_dir)
    g = scalars.staff_geometry(F.transform(F.sequence(F.lit(0), F.lit(4)), lambda k: F.col("q") + k * (F.col("l_suppkey") % 5)))
    return r.select("l_orderkey", "l_linenumber", "q", g["top"].alias("top"), g["bottom"].alias("bottom"), g["space"].alias("space"), g["mid"].alias("mid"))


@query("""WITH n AS (SELECT DISTINCT (event_id % 240)::INT AS n FROM events), v AS (SELECT n, [1.0, 2.0, 4.0][n % 3 + 1]::DOUBLE AS base, n // 3 % 4 AS beams, n // 12 % 4 AS dots, [1.0, 0.75, 1.5, 0.5, 1.25][n // 48 + 1]::DOUBLE AS tuplet FROM n)
    SELECT n, base / pow(2.0, beams) * (2.0 - pow(0.5, dots)) * tuplet AS dur, (1 + n % 13)::INT AS num, (2 ** (n % 5))::INT AS den,
        CASE WHEN n % 5 = 3 AND (1 + n % 13) % 3 = 0 AND 1 + n % 13 > 3 THEN 1.5 ELSE 4.0::DOUBLE / 2 ** (n % 5) END::DOUBLE AS unit, CASE WHEN n % 5 = 3 AND (1 + n % 13) % 3 = 0 AND 1 + n % 13 > 3 THEN (1 + n % 13) // 3 ELSE 1 + n % 13 END::INT AS beats FROM v""")
def durations_and_beats(spark, sf_dir):
    n = F.col("n")
    num, den = (1 + n % 13).cast("int"), F.pow(F.lit(2.0), n % 5).cast("int")
    dur = scalars.chord_duration(F.element_at(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), n % 3 + 1), F.floor(n / 3) % 4, F.floor(n / 12) % 4, F.element_at(F.array(*map(F.lit, (1.0, 0.75, 1.5, 0.5, 1.25))), (F.floor(n / 48) + 1).cast("int")))
    unit = scalars.beat_unit(num, den)
    return numbers(spark, sf_dir, 240).select("n", dur.alias("dur"), num.alias("num"), den.alias("den"), unit["unit"].alias("unit"), unit["beats"].alias("beats"))


@query(f"""WITH p AS (SELECT l_suppkey, min(30 + l_quantity)::INT AS lo, max(30 + l_quantity + l_linenumber)::INT AS hi, {sql_list(NAMES)}[(l_suppkey % {len(NAMES)})::INT + 1] AS name FROM lineitem WHERE l_linenumber > 4 AND l_quantity % 8 = l_suppkey % 8 GROUP BY l_suppkey),
    m AS (SELECT *, (lo + hi) / 2 AS mid FROM p)
    SELECT l_suppkey, name, CASE WHEN mid < 55 THEN 'F' ELSE 'G' END AS sign, CASE WHEN mid < 55 THEN 4 ELSE 2 END::INT AS line,
        CASE WHEN mid >= 55 AND (starts_with(lower(name), 't') OR (mid < 62 AND NOT regexp_matches(lower(name), '^[sam]'))) THEN -1 ELSE 0 END::INT AS octave FROM m""")
def clefs(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").where("l_linenumber > 4 and l_quantity % 8 = l_suppkey % 8")
    p = rows.groupBy("l_suppkey").agg(F.min(30 + F.col("l_quantity")).alias("lo"), F.max(30 + F.col("l_quantity") + F.col("l_linenumber")).alias("hi")).withColumn("name", entry(NAMES, F.col("l_suppkey")))
    c = scalars.clef(F.col("lo"), F.col("hi"), F.col("name"))
    return p.select("l_suppkey", "name", c["sign"].alias("sign"), c["line"].alias("line"), c["octave"].alias("octave"))


_PHONES = (*sorted(constants.VOWELS), *constants.CONSONANT_MS, "?")
_OPEN = " ".join(f"WHEN p = '{v}' THEN CASE {' '.join(f'WHEN hz >= {t} THEN ' + chr(39) + x + chr(39) for t, x in sorted(ts, reverse=True))} ELSE p END" for v, ts in constants.OPEN_VOWELS.items())


@query(f"""WITH n AS (SELECT DISTINCT (event_id % 990)::INT AS n FROM events), v AS (SELECT n, {sql_list(_PHONES)}[n % {len(_PHONES)} + 1] AS p, 100 + 40 * (n // {len(_PHONES)})::DOUBLE AS hz FROM n), c AS (SELECT *, coalesce({sql_map(constants.CONSONANT_MS)}[p], 60) / 1000.0::DOUBLE AS seconds FROM v)
    SELECT n, p, CASE {_OPEN} ELSE p END AS sung, seconds, least(0.55 * (seconds + seconds / 2), 0.07) AS lead, {sql_map(constants.ARPABET)}[p] AS arpa FROM c""")
def phone_lengths(spark, sf_dir):
    """Vowels as sung at a frequency, lengths of consonants, leads before the beat, phones of the other alphabet."""
    k = len(_PHONES)
    v = numbers(spark, sf_dir, 990).select("n", entry(_PHONES, F.col("n")).alias("p"), (100 + 40 * F.floor(F.col("n") / k)).cast("double").alias("hz")).withColumn("seconds", scalars.consonant_seconds(F.col("p")))
    lead = scalars.consonant_lead(F.array("seconds", F.col("seconds") / 2))
    return v.select("n", "p", scalars.open_vowel(F.col("p"), F.col("hz")).alias("sung"), "seconds", lead.alias("lead"), F.get(text.known_tokens(F.array("p"), constants.ARPABET), F.lit(0)).alias("arpa"))


_TOKENS = {"en/aa": 1, "aa": 2, "de/b": 3, "SP": 4, "en/ch": 5, "b": 6, "en/de/g": 7}
_ASKED = ("aa", "de/b", "SP", "ch", "b", "de/g")


@query(f"""WITH n AS (SELECT DISTINCT (event_id % {len(_ASKED)})::INT AS n FROM events), v AS (SELECT {sql_list(_ASKED)}[n + 1] AS p, {sql_map(_TOKENS)} AS t FROM n)
    SELECT p, CASE WHEN contains(p, '/') THEN coalesce(t[p], t['en/' || p]) ELSE coalesce(t['en/' || p], t[p]) END::INT AS token,
        CASE WHEN contains(p, '/') THEN coalesce(MAP {{'en': 8, 'de': 9}}[split_part(p, '/', 1)], 0) WHEN t['en/' || p] IS NOT NULL THEN 8 ELSE 0 END::INT AS language FROM v""")
def bank_tokens(spark, sf_dir):
    make = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    v = numbers(spark, sf_dir, len(_ASKED)).select(entry(_ASKED, F.col("n")).alias("p"))
    languages = make({"en": 8, "de": 9})
    return v.select("p", scalars.token_id(F.col("p"), make(_TOKENS)).alias("token"), scalars.language_of(F.col("p"), make(_TOKENS), languages).alias("language"))


@query("""WITH n AS (SELECT DISTINCT (event_id % 201)::INT AS n FROM events), v AS (SELECT n, n / 100.0::DOUBLE - 1 AS x FROM n)
    SELECT n, round(cos((x + 1) * (pi() / 4)), 9) AS lft, round(sin((x + 1) * (pi() / 4)), 9) AS rgt, round(CASE WHEN n % 2 = 0 THEN 0.86 + 0.14 * pow(sin(pi() * least(1.0, 1.6 * (n / 201.0::DOUBLE))), 0.8) - 0.1 * (n / 201.0::DOUBLE) * (n / 201.0::DOUBLE) ELSE 1.0 END, 9) AS swell,
        round(CASE WHEN n % 3 = 0 AND (1 - n / 201.0::DOUBLE) * 0.5 < 0.12 THEN 1 - 0.45 * (1 - (1 - n / 201.0::DOUBLE) * 0.5 / 0.12) ELSE 1.0 END, 9) AS taper FROM v""")
def loudness_shapes(spark, sf_dir):
    """Gains of a position between the channels; the swell of long notes and the fall at phrase ends."""
    v = numbers(spark, sf_dir, 201).withColumns({"x": F.col("n") / 100.0 - 1, "part": F.col("n") / 201.0})
    gains = scalars.pan(F.col("x"))
    swell = scalars.swell(F.col("part"), F.when(F.col("n") % 2 == 0, 1.0).otherwise(0.5))
    taper = scalars.taper((1 - F.col("part")) * 0.5, F.lit(0.5), F.col("n") % 3 == 0)
    return v.select("n", F.round(gains["left"], 9).alias("lft"), F.round(gains["right"], 9).alias("rgt"), F.round(swell, 9).alias("swell"), F.round(taper, 9).alias("taper"))


@query("""WITH n AS (SELECT DISTINCT (event_id % 400)::INT AS n FROM events), v AS (SELECT n, CASE n % 8 WHEN 0 THEN '8=' || (60 + n) WHEN 1 THEN '4.=' || n || ',5' WHEN 2 THEN ' 4 = ' || n WHEN 3 THEN n || '.25' WHEN 4 THEN '3=' || n WHEN 5 THEN 'x' || n WHEN 6 THEN '16=' || n ELSE n::VARCHAR END AS spec FROM n)
    SELECT n, spec, CASE n % 8 WHEN 0 THEN 0.5 * (60 + n) WHEN 1 THEN 1.5 * (n + 0.5) WHEN 2 THEN n WHEN 3 THEN n + 0.25 WHEN 6 THEN 0.25 * n WHEN 7 THEN n END::DOUBLE AS qpm, CASE n % 8 WHEN 0 THEN 0.5 WHEN 1 THEN 1.5 WHEN 2 THEN 1 WHEN 6 THEN 0.25 END::DOUBLE AS unit FROM v""")
def tempo_spec(spark, sf_dir):
    n = F.col("n").cast("string")
    forms = {0: F.concat(F.lit("8="), (F.col("n") + 60).cast("string")), 1: F.concat(F.lit("4.="), n, F.lit(",5")), 2: F.concat(F.lit(" 4 = "), n), 3: F.concat(n, F.lit(".25")), 4: F.concat(F.lit("3="), n), 5: F.concat(F.lit("x"), n), 6: F.concat(F.lit("16="), n)}
    spec = n
    for k, form in forms.items():
        spec = F.when(F.col("n") % 8 == k, form).otherwise(spec)
    v = numbers(spark, sf_dir, 400).withColumn("spec", spec)
    t = scalars.tempo_spec(F.col("spec"))
    return v.select("n", "spec", t["qpm"].alias("qpm"), t["unit"].alias("unit"))


_G = lambda x, d: f"CASE WHEN {x} = 0 THEN '0' ELSE regexp_replace(regexp_replace(format('{{:.{d + 3}f}}', round({x} * 10 ** ({d} - greatest(floor(log10({x})) + 1, -3)), 0) / 10 ** ({d} - greatest(floor(log10({x})) + 1, -3))), '0+$', ''), '[.]$', '') END"  # noqa: E731, E501


@query(f"""WITH n AS (SELECT DISTINCT (event_id % 500)::INT AS n FROM events), v AS (SELECT n, (30 + n / 8.0)::DOUBLE AS q FROM n)
    SELECT n, '4=' || {_G("q", 6)} || ' (8=' || {_G("(q * 2)", 6)} || ', 4.=' || {_G("(q / 1.5)", 4)} || ')' AS shown FROM v""")
def tempo_text(spark, sf_dir):
    return numbers(spark, sf_dir, 500).select("n", scalars.tempo_text(30 + F.col("n") / 8.0).alias("shown"))


_INITIALS = "regexp_replace(lower(name), '[^a-z]', '', 'g')"
_RANK = " ".join(f"WHEN starts_with(i, '{k}') {'AND length(i) <= 2 ' if len(k) == 1 else ''}THEN {r}" for k, r in constants.VOICE_RANKS)


@query(f"""WITH n AS (SELECT DISTINCT (event_id % {4 * len(NAMES)})::INT AS n FROM events), v AS (SELECT n, {sql_list(NAMES)}[n % {len(NAMES)} + 1] AS name, CASE WHEN n // {len(NAMES)} < 3 THEN 45 + 9 * (n // {len(NAMES)}) END AS m FROM n),
    w AS (SELECT *, {_INITIALS} AS i, coalesce(m, 60) AS c FROM v)
    SELECT n, name, CASE WHEN regexp_matches(i, '^[sm]') THEN 'soprano' WHEN regexp_matches(i, '^[ac]') THEN 'alto' WHEN starts_with(i, 't') THEN 'tenor' WHEN starts_with(i, 'bar') THEN 'baritone' WHEN starts_with(i, 'b') THEN 'bass'
            WHEN c < 52 THEN 'bass' WHEN c < 60 THEN 'tenor' WHEN c < 67 THEN 'alto' ELSE 'soprano' END AS kind,
        CASE WHEN regexp_matches(i, '^(t|bar)') THEN 'us3' WHEN starts_with(i, 'b') THEN 'us2' WHEN regexp_matches(i, '^[sma]') THEN 'us1' WHEN m < 57 THEN 'us2' ELSE 'us1' END AS model,
        CASE {_RANK} ELSE 0 END::INT AS rank FROM w""")
def voices_by_name(spark, sf_dir):
    k = len(NAMES)
    v = numbers(spark, sf_dir, 4 * k).select("n", entry(NAMES, F.col("n")).alias("name"), F.when(F.floor(F.col("n") / k) < 3, 45 + 9 * F.floor(F.col("n") / k)).alias("m"))
    return v.select("n", "name", scalars.voice_kind(F.col("name"), F.col("m")).alias("kind"), scalars.voice_model(F.col("name"), F.col("m")).alias("model"), scalars.voice_rank(F.col("name")).alias("rank"))


_SHORT = ("T.", "S1.", "S.1", "B./Bar.", "A", "1.", "", "Ten.", "s 2")
_FULL = ("Tenor", "Soprano 1", "Bass/Baritone", "Alto", "Soprano", "Bass / Bariton", "Tenor2", "TENOR", "Mezzo-S")


@query(f"""WITH n AS (SELECT DISTINCT (event_id % 81)::INT AS n FROM events), v AS (SELECT {sql_list(_SHORT)}[n % 9 + 1] AS short, {sql_list(_FULL)}[n // 9 + 1] AS whole FROM n),
    p AS (SELECT short, whole, string_split(short, '/') AS a, string_split(whole, '/') AS b FROM v),
    q AS (SELECT short, whole, len(a) = len(b) AS same, [regexp_extract(rtrim(trim(x), '.'), '^([A-Za-zÄÖÜäöü]+)[.]?([0-9]*)$', ['l', 'd']) for x in a] AS a, [regexp_extract(trim(x), '^([-A-Za-zÄÖÜäöü]+)\\s*([0-9]*)$', ['l', 'd']) for x in b] AS b FROM p)
    SELECT short, whole, same AND len([1 for i in range(1, len(a) + 1) if a[i].l = '' OR NOT starts_with(lower(b[i].l), lower(a[i].l)) OR a[i].d <> b[i].d]) = 0 AS fits FROM q""")
def abbreviations(spark, sf_dir):
    v = numbers(spark, sf_dir, 81).select(entry(_SHORT, F.col("n") % 9).alias("short"), entry(_FULL, F.floor(F.col("n") / 9)).alias("whole"))
    return v.select("short", "whole", text.abbreviates(F.col("short"), F.col("whole")).alias("fits"))


@query("""WITH n AS (SELECT DISTINCT (event_id % 300)::INT AS n FROM events), t AS (SELECT unnest([192, 96, 48, 24, 12, 6, 3]) AS d), k AS (SELECT unnest([[1, 1], [3, 2], [7, 4], [2, 3]]) AS f),
    s AS (SELECT DISTINCT d * f[1] // f[2] AS d FROM t, k WHERE d * f[1] % f[2] = 0), RECURSIVE_START AS (SELECT 1),
    a AS (SELECT list(d ORDER BY d DESC) AS ds FROM s)
    SELECT n, array_to_string(list_reduce(list_prepend([n]::INT[], list_transform(ds, lambda d: [d]::INT[])), lambda acc, s: list_concat(acc[:-2], list_transform(range(acc[-1] // s[1]), lambda i: s[1]), [acc[-1] % s[1]])), ',') AS pieces FROM n, a""")
def split_duration(spark, sf_dir):
    v = numbers(spark, sf_dir, 300).withColumn("p", scalars.split_duration(F.col("n"), list(constants.note_shapes())))
    left = F.col("n") - F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + F.when(x >= 2, x).otherwise(0))
    whole = F.filter("p", lambda x: x >= 2)
    return v.select("n", F.array_join(F.array_append(whole, left).cast("array<string>"), ",").alias("pieces"))


@query("""SELECT doc_id, coalesce(CASE WHEN length(t) > 0 THEN t ELSE 'ah' END, NULL) AS glued FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '(\\pL)[;:,.!?"“”]+(\\pL)', '\\1 \\2', 'g'), '(\\pL)[;:,.!?"“”]+(\\pL)', '\\1 \\2', 'g')) AS t FROM documents)""")
def glued_words(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.split_glued(F.col("text")).alias("glued"))


@query("""SELECT page_id, CASE WHEN trim(t) <> '' THEN trim(t) ELSE 'page' || page_id END AS title, CASE WHEN u <> '' THEN u ELSE url END AS label FROM (
    SELECT page_id, url, regexp_replace(html[1:60], '[^\\pL\\pN_\\- ]', '', 'g') AS t, regexp_replace(url, '[^\\pL\\pN_]', '', 'g') AS u FROM pages WHERE url IS NOT NULL AND html IS NOT NULL)""")
def track_names(spark, sf_dir):
    p = read(spark, sf_dir, "pages").where("url is not null and html is not null")
    return p.select("page_id", text.file_title(F.substring("html", 1, 60), F.concat(F.lit("page"), F.col("page_id").cast("string"))).alias("title"), text.track_label(F.col("url")).alias("label"))


# ---- ordered operators on notes


@query(f"""WITH {_LINES}, n AS (SELECT *, l_suppkey % 3 = 0 AS own, (sum(q) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS t0 FROM r), v AS (SELECT *, coalesce(t0, 0) + l_suppkey % 2 AS t FROM n),
    g AS (SELECT *, CASE WHEN NOT own AND abs(lag(t + q) OVER ({_BY}) - t) < 1 THEN 0 ELSE 1 END AS new FROM v), i AS (SELECT *, sum(new) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS grp FROM g)
    SELECT l_orderkey, grp::BIGINT AS grp, min(t)::BIGINT AS start, max(t + q)::BIGINT AS stop, count(*) AS n, coalesce(max(CASE WHEN own THEN 'v' || q END), 'A') AS nucleus FROM i GROUP BY l_orderkey, grp""")
def melisma_groups(spark, sf_dir):
    r = ordered.prefix_sum(lines(spark, sf_dir), ["l_orderkey"], LINE, F.col("q"), "t").withColumn("t", F.col("t") + F.col("l_suppkey") % 2)
    r = r.withColumn("nucleus", F.when(F.col("l_suppkey") % 3 == 0, F.concat(F.lit("v"), F.col("q").cast("string"))))
    g = ordered.melisma_groups(r, ["l_orderkey"], LINE, "nucleus", "t", "q", "grp", 1)
    return g.groupBy("l_orderkey", "grp").agg(F.min("t").alias("start"), F.max(F.col("t") + F.col("q")).alias("stop"), F.count("*").alias("n"), F.coalesce(F.max("nucleus"), F.lit("A")).alias("nucleus"))


@query(f"""WITH {_LINES}, v AS (SELECT *, coalesce(sum(q) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN l_partkey % 7 = 0 THEN 1 ELSE 0 END AS t, l_suppkey % 2 AS midi, st = 'F' AS tie, f = 'R' AS words FROM r),
    g AS (SELECT *, CASE WHEN lag(tie) OVER ({_BY}) AND lag(t + q) OVER ({_BY}) = t AND NOT words AND lag(midi) OVER ({_BY}) = midi THEN 0 ELSE 1 END AS new FROM v), i AS (SELECT *, sum(new) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS island FROM g)
    SELECT l_orderkey, midi, min(t)::BIGINT AS t, sum(q)::BIGINT AS q, arg_max(tie, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := i.q)) AS tie FROM i GROUP BY l_orderkey, island, midi""")
def merged_ties(spark, sf_dir):
    r = ordered.prefix_sum(lines(spark, sf_dir), ["l_orderkey"], LINE, F.col("q"), "t").withColumn("t", F.col("t") + F.when(F.col("l_partkey") % 7 == 0, 1).otherwise(0))
    r = r.withColumns({"midi": F.col("l_suppkey") % 2, "tie": F.col("st") == "F"})
    return ordered.merge_ties(r, ["l_orderkey"], LINE, "tie", ["midi"], "t", "q", F.col("f") == "R")


@query(f"""WITH {_LINES}, v AS (SELECT *, CASE WHEN f <> 'N' THEN 'w' || q END AS txt, st = 'F' AS hyph, l_linenumber * 10 AS t, (5 + l_suppkey % 6) AS dur, l_partkey % 3 AS midi FROM r),
    a AS (SELECT *, last_value(CASE WHEN txt IS NOT NULL AND NOT hyph THEN txt END IGNORE NULLS) OVER ({_BY} ROWS UNBOUNDED PRECEDING) AS whole, (t - lag(t + dur) OVER ({_BY}) > 0.05) OR lag(midi) OVER ({_BY}) = midi AS again FROM v),
    s AS (SELECT *, CASE WHEN txt IS NOT NULL THEN txt WHEN again THEN whole END AS sung FROM a), e AS (SELECT *, CASE WHEN sung IS NOT NULL AND NOT (hyph AND txt IS NOT NULL) THEN 1 ELSE 0 END AS fin FROM s)
    SELECT l_orderkey, l_linenumber, q, sung, coalesce(sum(fin) OVER ({_BY} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS word FROM e""")
def continued_words(spark, sf_dir):
    r = lines(spark, sf_dir).withColumns({"txt": F.when(F.col("f") != "N", F.concat(F.lit("w"), F.col("q").cast("string"))), "t": F.col("l_linenumber") * 10, "dur": 5 + F.col("l_suppkey") % 6, "midi": F.col("l_partkey") % 3})
    r = r.withColumn("hyph", (F.col("st") == "F") & F.col("txt").isNotNull())
    return ordered.continue_words(r, ["l_orderkey"], LINE, "txt", "hyph", "t", "dur", "midi").select("l_orderkey", "l_linenumber", "q", "sung", "word")


@query(f"""WITH {_LINES}, a AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS own FROM r WHERE st = 'F' GROUP BY ALL), b AS (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS other FROM r WHERE st = 'O' GROUP BY ALL),
    k AS (SELECT l_orderkey, l_linenumber FROM a UNION SELECT l_orderkey, l_linenumber FROM b) SELECT l_orderkey, l_linenumber, coalesce(own, other) AS words, own IS NULL AS copied FROM k LEFT JOIN a USING (l_orderkey, l_linenumber) LEFT JOIN b USING (l_orderkey, l_linenumber)""")
def copied_words(spark, sf_dir):
    """Words of two voices that sing at a time: one's own, else the other's."""
    r = lines(spark, sf_dir)
    own = r.where("st = 'F'").groupBy("l_orderkey", (F.col("l_linenumber") / 3.0).alias("start"), "l_linenumber").agg(F.map_from_arrays(F.array(F.lit(1)), F.array(F.min("l_partkey"))).alias("lyrics"))
    other = r.where("st = 'O'").groupBy("l_orderkey", (F.col("l_linenumber") / 3.0 + 1e-6).alias("start"), "l_linenumber").agg(F.map_from_arrays(F.array(F.lit(1)), F.array(F.max("l_suppkey"))).alias("lyrics"))
    notes = own.unionByName(other.join(own.select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], "left_anti").withColumn("lyrics", F.lit(None).cast("map<int,bigint>")))
    done = structure.copy_words(notes, other, ["l_orderkey"], "start", "lyrics", merge=True)
    return done.select("l_orderkey", "l_linenumber", F.element_at("lyrics", 1).alias("words")).join(own.select("l_orderkey", "l_linenumber", F.lit(False).alias("c")), ["l_orderkey", "l_linenumber"], "left").select("l_orderkey", "l_linenumber", "words", F.coalesce("c", F.lit(True)).alias("copied"))


@query(f"""WITH {_LINES}, a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, l_linenumber AS s, l_linenumber + q % 3 AS e FROM r WHERE st = 'F'), b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, q, l_linenumber AS s, l_linenumber + q % 3 AS e FROM r WHERE st = 'O')
    SELECT l_orderkey, s, e, q, false AS filled FROM a UNION ALL SELECT l_orderkey, s, e, q, true FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = b.l_orderkey AND b.s < a.e AND a.s < b.e)""")
def part_with_fill(spark, sf_dir):
    """A part's own notes, and the other voice's where it has none."""
    r = lines(spark, sf_dir).select("l_orderkey", F.col("l_linenumber").alias("s"), (F.col("l_linenumber") + F.col("q") % 3).alias("e"), "q", "st")
    own, other = r.where("st = 'F'").drop("st"), r.where("st = 'O'").drop("st")
    return structure.with_fill(own, other, ["l_orderkey"], "s", "e")


@query(f"""WITH {_LINES}, a AS (SELECT l_orderkey, list_sort(list_distinct(list(q % 10) FILTER (WHERE f = 'R'))) AS x, list_sort(list_distinct(list(q % 10) FILTER (WHERE f <> 'R'))) AS y FROM r GROUP BY l_orderkey)
    SELECT l_orderkey, array_to_string(list_sort(list_distinct(list_concat(coalesce(x, []), coalesce(y, [])))), ',') AS both_sides, array_to_string(list_filter(coalesce(x, []), lambda v: NOT list_contains(coalesce(y, []), v)), ',') AS only_first,
        array_to_string([k || ':' || CASE WHEN list_contains(coalesce(x, []), k) THEN 'x' ELSE 'y' END for k in list_sort(list_distinct(list_concat(coalesce(x, []), coalesce(y, []))))], ',') AS united FROM a""")
def set_operations(spark, sf_dir):
    """Union and difference of sets, and of maps, where the first side counts."""
    r = lines(spark, sf_dir).withColumn("v", F.col("q") % 10)
    a = r.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("f") == "R", F.col("v"))).alias("x"), F.collect_set(F.when(F.col("f") != "R", F.col("v"))).alias("y"))
    mapped = lambda c, v: F.map_from_entries(F.transform(c, lambda k: F.struct(k.alias("key"), F.lit(v).alias("value"))))
    united = F.array_sort(F.map_entries(scalars.map_union(mapped("x", "x"), mapped("y", "y"))))
    shown = F.transform(united, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"]))
    joined = lambda c: F.array_join(F.array_sort(c).cast("array<string>"), ",")
    return a.select("l_orderkey", joined(F.array_union("x", "y")).alias("both_sides"), joined(F.array_except("x", "y")).alias("only_first"), F.array_join(shown, ",").alias("united"))


@query(f"""{_EVENTS}, m AS (SELECT user_id, s, min(event_id) AS mark, lead(s) OVER (PARTITION BY user_id ORDER BY s) AS nxt FROM e WHERE event_type = 'signup' GROUP BY user_id, s),
    p AS (SELECT user_id, s, nxt, mark, least(s + 50000, coalesce(nxt, s + 50000)) AS stop FROM m), z AS (SELECT user_id, arg_max(mark, s) AS lst FROM p GROUP BY user_id),
    f AS (SELECT user_id, arg_min(mark, s) AS fst FROM p GROUP BY user_id)
    SELECT e.event_id, coalesce(p.mark, z.lst) AS bar, coalesce((SELECT arg_max(mark, m.s) FROM m WHERE m.user_id = e.user_id AND m.s <= e.s + 3600), f.fst) AS tempo FROM e
    LEFT JOIN p ON p.user_id = e.user_id AND e.s >= p.s AND e.s < p.stop LEFT JOIN z ON z.user_id = e.user_id LEFT JOIN f ON f.user_id = e.user_id""")
def bar_and_tempo_at(spark, sf_dir):
    """The bar that holds a time, else the last bar; the tempo in force, with a tolerance, else the first."""
    e = events(spark, sf_dir).select("event_id", "user_id", "s", "event_type")
    m = e.where("event_type = 'signup'").groupBy("user_id", "s").agg(F.min("event_id").alias("mark"))
    nxt = F.lead("s").over(W.partitionBy("user_id").orderBy("s"))
    spans = m.withColumn("stop", F.least(F.col("s") + 50000, F.coalesce(nxt, F.col("s") + 50000))).withColumnRenamed("mark", "bar")
    at = joins.interval_lookup(e.drop("event_type"), spans, ["user_id"], "s", "s", "stop", ["bar"], ["bar"], else_last=True)
    marks = m.select("user_id", (F.col("s") - 3600).alias("s"), F.col("mark").alias("tempo"))
    return joins.asof(at, marks, ["user_id"], "s", ["tempo"], ["tempo"], default_first=True).select("event_id", "bar", "tempo")


@query(f"""{_EVENTS}, c AS (SELECT user_id, s, event_id FROM e WHERE event_type = 'click' UNION ALL SELECT user_id, s, event_id FROM e WHERE event_type = 'click' AND event_id % 2 = 0), v AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id END AS note, EXISTS (SELECT 1 FROM v WHERE v.user_id = c.user_id AND c.s < v.s + 43200 AND v.s < c.s + 43200) AS overlapped FROM c""")
def overlapped_rows(spark, sf_dir):
    """Semi and anti join together keep every row once, repeated ones and those with nulls too."""
    e = events(spark, sf_dir)
    c = e.where("event_type = 'click'").select("event_id", "user_id", F.col("s").alias("l_start"), (F.col("s") + 43200).alias("l_end"), F.when(F.col("event_id") % 3 != 0, F.col("user_id")).alias("note"))
    left = c.unionByName(c.where("event_id % 2 = 0"))
    right = e.where("event_type = 'view'").select("user_id", F.col("s").alias("r_start"), (F.col("s") + 43200).alias("r_end"))
    found = [joins.interval_overlap(left, right, ["user_id"], 86400.0, how=h).select("event_id", "note", F.lit(h == "left_semi").alias("overlapped")) for h in ("left_semi", "left_anti")]
    return found[0].unionByName(found[1])


@query("""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), d AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM benchmark) SELECT w.word FROM w WHERE w.word IN (SELECT word FROM d)""")
def dictionary_words(spark, sf_dir):
    words = lambda t: read(spark, sf_dir, t).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    return phonetics.known_words(words("documents"), words("benchmark"), "word")


@query(f"""{_EVENTS}, g AS (SELECT user_id, event_type, sum(cents)::BIGINT AS n, min(event_id) AS o FROM e GROUP BY ALL), w AS (SELECT * FROM g WHERE starts_with(event_type, 'p') OR lower(event_type) = 'view')
    SELECT user_id, arg_min(event_type, o) AS part FROM w GROUP BY user_id""")
def part_selection(spark, sf_dir):
    """The first part of each score that goes by a name, with or without a dot, or by its full name."""
    e = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.min("event_id").alias("ord"))
    parts = e.select("user_id", "ord", F.concat(F.substring("event_type", 1, 1), F.lit(".")).alias("name"), F.col("event_type").alias("display_name"))
    found = structure.select_parts(parts, ["user_id"], "p", "ord").unionByName(structure.select_parts(parts, ["user_id"], "View", "ord"))
    return found.groupBy("user_id").agg(F.min_by("display_name", "ord").alias("part"))


_MARKS = "m AS (SELECT l_orderkey, l_linenumber, q, CASE WHEN l_suppkey % 3 = 0 THEN 'c' WHEN l_suppkey % 3 = 1 THEN 'C' ELSE '4' END AS ch FROM r)"


@query(f"""WITH {_LINES}, {_MARKS} SELECT DISTINCT l_orderkey, l_linenumber * 3.0::DOUBLE AS x, CASE ch WHEN 'c' THEN 4 ELSE 2 END::INT AS num, CASE ch WHEN 'c' THEN 4 ELSE 2 END::INT AS den FROM m WHERE ch <> '4' AND abs(q - 20) < 4
    UNION SELECT * FROM (SELECT l_orderkey, l_linenumber * 3.0::DOUBLE AS x, string_agg('4', '') FILTER (WHERE q < 20)::INT AS num, string_agg('4', '') FILTER (WHERE q > 20)::INT AS den FROM m WHERE ch = '4' GROUP BY ALL) WHERE num IS NOT NULL AND den IS NOT NULL AND num < 1000 AND den < 1000""")
def time_signatures(spark, sf_dir):
    r = lines(spark, sf_dir)
    ch = F.when(F.col("l_suppkey") % 3 == 0, "c").when(F.col("l_suppkey") % 3 == 1, "C").otherwise("4")
    x = F.col("l_linenumber") * 3.0
    glyphs = r.select("l_orderkey", F.struct(*LINE).alias("ord"), x.alias("x"), x.alias("x0"), F.col("q").cast("double").alias("y"), ch.alias("ch"), F.lit("OpusStd").alias("font"), F.lit(20.0).alias("size"), F.lit(20.0).alias("mid"), F.lit(4.0).alias("space"))
    return pages.time_signatures(glyphs, ["l_orderkey"]).where("num < 1000 and den < 1000").distinct()


@query(f"""{_EVENTS} SELECT user_id, count(*) AS n FROM e WHERE cents >= 1500 AND event_type IN ('click', 'view') GROUP BY user_id""")
def counted_notes(spark, sf_dir):
    """Notes of some parts that are long enough to be judged."""
    e = events(spark, sf_dir).withColumn("dur", F.col("cents") / 10000.0)
    return structure.judged_notes(e, 0.15, part="event_type", parts=["click", "view"]).groupBy("user_id").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT DISTINCT (event_id % 5)::INT AS n FROM events), v AS (SELECT ['soprano', 'alto', 'tenor', 'baritone', 'bass'][n + 1] AS kind FROM n)
    SELECT kind, CASE WHEN kind IN ('soprano', 'alto') THEN 'katyusha' ELSE 'keiro_revenant' END AS bank, kind IN ('baritone', 'bass') AS stand_in FROM v""")
def stand_in_singers(spark, sf_dir):
    kinds = numbers(spark, sf_dir, 5).select(entry(("soprano", "alto", "tenor", "baritone", "bass"), F.col("n")).alias("kind"))
    banks = spark.createDataFrame([("katyusha",), ("keiro_revenant",)], "bank string")
    return structure.choose_singers(kinds, banks).select("kind", "bank", "stand_in")


@query("""WITH n AS (SELECT DISTINCT (event_id % 1500)::INT AS n FROM events) SELECT n, round((sin(2 * pi() * 1760 * (n / 44100.0::DOUBLE)) + 0.3 * sin(2 * pi() * 2.01 * 1760 * (n / 44100.0::DOUBLE))) * exp(-90 * (n / 44100.0::DOUBLE)), 6) AS sample FROM n""")
def click_samples(spark, sf_dir):
    return numbers(spark, sf_dir, 1500).select("n", F.round(scalars.click_sample(F.col("n") / 44100.0, 1760.0), 6).alias("sample"))


@query(f"""{_EVENTS}, x AS (SELECT event_id, event_id % 4 AS track, abs(cents) AS a, cents FROM e), p AS (SELECT track, max(a) AS peak FROM x GROUP BY track),
    g AS (SELECT x.track, 2000 / sqrt(avg((cents * cents)::DOUBLE)) AS gain FROM x JOIN p USING (track) WHERE a > 0.5 * peak GROUP BY x.track) SELECT track::INT AS track, round(gain, 9) AS gain FROM g""")
def loudness_gain(spark, sf_dir):
    e = events(spark, sf_dir).select((F.col("event_id") % 4).cast("int").alias("track"), F.lit(0).alias("channel"), F.col("event_id").alias("idx"), F.col("cents").alias("value"))
    return aggregates.loudness_gain(e, "track", "channel", "idx", "value", 2000.0, 0.5).select("track", F.round("gain", 9).alias("gain"))
