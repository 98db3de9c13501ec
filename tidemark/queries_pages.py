"""Queries of the page operators. Symbols are made of order lines: ten orders are a staff or page, parts are places, quantities are heights."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions.constants import ACCIDENTALS, CLEFS, FLAGS, NOTEHEADS, RESTS
from .operators import pages
from .queries import query, read

_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag, l_linestatus"
SYMBOLS = f"""l AS (SELECT l_orderkey // 10 AS p, row_number() OVER (PARTITION BY l_orderkey // 10 ORDER BY {_ORDER}) AS ord, (l_partkey % 400)::DOUBLE AS x,
    l_quantity::DOUBLE AS y, (l_suppkey % 7)::INT AS s, l_linenumber::INT AS ln, l_returnflag AS f, l_linestatus AS st FROM lineitem)"""
STAVES = "v AS (SELECT DISTINCT p, unnest([0, 1, 2]) AS staff, 20.0::DOUBLE AS x0, 300.0::DOUBLE AS x1 FROM l), b AS (SELECT *, 10.0 + 20 * staff AS top, 18.0 + 20 * staff AS bottom, 2.0 AS space FROM v)"
KEY = ["p"]


def symbols(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("p", F.floor(F.col("l_orderkey") / 10))
    ordinal = F.row_number().over(W.partitionBy("p").orderBy(*_ORDER.split(", "))).cast("long")
    return rows.select("p", ordinal.alias("ord"), (F.col("l_partkey") % 400).cast("double").alias("x"), F.col("l_quantity").alias("y"), (F.col("l_suppkey") % 7).cast("int").alias("s"), F.col("l_linenumber").alias("ln"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("st"))


def three_staves(rows):
    v = rows.select("p").distinct().withColumn("staff", F.explode(F.array(*[F.lit(k) for k in range(3)])))
    top = 10.0 + 20 * F.col("staff")
    return v.withColumns({"x0": F.lit(20.0), "x1": F.lit(300.0), "top": top, "bottom": top + 8, "space": F.lit(2.0), "mid": top + 4})


def pick(table, column):
    """A symbol of the table by number."""
    return F.element_at(F.array(*[F.lit(c) for c in table]), (column + 1).cast("int"))


def listed(table) -> str:
    return "[" + ", ".join("'" + c.replace("'", "''") + "'" for c in table) + "]"


@query(f"""WITH {SYMBOLS}, h AS (SELECT p, ord, y, ln % 3 * 0.5::DOUBLE AS width FROM l WHERE s > 1 AND 40 + 5 * s + ln > 60),
    c AS (SELECT p, round_even(width, 2) AS w, count(*) AS n, min(ord) AS o FROM h GROUP BY ALL), m AS (SELECT p, arg_max(w, struct_pack(n := n, o := -o)) AS w FROM c GROUP BY p)
    SELECT p, ord, width FROM h JOIN m USING (p) WHERE abs(width - w) < 0.05""")
def staff_line_candidates(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    lines = rows.select("p", "ord", F.col("y").alias("y0"), (F.col("y") + F.when(F.col("s") > 1, 0).otherwise(1)).alias("y1"), "x", (F.col("ln") % 3 * 0.5).alias("width"), F.col("x").alias("x0"), (F.col("x") + 40 + 5 * F.col("s") + F.col("ln")).alias("x1"))
    return pages.staff_line_candidates(lines, KEY).select("p", "ord", "width")


@query(f"""WITH RECURSIVE {SYMBOLS}, d AS (SELECT DISTINCT p, (ln % 2)::DOUBLE AS x0, y FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY p, x0 ORDER BY y) AS k FROM d),
    w AS (SELECT DISTINCT p, x0, 0::BIGINT AS k, []::DOUBLE[] AS held FROM r
        UNION ALL SELECT r.p, r.x0, r.k, CASE WHEN len(w.held) < 5 THEN list_append(w.held, r.y)
            WHEN greatest(w.held[2] - w.held[1], w.held[3] - w.held[2], w.held[4] - w.held[3], w.held[5] - w.held[4]) - least(w.held[2] - w.held[1], w.held[3] - w.held[2], w.held[4] - w.held[3], w.held[5] - w.held[4]) < 2.5
            THEN [r.y] ELSE list_append(w.held[2:], r.y) END FROM w JOIN r ON r.p = w.p AND r.x0 = w.x0 AND r.k = w.k + 1),
    f AS (SELECT *, [held[i + 1] - held[i] for i in range(1, 5)] AS g FROM w WHERE len(held) = 5)
    SELECT p, x0, held[1] AS top, held[5] AS bottom FROM f WHERE list_max(g) - list_min(g) < 2.5""")
def find_staves(spark, sf_dir):
    lines = symbols(spark, sf_dir).select("p", (F.col("ln") % 2).cast("double").alias("x0"), F.lit(100.0).alias("x1"), F.col("y").alias("y0"))
    found = pages.find_staves(lines, KEY, spread=2.5, least=0.5)
    return found.select("p", "x0", F.get("lines", F.lit(0)).alias("top"), F.get("lines", F.lit(4)).alias("bottom"))


@query(f"""WITH {SYMBOLS}, t AS (SELECT p, ord, ord * 20.0::DOUBLE AS top, ord * 20.0::DOUBLE + 16 AS bottom, ln % 2 AS x0, lag(ord * 20.0::DOUBLE) OVER w AS ptop, lag(ln % 2) OVER w AS px0 FROM l WINDOW w AS (PARTITION BY p ORDER BY ord)),
    j AS (SELECT t.*, CASE WHEN px0 = x0 AND EXISTS (SELECT 1 FROM l WHERE l.p = t.p AND l.ln % 2 = t.x0 AND (l.ord - 1) * 20 <= t.ptop + 0.5 AND l.ord * 20 + l.y >= t.bottom - 0.5) THEN 0 ELSE 1 END AS new FROM t)
    SELECT p, ord, (sum(new) OVER (PARTITION BY p ORDER BY ord ROWS UNBOUNDED PRECEDING) - 1)::INT AS system FROM j""")
def number_systems(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    top = F.col("ord") * 20.0
    staves = rows.select("p", "ord", top.alias("top"), (top + 16).alias("bottom"), (F.col("ln") % 2 * 3).cast("double").alias("x0"))
    lines = rows.select("p", (F.col("ln") % 2 * 3).cast("double").alias("x0"), (F.col("ln") % 2 * 3).cast("double").alias("x1"), ((F.col("ord") - 1) * 20.0).alias("y0"), (F.col("ord") * 20 + F.col("y")).alias("y1"))
    return pages.number_systems(staves, lines, KEY).select("p", "ord", "system")


@query(f"""WITH {SYMBOLS}, {STAVES}, d AS (SELECT l.p, l.ord, b.staff, CASE WHEN l.y * 1.5 >= top - space AND l.y * 1.5 <= bottom + space THEN 0 ELSE least(abs(l.y * 1.5 - top), abs(l.y * 1.5 - bottom)) END AS d
        FROM l JOIN b ON l.p = b.p AND l.x >= b.x0 - 30 AND l.x <= b.x1 + 5)
    SELECT p, ord, min(struct_pack(d := d, staff := staff)).staff AS staff FROM d GROUP BY p, ord HAVING min(d) < 14""")
def staff_of_glyph(spark, sf_dir):
    rows = symbols(spark, sf_dir).withColumn("y", F.col("y") * 1.5)
    return pages.nearest_staff(rows, three_staves(rows), KEY, ["ord"], *pages.glyph_band())


@query(f"""WITH {SYMBOLS}, {STAVES}, t AS (SELECT * FROM l WHERE s < 5 AND ln + 2 >= 5),
    d AS (SELECT t.p, t.ord, b.staff, CASE WHEN t.y + t.ln + 2 >= top - 1 AND t.y <= bottom + 1 THEN 0 ELSE least(abs(t.y + t.ln + 2 - top), abs(t.y - bottom)) END AS d
        FROM t JOIN b ON t.p = b.p AND t.x > b.x0 AND t.x < b.x1)
    SELECT p, ord, min(struct_pack(d := d, staff := staff)).staff AS staff FROM d GROUP BY p, ord HAVING min(d) < 14""")
def staff_of_stem(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    lines = rows.select("p", "ord", F.col("x").alias("x0"), F.col("x").alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.col("ln") + 2).alias("y1"), F.when(F.col("s") < 5, 0.4).otherwise(0.9).alias("width"))
    return pages.nearest_staff(pages.stem_lines(lines), three_staves(rows), KEY, ["ord"], *pages.stem_band())


_STROKES = "s AS (SELECT p, ord, x, 0.4 + 0.3 * s AS width FROM l WHERE s > 0 AND x >= 22 AND x <= 301 AND st = 'F')"


@query(f"""WITH {SYMBOLS}, {STAVES}, {_STROKES}, g AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY p ORDER BY x, ord) < 5 THEN 0 ELSE 1 END AS new FROM s),
    i AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS island FROM g),
    c AS (SELECT p, island, max(x) AS x, min(x) AS lft, bool_or(width > 1.5) AS thick FROM i GROUP BY p, island),
    m AS (SELECT *, thick AND EXISTS (SELECT 1 FROM l WHERE l.p = c.p AND l.f = 'R' AND l.x > c.x AND l.x < c.x + 6) AS repeat_start,
        thick AND EXISTS (SELECT 1 FROM l WHERE l.p = c.p AND l.f = 'R' AND l.x > c.lft - 7 AND l.x < c.lft) AS repeat_end FROM c),
    e AS (SELECT q.p, coalesce(min(l.x), 300) AS first FROM (SELECT DISTINCT p FROM l) q LEFT JOIN l ON l.p = q.p AND l.f = 'N' AND l.x > 60 GROUP BY q.p),
    k AS (SELECT m.* FROM m JOIN e USING (p) WHERE m.x >= e.first), o AS (SELECT m.p, bool_or(repeat_start) AS lead FROM m JOIN e USING (p) WHERE m.x < e.first GROUP BY m.p),
    a AS (SELECT p, x, thick, repeat_start, repeat_end FROM k UNION ALL SELECT e.p, 300, false, false, false FROM e LEFT JOIN (SELECT p, max(x) AS z FROM k GROUP BY p) z USING (p) WHERE z.z IS NULL OR z.z < 297)
    SELECT a.p, x, thick, repeat_start, repeat_end, coalesce(o.lead, false) AS leading_repeat FROM a LEFT JOIN o USING (p)""")
def barlines(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    staves = three_staves(rows)
    y1 = F.when(F.col("st") == "F", 58.0).otherwise(17.0)
    lines = rows.select("p", "ord", F.col("x").alias("x0"), F.col("x").alias("x1"), F.lit(10.0).alias("y0"), y1.alias("y1"), (0.4 + 0.3 * F.col("s")).alias("width"))
    first = rows.where("f = 'N' and x > 60").groupBy("p").agg(F.min("x").alias("x"))
    return pages.barlines(pages.barline_lines(lines, staves, KEY), rows.where("f = 'R'").select("p", "x"), staves, first, KEY)


@query(f"""WITH {SYMBOLS}, {STAVES}, w AS (SELECT p, ord, CASE WHEN s < 2 THEN s::VARCHAR ELSE 'n' || s END AS t, x / 20 AS x, x / 20 + 1 AS x1, y FROM l),
    n AS (SELECT b.p, b.staff, string_agg(t, ' ' ORDER BY w.x, w.ord) AS name FROM w JOIN b ON w.p = b.p WHERE w.x1 < b.x0 - 2 AND abs(w.y - (b.top + 4) - 1.6) < 5 AND NOT regexp_full_match(t, '[0-9]+') GROUP BY ALL)
    SELECT b.p, b.staff, coalesce(n.name, '') AS name FROM b LEFT JOIN n USING (p, staff)""")
def staff_names(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    text = F.when(F.col("s") < 2, F.col("s").cast("string")).otherwise(F.concat(F.lit("n"), F.col("s").cast("string")))
    words = rows.select("p", "ord", text.alias("text"), (F.col("x") / 20).alias("x0"), (F.col("x") / 20 + 1).alias("x1"), "y")
    return pages.staff_names(words, three_staves(rows), KEY)


@query(f"""WITH RECURSIVE {SYMBOLS}, t AS (SELECT l_orderkey AS o, l_linenumber AS k, list(CASE l_linestatus WHEN 'F' THEN '' ELSE 'n' || (l_partkey % 3) END ORDER BY l_suppkey, l_partkey) AS names FROM lineitem GROUP BY ALL),
    r AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY k) AS k, names FROM t),
    w AS (SELECT DISTINCT o, 0::BIGINT AS k, []::VARCHAR[] AS known, []::VARCHAR[] AS now FROM r
        UNION ALL SELECT r.o, r.k, CASE WHEN NOT list_contains(r.names, '') THEN r.names ELSE w.known END,
            CASE WHEN len(list_filter(r.names, lambda x: x <> '')) = 0 AND len(r.names) <= len(w.known) THEN w.known[len(w.known) - len(r.names) + 1:]
            ELSE [CASE WHEN r.names[i] = '' THEN 'Staff' || i ELSE r.names[i] END for i in range(1, len(r.names) + 1)] END FROM w JOIN r ON r.o = w.o AND r.k = w.k + 1)
    SELECT o, k::INT AS k, array_to_string(now, ',') AS names FROM w WHERE k > 0""")
def inherit_names(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), "l_linenumber", "l_suppkey", "l_partkey", "l_linestatus")
    staff = F.row_number().over(W.partitionBy("o", "l_linenumber").orderBy("l_suppkey", "l_partkey")) - 1
    name = F.when(F.col("l_linestatus") == "F", "").otherwise(F.concat(F.lit("n"), (F.col("l_partkey") % 3).cast("string")))
    staves = rows.select("o", F.dense_rank().over(W.partitionBy("o").orderBy("l_linenumber")).alias("k"), staff.alias("staff"), name.alias("name"), F.lit("&").alias("clef"))
    found = pages.inherit_names(staves, ["o"], ["k"])
    return found.groupBy("o", "k").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("staff", "name"))), lambda r: r["name"]), ",").alias("names"))


@query(f"""WITH {SYMBOLS}, g AS (SELECT p, ord, x, y, ['q', 'h', 'e', '.', 'x', 'q', '.'][s + 1] AS ch FROM l), w AS (SELECT p, ord, CASE WHEN ln % 2 = 0 THEN '=' ELSE ln || ',5' END AS t, x + 4 AS x0, x + 9 AS x1, y FROM l),
    n AS (SELECT *, CASE ch WHEN 'q' THEN 1.0 WHEN 'h' THEN 2.0 ELSE 0.5 END AS unit FROM g WHERE ch IN ('q', 'h', 'e') AND y > 44 - 28 AND y < 44),
    d AS (SELECT n.*, CASE WHEN EXISTS (SELECT 1 FROM g WHERE g.p = n.p AND g.ch = '.' AND g.x > n.x AND g.x - n.x < 10 AND abs(g.y - n.y) < 3) THEN 1.5 ELSE 1.0 END AS dot FROM n),
    b AS (SELECT w.p, w.ord, string_agg(o.t, ' ' ORDER BY o.ord) AS tail FROM w JOIN w o ON o.p = w.p AND o.ord <> w.ord AND o.x0 > w.x1 AND o.x0 - w.x1 < 8 AND abs(o.y - w.y) < 2 GROUP BY ALL),
    a AS (SELECT w.*, regexp_extract(w.t || ' ' || coalesce(b.tail, ''), '([0-9]+([.,][0-9]+)?)', 1) AS num FROM w LEFT JOIN b USING (p, ord)),
    m AS (SELECT d.p, d.ord, d.x, d.y, d.unit, d.dot, arg_min(a.num, a.ord) AS num FROM d JOIN a ON a.p = d.p AND a.num <> '' AND a.x0 > d.x AND a.x0 - d.x < 30 AND abs(a.y - d.y) < 3 GROUP BY ALL)
    SELECT p, ord, replace(num, ',', '.')::DOUBLE * unit::DOUBLE * dot::DOUBLE AS qpm FROM m""")
def tempo_marks(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    glyphs = rows.select("p", "ord", "x", "y", pick("qhe.xq.", F.col("s")).alias("ch"), F.lit("OpusTextStd").alias("font"))
    text = F.when(F.col("ln") % 2 == 0, "=").otherwise(F.concat(F.col("ln").cast("string"), F.lit(",5")))
    words = rows.select("p", "ord", text.alias("text"), (F.col("x") + 4).alias("x0"), (F.col("x") + 9).alias("x1"), "y")
    staves = rows.select("p").distinct().withColumns({"staff": F.lit(0), "top": F.lit(44.0), "space": F.lit(2.0)})
    return pages.tempo_marks(glyphs, words, staves, KEY).select("p", "ord", "qpm")


@query(f"""WITH RECURSIVE {SYMBOLS}, h AS (SELECT p, list(struct_pack(k := ord, x := x % 40, y := y) ORDER BY ord) AS hs FROM l WHERE st = 'O' GROUP BY p),
    t AS (SELECT p, ord, row_number() OVER (PARTITION BY p ORDER BY ord) AS k, x % 40 + 4 AS x, y - 6 AS y0, y + 6 AS y1 FROM l WHERE st = 'F'),
    w AS (SELECT p, 0::BIGINT AS k, 0::BIGINT AS stem, []::BIGINT[] AS used, []::BIGINT[] AS got, false AS up FROM h
        UNION ALL SELECT p, k, ord, CASE WHEN ok THEN list_concat(used, ks) ELSE used END, CASE WHEN ok THEN ks ELSE []::BIGINT[] END, up FROM (
            SELECT *, list_transform(near, lambda h: h.k) AS ks, len(near) > 0 AND len(list_filter(near, lambda h: CASE WHEN up THEN x > h.x + 5 - 2.4 AND x < h.x + 5 + 0.6 ELSE x > h.x - 0.6 AND x < h.x + 1.2 END)) > 0 AS ok FROM (
                SELECT *, y1 - list_max(list_transform(near, lambda h: h.y)) < list_min(list_transform(near, lambda h: h.y)) - y0 AS up FROM (
                    SELECT t.*, w.used, list_filter(h.hs, lambda h: NOT list_contains(w.used, h.k) AND ((t.x > h.x + 5 - 2.4 AND t.x < h.x + 5 + 0.6) OR (t.x > h.x - 0.6 AND t.x < h.x + 1.2)) AND h.y >= t.y0 - 2.8 AND h.y <= t.y1 + 2.8) AS near
                    FROM w JOIN t ON t.p = w.p AND t.k = w.k + 1 JOIN h ON h.p = w.p))))
    SELECT p, stem, unnest(got) AS head, up FROM w WHERE len(got) > 0""")
def claim_heads(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    x = F.col("x") % 40
    heads = rows.where("st = 'O'").select("p", "ord", x.alias("x0"), (x + 5).alias("x1"), "y", F.lit(4.0).alias("space"))
    stems = rows.where("st = 'F'").select("p", "ord", (x + 4).alias("x0"), (F.col("y") - 6).alias("y0"), (F.col("y") + 6).alias("y1"))
    return pages.claim_heads(heads, stems, KEY)


@query(f"""WITH {SYMBOLS}, t AS (SELECT p, ord, x, y AS y0, y + 10 AS y1 FROM l WHERE st = 'O'), b AS (SELECT p, x AS x0, x + 32 AS x1, y, ln FROM l WHERE st = 'F' AND f <> 'N'),
    m AS (SELECT t.p, t.ord, t.y0, t.y1, (t.x - b.x0) / 32 AS u, b.y, b.ln, t.x, b.x0, b.x1 FROM t JOIN b ON t.p = b.p AND t.x >= b.x0 - 0.75 AND t.x <= b.x1 + 0.75),
    r AS (SELECT *, CASE WHEN x = x0 OR x = x1 THEN 1 ELSE 1 END AS e, least(y + ln * u, y + 2 + ln * u) AS lo, greatest(y + ln * u, y + 2 + ln * u) AS hi FROM m),
    n AS (SELECT p, ord, count(*) AS n FROM r WHERE hi >= y0 - 0.8 AND lo <= y1 + 0.8 GROUP BY ALL),
    g AS (SELECT p, x, y, [1, 1, 2, 2, 3, 3, 1][s + 1] AS f FROM l WHERE f = 'N'),
    k AS (SELECT t.p, t.ord, max(g.f) AS f FROM t JOIN g ON g.p = t.p AND abs(g.x - t.x) < 1.5 AND abs(g.y - t.y0) < 6 GROUP BY ALL)
    SELECT t.p, t.ord, greatest(coalesce(n.n, 0), coalesce(k.f, 0))::INT AS beams FROM t LEFT JOIN n USING (p, ord) LEFT JOIN k USING (p, ord)""")
def beam_counts(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    stems = rows.where("st = 'O'").select("p", "ord", F.col("x").alias("x0"), F.col("y").alias("y0"), (F.col("y") + 10).alias("y1"), F.col("y").alias("tip"), F.lit(4.0).alias("space"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    beams = rows.where("st = 'F' and f <> 'N'").select("p", F.array(at(0, 0), at(32, F.col("ln")), at(32, F.col("ln") + 2), at(0, 2)).alias("pts"), F.col("x").alias("x0"), (F.col("x") + 32).alias("x1"))
    flags = rows.where("f = 'N'").select("p", "x", "y", pick([*FLAGS, "j"], F.col("s")).alias("ch"))
    return pages.beam_counts(stems, beams, flags, KEY, KEY)


_REST = listed([*RESTS, "x"])


@query(f"""WITH {SYMBOLS}, g AS (SELECT p, ord, y, {_REST}[s + 1] AS ch FROM l WHERE ln > 1)
    SELECT p, ord, ch, CASE ch WHEN 'Œ' THEN 1.0 WHEN '‰' THEN 0.5 WHEN '≈' THEN 0.25 WHEN 'Ó' THEN 2.0 WHEN '®' THEN 0.125 ELSE 0.0 END::DOUBLE AS base, ch = '∑' AS full_bar FROM g
    WHERE ch <> 'x' AND y >= 20 - 4 * CASE WHEN ch = '∑' THEN 0.3 ELSE 2.5 END AND y <= 36 + 4 * CASE WHEN ch = '∑' THEN 0.3 ELSE 2.5 END""")
def rest_rows(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    glyphs = rows.select("p", "ord", "y", pick([*RESTS, "x"], F.col("s")).alias("ch"), F.lit("OpusStd").alias("font"), (F.col("ln") + 12).alias("size"), F.lit(20.0).alias("top"), F.lit(36.0).alias("bottom"), F.lit(4.0).alias("space"))
    return pages.rest_rows(glyphs).select("p", "ord", "ch", "base", "full_bar")


@query(f"""WITH {SYMBOLS} SELECT p, ['œ', 'Q', '&', 'Z', 'j', '!', 'b'][s + 1] AS ch, count(*) AS n FROM l WHERE s IN (1, 3) GROUP BY ALL""")
def unknown_symbols(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    return pages.unknown_symbols(rows.select("p", pick("œQ&Zj!b", F.col("s")).alias("ch"), F.lit("OpusStd").alias("font")), KEY)


@query(f"""WITH {SYMBOLS}, c AS (SELECT p, ord, x, x + 5 AS rgt, y, ln > 3 AS rest FROM l WHERE st = 'O'), d AS (SELECT p, x, y FROM l WHERE st = 'F'),
    m AS (SELECT DISTINCT c.p, c.ord, c.rgt, d.x FROM c JOIN d ON c.p = d.p AND d.x > c.rgt - 0.5 AND d.x < c.rgt + 5.2 * 6 AND abs(d.y - c.y) <= 12 * CASE WHEN rest THEN 1.6 ELSE 0.62 END AND d.x < c.rgt + 2.6 * 12),
    k AS (SELECT *, x - coalesce(lag(x) OVER (PARTITION BY p, ord ORDER BY x), rgt) < 1.3 * 12 AS ok FROM m), n AS (SELECT p, ord, bool_and(ok) OVER (PARTITION BY p, ord ORDER BY x ROWS UNBOUNDED PRECEDING) AS ok FROM k)
    SELECT c.p, c.ord AS chord, coalesce(t.n, 0)::INT AS dots FROM c LEFT JOIN (SELECT p, ord, count_if(ok) AS n FROM n GROUP BY ALL) t USING (p, ord)""")
def dot_counts(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    head = F.struct(F.col("x").alias("x0"), (F.col("x") + 5).alias("x1"), "y")
    chords = rows.where("st = 'O'").select("p", F.col("ord").alias("chord"), F.array(head).alias("heads"), (F.col("ln") > 3).alias("is_rest"), F.lit(12.0).alias("space"))
    return pages.dot_counts(chords, rows.where("st = 'F'").select("p", "x", "y"), KEY)


@query(f"""WITH {SYMBOLS}, c AS (SELECT p, ord, x, y FROM l WHERE st = 'O' AND ln <= 5), v AS (SELECT p, x AS x0, x + 2 * ln AS x1, y AS y0, y + s AS y1 FROM l WHERE st = 'F')
    SELECT DISTINCT c.p, c.ord AS chord FROM c JOIN v ON c.p = v.p WHERE v.x1 - v.x0 > 4 AND v.x0 > c.x - 1 AND v.x0 < c.x + 5 + 6 AND c.y > v.y0 - 1.2 * 4 AND c.y < v.y1 + 1.2 * 4""")
def tied_chords(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    head = F.struct(F.col("x").alias("x0"), (F.col("x") + 5).alias("x1"), "y")
    chords = rows.where("st = 'O'").select("p", F.col("ord").alias("chord"), F.array(head).alias("heads"), (F.col("ln") > 5).alias("is_rest"), F.lit(4.0).alias("space"))
    curves = rows.where("st = 'F'").select("p", F.col("x").alias("x0"), (F.col("x") + 2 * F.col("ln")).alias("x1"), F.col("y").alias("y0"), (F.col("y") + F.col("s")).alias("y1"))
    return pages.tied_chords(chords, curves, KEY, KEY)


_CLEFS = [*CLEFS, "x", "&", "?", "B"]


@query(f"""WITH {SYMBOLS}, g AS (SELECT p, ord, x, y, {listed(_CLEFS)}[s + 1] AS ch FROM l WHERE st = 'O' AND y > 16 AND y < 40), m AS (SELECT p, x, y FROM l WHERE st = 'F')
    SELECT p, ord, x, (CASE ch WHEN '&' THEN 30 WHEN '?' THEN 18 ELSE 28 - 2 * round_even((36 - y) / 4, 0)::INT END - CASE WHEN EXISTS (SELECT 1 FROM m WHERE m.p = g.p AND abs(m.x - g.x) < 12 AND m.y > g.y) THEN 7 ELSE 0 END)::INT AS bottom_step FROM g WHERE ch <> 'x'""")
def clef_events(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    mark = F.col("st") == "F"
    glyphs = rows.select("p", "ord", "x", "y", F.when(mark, "‹").otherwise(pick(_CLEFS, F.col("s"))).alias("ch"), F.when(mark, "OpusSpecialStd").otherwise("OpusStd").alias("font"), F.lit(20.0).alias("top"), F.lit(36.0).alias("bottom"), F.lit(4.0).alias("space"))
    return pages.clef_events(glyphs, KEY)


_ACCIDENTALS = [*ACCIDENTALS, "#", "b"]


@query(f"""WITH {SYMBOLS}, a AS (SELECT p, ord, x, y, {listed(_ACCIDENTALS)}[s + 1] AS ch FROM l WHERE st = 'O'), h AS (SELECT p, x, y FROM l WHERE st = 'F')
    SELECT p, ord, ch FROM a WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.p = a.p AND h.x - (a.x + 3) + 1 > 0 AND h.x - (a.x + 3) + 1 < 3.2 * 6 AND abs(h.y - a.y) < 0.3 * 6)""")
def key_accidentals(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    head = F.col("st") == "F"
    ch = F.when(head, next(iter(NOTEHEADS))).otherwise(pick(_ACCIDENTALS, F.col("s")))
    glyphs = rows.select("p", "ord", F.col("x").alias("x0"), (F.col("x") + 3).alias("x1"), "y", ch.alias("ch"), F.lit("OpusStd").alias("font"), F.lit(6.0).alias("space"))
    return pages.key_accidentals(glyphs, KEY).select("p", "ord", "ch")


@query(f"""WITH {SYMBOLS}, r AS (SELECT *, CASE WHEN x - lag(x) OVER (PARTITION BY p ORDER BY x, ord) > 2.2 * 4 THEN 1 ELSE 0 END AS new FROM l), i AS (SELECT *, sum(new) OVER (PARTITION BY p ORDER BY x, ord ROWS UNBOUNDED PRECEDING) AS run FROM r),
    t AS (SELECT p, run, s AS letter, arg_max(ln % 3 - 1, struct_pack(x := x, o := ord)) AS alt, max(x) AS x FROM i GROUP BY ALL)
    SELECT p, max(x) AS x, coalesce(string_agg(letter || ':' || alt, ',' ORDER BY letter) FILTER (WHERE alt <> 0), '') AS alterations, coalesce(sum(alt), 0)::INT AS fifths FROM t GROUP BY p, run""")
def key_signatures(spark, sf_dir):
    rows = symbols(spark, sf_dir).select("p", "x", "ord", F.col("s").alias("letter"), (F.col("ln") % 3 - 1).alias("alteration"), F.lit(4.0).alias("space"))
    found = pages.key_signatures(rows, KEY)
    text = F.array_join(F.transform(F.array_sort(F.map_entries("alterations")), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return found.select("p", "x", text.alias("alterations"), pages.fifths(F.col("alterations")).alias("fifths"))


@query(f"""WITH {SYMBOLS}, w AS (SELECT p, ord, x AS x0, x + 8 AS x1, y FROM l WHERE f = 'N'), h AS (SELECT p, x, y FROM l WHERE f <> 'N'),
    n AS (SELECT w.*, coalesce((SELECT min(o.x0) FROM w o WHERE o.p = w.p AND abs(o.y - w.y) < 2 AND o.x0 > w.x1), w.x1 + 40) AS nxt FROM w)
    SELECT p, ord, EXISTS (SELECT 1 FROM h WHERE h.p = n.p AND h.x > n.x1 AND h.x - n.x1 < 40 AND h.x < n.nxt AND abs(h.y - n.y) < 2) AS hyphen FROM n""")
def hyphenated(spark, sf_dir):
    rows = symbols(spark, sf_dir)
    words = rows.where("f = 'N'").select("p", "ord", F.col("x").alias("x0"), (F.col("x") + 8).alias("x1"), "y")
    return pages.hyphenated(words, rows.where("f <> 'N'").select("p", F.col("x").alias("x0"), "y"), KEY).select("p", "ord", "hyphen")


@query(f"""WITH {SYMBOLS}, d AS (SELECT DISTINCT p, round_even(y * 0.7, 0) AS y FROM l), n AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY p ORDER BY y) < 1.2 * 1.5 THEN 0 ELSE 1 END AS new FROM d),
    v AS (SELECT p, y, sum(new) OVER (PARTITION BY p ORDER BY y ROWS UNBOUNDED PRECEDING)::INT AS verse FROM n) SELECT l.p, l.ord, v.verse FROM l JOIN v ON v.p = l.p AND v.y = round_even(l.y * 0.7, 0)""")
def verse_rows(spark, sf_dir):
    rows = symbols(spark, sf_dir).withColumn("y", F.col("y") * 0.7)
    return pages.verse_rows(rows, KEY, F.lit(1.5)).select("p", "ord", "verse")


@query(f"""WITH {SYMBOLS}, k AS (SELECT p, ord, CASE WHEN st = 'F' THEN x * 0.25 + 0.8 * y + 2 ELSE x * 0.25 + 0.8 * least(y, 20) + 0.5 * greatest(0, y - 24) END AS score, ln FROM l WHERE x * 0.25 < 60)
    SELECT p, ln, round(min(score), 6) AS score, arg_min(ord, struct_pack(s := score, o := ord)) AS ord FROM k GROUP BY p, ln""")
def lyric_notes(spark, sf_dir):
    """Of the words at a note the one that fits it best."""
    from .operators import structure

    rows = symbols(spark, sf_dir).withColumn("dx", F.col("x") * 0.25)
    sides = [rows.where(f"st {'=' if above else '<>'} 'F'").withColumn("score", pages.lyric_score(F.col("dx"), F.col("y"), F.lit(4.0), F.lit(above))).select("p", "ln", "score", "ord", "dx") for above in (False, True)]
    return structure.best_scoring(sides, ["p", "ln"], "score", "ord", F.col("dx") < 60).select("p", "ln", F.round("score", 6).alias("score"), "ord")


@query(f"""WITH {SYMBOLS}, c AS (SELECT p, ln AS idx, ord, x, y, st = 'F' AS up, s > 4 AS rest, s = 3 AS bare, 1 + s % 3 AS dur FROM l),
    n AS (SELECT DISTINCT a.p, a.idx FROM c a JOIN c b ON a.p = b.p AND a.idx = b.idx WHERE NOT a.rest AND NOT b.rest AND a.up AND NOT b.up AND abs(a.x - b.x) < 4 * CASE WHEN a.bare OR b.bare THEN 2.2 ELSE 1.6 END),
    t AS (SELECT p, idx, sum(dur) AS a, coalesce(sum(dur) FILTER (WHERE NOT rest AND up), 0) AS u, coalesce(sum(dur) FILTER (WHERE NOT rest AND NOT up), 0) AS d, bool_or(NOT rest AND up) AS hu, bool_or(NOT rest AND NOT up) AS hd, bool_or(rest AND abs(y - 25) > 1.2 * 4) AS off FROM c GROUP BY p, idx),
    f AS (SELECT t.p, t.idx, n.p IS NOT NULL OR (hu AND hd AND off AND a > 1.9 * greatest(u, d)) AS two FROM t LEFT JOIN n USING (p, idx))
    SELECT c.p, c.ord, CASE WHEN two AND CASE WHEN rest THEN y > 25 ELSE NOT up END THEN 1 ELSE 0 END::INT AS voice FROM c JOIN f USING (p, idx)""")
def split_voices(spark, sf_dir):
    """Two voices of a staff in a bar, by stems and rests."""
    from .plans import score

    rows = symbols(spark, sf_dir)
    none = F.lit(None).cast("double")
    chords = rows.select(
        F.lit("s").alias("score_id"), F.lit(0).alias("page"), F.lit(0).alias("system"), F.col("p").alias("staff"), F.col("ln").alias("idx"), "ord", "x", "y", (F.col("st") == "F").alias("up"), (F.col("s") > 4).alias("is_rest"),
        F.when(F.col("s") == 3, none).otherwise(F.col("x")).alias("stem_x"), (1.0 + F.col("s") % 3).alias("dur"), F.lit(False).alias("full_bar"), F.lit(25.0).alias("mid"), F.lit(4.0).alias("space"),
    )
    return score.split_voices(chords).select(F.col("staff").alias("p"), "ord", "voice")


@query(f"""WITH {SYMBOLS}, b AS (SELECT p, ord, x, s + 24 AS bottom FROM l WHERE st = 'O' AND f = 'R'), h AS (SELECT p, ord, x, y FROM l WHERE st = 'F'),
    k AS (SELECT h.p, h.ord, arg_max(b.bottom, struct_pack(x := b.x, o := b.ord)) AS bottom FROM h JOIN b ON b.p = h.p AND b.x <= h.x + 1 GROUP BY ALL)
    SELECT h.p, h.ord, coalesce(k.bottom, 30)::INT AS bottom FROM h LEFT JOIN k USING (p, ord)""")
def clef_at(spark, sf_dir):
    """The clef in force at a head: the last one at most 1 right of it, else treble."""
    from .operators import joins

    rows = symbols(spark, sf_dir)
    marks = rows.where("st = 'O' and f = 'R'").select("p", (F.col("x") - 1).alias("x"), "ord", (F.col("s") + 24).alias("bottom"))
    found = joins.asof(rows.where("st = 'F'").select("p", F.col("ord").alias("head"), "x"), marks, KEY, "x", ["ord"], ["bottom"])
    return found.select("p", F.col("head").alias("ord"), F.coalesce("bottom", F.lit(30)).alias("bottom"))
