"""The registered queries of the ordered-event operators and their SQL. Amounts are in whole cents, so sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import scalars, text
from .operators import aggregates, joins, ordered, signal, structure

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with s (whole seconds) and cents (whole)."""
    e = read(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"), F.floor(F.col("value") * 100).cast("long").alias("cents"))


EVENTS = "WITH e AS (SELECT event_id, user_id, event_type, (epoch_us(ts) // 1000000)::BIGINT AS s, floor(value * 100)::BIGINT AS cents FROM events)"
GAP = 6 * 3600
#: Line numbers repeat within an order, so parts and suppliers break ties.
LINE = ["l_linenumber", "l_partkey", "l_suppkey", "q"]


@query(f"""{EVENTS}, n AS (SELECT *, CASE WHEN s - lag(s) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM n)
    SELECT user_id, island, min(s) AS started, max(s) AS ended, count(*) AS n FROM i GROUP BY user_id, island""")
def gap_islands(spark, sf_dir):
    runs = ordered.gap_islands(events(spark, sf_dir), ["user_id"], ["s", "event_id"], F.col("s"), F.col("s"), GAP)
    return runs.groupBy("user_id", "island").agg(F.min("s").alias("started"), F.max("s").alias("ended"), F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_quantity::BIGINT AS q, l_partkey AS pk, l_suppkey AS sk FROM lineitem),
    j AS (SELECT *, CASE WHEN lag(l_returnflag) OVER w = l_returnflag AND lag(l_linestatus) OVER w = l_linestatus AND lag(l_linenumber) OVER w + 1 = l_linenumber THEN 0 ELSE 1 END AS new
        FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, pk, sk, q)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, pk, sk, q ROWS UNBOUNDED PRECEDING) AS island FROM j)
    SELECT l_orderkey, any_value(l_returnflag) AS l_returnflag, any_value(l_linestatus) AS l_linestatus, min(l_linenumber) AS l_linenumber, count(*) AS n, sum(q)::BIGINT AS quantity FROM i GROUP BY l_orderkey, island""")
def tie_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").alias("q"), "l_partkey", "l_suppkey")
    w = W.partitionBy("l_orderkey").orderBy(*LINE)
    joins_on = (F.lag("l_returnflag").over(w) == F.col("l_returnflag")) & (F.lag("l_linestatus").over(w) == F.col("l_linestatus")) & (F.lag("l_linenumber").over(w) + 1 == F.col("l_linenumber"))
    runs = ordered.islands_where(rows, ["l_orderkey"], LINE, joins_on)
    return runs.groupBy("l_orderkey", "island").agg(F.first("l_returnflag").alias("l_returnflag"), F.first("l_linestatus").alias("l_linestatus"), F.min("l_linenumber").alias("l_linenumber"), F.count("*").alias("n"), F.sum("q").alias("quantity")).drop("island")


_BARS = """WITH b AS (SELECT l_orderkey, l_linenumber, l_quantity::BIGINT AS q, l_partkey AS pk, l_suppkey AS sk, l_returnflag = 'R' AS opens, l_returnflag = 'A' AS closes, (1 + l_quantity::BIGINT % 3)::INT AS times FROM lineitem),
    n AS (SELECT *, CASE WHEN opens OR coalesce(lag(closes) OVER w, false) THEN 1 ELSE 0 END AS new FROM b WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, pk, sk, q)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, pk, sk, q ROWS UNBOUNDED PRECEDING)::BIGINT AS section FROM n)"""


def bars(spark, sf_dir):
    q = F.col("l_quantity").cast("long")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("q"), (F.col("l_returnflag") == "R").alias("opens"), (F.col("l_returnflag") == "A").alias("closes"), (1 + q % 3).cast("int").alias("times"))


@query(f"""{_BARS}, t AS (SELECT *, max(CASE WHEN closes THEN greatest(1, times) ELSE 1 END) OVER (PARTITION BY l_orderkey, section) AS k FROM s),
    u AS (SELECT *, unnest(generate_series(1, k))::INT AS pass FROM t)
    SELECT l_orderkey, l_linenumber, pass, section, row_number() OVER (PARTITION BY l_orderkey ORDER BY section, pass, l_linenumber, pk, sk, q)::INT AS position FROM u""")
def repeat_unroll(spark, sf_dir):
    return ordered.unroll_repeats(bars(spark, sf_dir), ["l_orderkey"], LINE, "opens", "closes", "times").select("l_orderkey", "l_linenumber", "pass", "section", "position")


@query(f"""{_BARS} SELECT l_orderkey, l_linenumber, section, coalesce(last_value(CASE WHEN q > 25 THEN times END IGNORE NULLS) OVER (PARTITION BY l_orderkey, section ORDER BY l_linenumber, pk, sk, q ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 2) AS times FROM s""")
def repeat_times(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("written", F.when(F.col("q") > 25, F.col("times"))).drop("times")
    return ordered.repeat_times(rows, ["l_orderkey"], LINE, "opens", "closes", "written").select("l_orderkey", "l_linenumber", "section", "times")


@query(f"""{EVENTS}, g AS (SELECT user_id, s, max(struct_pack(event_id := event_id)).event_id AS signup_id FROM e WHERE event_type = 'signup' GROUP BY user_id, s)
    SELECT e.event_id, g.signup_id FROM e ASOF LEFT JOIN g ON e.user_id = g.user_id AND e.s >= g.s""")
def asof_lookup(spark, sf_dir):
    e = events(spark, sf_dir)
    marks = e.where("event_type = 'signup'").select("user_id", "s", F.col("event_id").alias("signup_id"))
    return joins.asof(e.select("event_id", "user_id", "s"), marks, ["user_id"], "s", ["signup_id"], ["signup_id"]).select("event_id", "signup_id")


@query(f"""{EVENTS}, g AS (SELECT user_id, s, max(event_id) AS signup_id FROM e WHERE event_type = 'signup' GROUP BY user_id, s)
    SELECT e.event_id, g.signup_id FROM e ASOF LEFT JOIN g ON e.user_id = g.user_id AND e.s > g.s""")
def asof_strict(spark, sf_dir):
    e = events(spark, sf_dir)
    marks = e.where("event_type = 'signup'").select("user_id", "s", F.col("event_id").alias("signup_id"))
    return joins.asof(e.select("event_id", "user_id", "s"), marks, ["user_id"], "s", ["signup_id"], ["signup_id"], strict=True, width=30 * 86400).select("event_id", "signup_id")


@query(f"""{EVENTS} SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN cents END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS last_purchase FROM e""")
def forward_fill(spark, sf_dir):
    return ordered.forward_fill(events(spark, sf_dir), ["user_id"], ["s", "event_id"], F.when(F.col("event_type") == "purchase", F.col("cents")), "last_purchase").select("event_id", "last_purchase")


@query(f"""{EVENTS}, l AS (SELECT * FROM e WHERE event_type = 'error'), r AS (SELECT * FROM e WHERE event_type = 'purchase')
    SELECT l.event_id, arg_min(r.event_id, struct_pack(d := abs(l.s - r.s), o := r.event_id)) AS near_id, min(abs(l.s - r.s)) AS distance FROM l JOIN r USING (user_id) GROUP BY l.event_id""")
def nearest_event(spark, sf_dir):
    e = events(spark, sf_dir).select("event_id", "user_id", "s", "event_type")
    right = e.where("event_type = 'purchase'").select("user_id", "s", F.col("event_id").alias("near_id"))
    found = joins.nearest(e.where("event_type = 'error'").drop("event_type"), right, ["user_id"], "s", "event_id", ["near_id"], "near_id", width=20 * 86400)
    return found.select("event_id", "near_id", "distance")


@query("""WITH p AS (SELECT a.s_suppkey AS l_id, b.s_suppkey AS r_id, abs(floor(a.s_acctbal * 100)::BIGINT - floor(b.s_acctbal * 100)::BIGINT) AS distance FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)
    SELECT l_id, r_id, distance, row_number() OVER (PARTITION BY l_id ORDER BY distance, r_id)::INT AS rank FROM p QUALIFY rank <= 3""")
def k_nearest(spark, sf_dir):
    s = read(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", F.floor(F.col("s_acctbal") * 100).cast("long").alias("c"))
    left, right = s.select("s_nationkey", F.col("s_suppkey").alias("l_id"), F.col("c").alias("lc")), s.select("s_nationkey", F.col("s_suppkey").alias("r_id"), F.col("c").alias("rc"))
    # each supplier is near itself: one more is asked for, and itself left out
    found = joins.k_nearest(left, right, ["s_nationkey"], "lc", "rc", "r_id", 4).where("l_id <> r_id").drop("rank")
    return ordered.top_k(found, ["l_id"], ["distance", "r_id"], 3, "rank").select("l_id", "r_id", "distance", "rank")


@query(f"""{EVENTS}, c AS (SELECT * FROM e WHERE event_type = 'click'), v AS (SELECT * FROM e WHERE event_type = 'view')
    SELECT event_id FROM c WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.user_id = c.user_id AND c.s < v.s + 43200 AND v.s < c.s + 43200)""")
def interval_overlap_anti(spark, sf_dir):
    e = events(spark, sf_dir)
    left = e.where("event_type = 'click'").select("event_id", "user_id", F.col("s").alias("l_start"), (F.col("s") + 43200).alias("l_end"))
    right = e.where("event_type = 'view'").select("user_id", F.col("s").alias("r_start"), (F.col("s") + 43200).alias("r_end"))
    return joins.interval_overlap(left, right, ["user_id"], 86400.0, how="left_anti").select("event_id")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, (epoch_us(o_orderdate) // 86400000000)::BIGINT AS d FROM orders)
    SELECT a.o_orderkey AS l_order, b.o_orderkey AS r_order FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey AND a.d < b.d + 30 AND b.d < a.d + 30""")
def interval_overlap(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("d"))
    left = o.select("o_custkey", F.col("o_orderkey").alias("l_order"), F.col("d").alias("l_start"), (F.col("d") + 30).alias("l_end"))
    right = o.select("o_custkey", F.col("o_orderkey").alias("r_order"), F.col("d").alias("r_start"), (F.col("d") + 30).alias("r_end"))
    return joins.interval_overlap(left, right, ["o_custkey"], 60.0).where("l_order < r_order").select("l_order", "r_order")


@query("""WITH o AS (SELECT o_custkey, o_orderkey, epoch_us(o_orderdate) // 1000000 AS s FROM orders),
    b AS (SELECT o_custkey, s, min(o_orderkey) AS band, lead(s) OVER (PARTITION BY o_custkey ORDER BY s) AS stop FROM o GROUP BY o_custkey, s)
    SELECT o.o_orderkey, b.band FROM o JOIN b ON o.o_custkey = b.o_custkey AND o.s >= b.s AND (b.stop IS NULL OR o.s < b.stop)""")
def interval_bucket(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"))
    starts = o.groupBy("o_custkey", "s").agg(F.min("o_orderkey").alias("band"))
    spans = starts.withColumn("stop", F.coalesce(F.lead("s").over(W.partitionBy("o_custkey").orderBy("s")), F.lit(1 << 60)))
    return joins.interval_lookup(o, spans, ["o_custkey"], "s", "s", "stop", ["band"], ["band"]).select("o_orderkey", "band")


@query("""SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity::BIGINT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM lineitem""")
def prefix_sum(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return ordered.prefix_sum(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey"], F.col("q")).select("l_orderkey", "l_linenumber", "start")


@query("""WITH c AS (SELECT o_custkey, o_orderstatus, lag(o_orderstatus) OVER w AS p, row_number() OVER w AS k, o_orderkey FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
    SELECT o_custkey, o_orderkey, o_orderstatus FROM c WHERE k = 1 OR p IS DISTINCT FROM o_orderstatus""")
def change_detect(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate")
    return ordered.change_detect(rows, ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus").drop("o_orderdate")


@query(f"""{EVENTS}, k AS (SELECT event_id, user_id, CASE WHEN s - lag(s) OVER w < 86400 OR lag(s) OVER w IS NULL THEN 1 ELSE 0 END AS ok, s FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    m AS (SELECT user_id, min(ok) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING) AS ok FROM k)
    SELECT user_id, sum(ok)::BIGINT AS n FROM m GROUP BY user_id""")
def chain_count(spark, sf_dir):
    e = events(spark, sf_dir)
    before = F.lag("s").over(W.partitionBy("user_id").orderBy("s", "event_id"))
    return ordered.chain_count(e, ["user_id"], ["s", "event_id"], (F.col("s") - before < 86400) | before.isNull())


@query(f"""WITH RECURSIVE {EVENTS[5:]}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY s, event_id) AS k FROM e),
    w AS (SELECT user_id, event_id, k, s AS anchor, 0 AS cluster FROM r WHERE k = 1
        UNION ALL SELECT r.user_id, r.event_id, r.k, CASE WHEN r.s - w.anchor >= 86400 THEN r.s ELSE w.anchor END, w.cluster + (r.s - w.anchor >= 86400)::INT FROM w JOIN r ON r.user_id = w.user_id AND r.k = w.k + 1)
    SELECT event_id, user_id, cluster::INT AS cluster FROM w""")
def anchored_clusters(spark, sf_dir):
    found = ordered.anchored_clusters(events(spark, sf_dir).select("event_id", "user_id", "s"), ["user_id"], ["s", "event_id"], "s", 86400)
    return found.select("event_id", "user_id", "cluster")


@query(f"""{EVENTS}, b AS (SELECT event_id, s AS start, (cents % 20)::BIGINT AS len FROM e), u AS (SELECT *, unnest(generate_series(0, len - 1, 2)) AS p FROM b WHERE len > 0)
    SELECT event_id, start + p AS t, CASE WHEN p = 0 THEN 2 WHEN p % 4 = 0 THEN 1 ELSE 0 END AS level FROM u""")
def beat_grid(spark, sf_dir):
    rows = events(spark, sf_dir).select("event_id", F.col("s").alias("start"), (F.col("cents") % 20).alias("length"), F.lit(2).cast("long").alias("unit"))
    return ordered.beat_grid(rows, "start", "length", "unit", 2).select("event_id", "t", "level")


_SLIDE = "OVER (PARTITION BY user_id ORDER BY s, event_id ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"


@query(f"{EVENTS} SELECT event_id, max(abs(cents)) {_SLIDE} AS envelope FROM e")
def sliding_max(spark, sf_dir):
    return ordered.sliding(events(spark, sf_dir), ["user_id"], ["s", "event_id"], F.abs("cents"), 3, 3, "max", "envelope").select("event_id", "envelope")


@query(f"{EVENTS} SELECT event_id, sum(cents) {_SLIDE}::BIGINT AS moving_sum, count(*) {_SLIDE} AS n FROM e")
def moving_average(spark, sf_dir):
    e = ordered.sliding(events(spark, sf_dir), ["user_id"], ["s", "event_id"], F.col("cents"), 3, 3, "sum", "moving_sum")
    return ordered.sliding(e, ["user_id"], ["s", "event_id"], F.lit(1).cast("long"), 3, 3, "sum", "n").select("event_id", "moving_sum", "n")


@query(f"""{EVENTS}, m AS (SELECT *, max(abs(cents)) {_SLIDE} AS env FROM e), g AS (SELECT *, CASE WHEN env > 5000 THEN 5000::DOUBLE / env ELSE 1.0::DOUBLE END AS gain FROM m)
    SELECT event_id, min(gain) {_SLIDE} AS gain FROM g""")
def limiter_gain(spark, sf_dir):
    e = ordered.sliding(events(spark, sf_dir), ["user_id"], ["s", "event_id"], F.abs("cents"), 3, 3, "max", "env")
    e = e.withColumn("g", F.when(F.col("env") > 5000, F.lit(5000.0) / F.col("env")).otherwise(1.0))
    return ordered.sliding(e, ["user_id"], ["s", "event_id"], F.col("g"), 3, 3, "min", "gain").select("event_id", "gain")


@query(f"""{EVENTS}, c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS o FROM e GROUP BY ALL)
    SELECT user_id, arg_max(event_type, struct_pack(n := n, o := -o)) AS event_type, max(n) AS n FROM c GROUP BY user_id""")
def mode_first_seen(spark, sf_dir):
    return aggregates.mode_first_seen(events(spark, sf_dir), ["user_id"], "event_type", "event_id")


@query("SELECT event_type, min(event_id) AS first_seen FROM events GROUP BY event_type")
def distinct_first_seen(spark, sf_dir):
    return aggregates.distinct_first_seen(read(spark, sf_dir, "events"), "event_type", "event_id")


@query(f"{EVENTS} SELECT event_type, list_sort(list(cents))[count(*) // 2 + 1] AS upper_median FROM e GROUP BY event_type")
def upper_median(spark, sf_dir):
    return aggregates.upper_median(events(spark, sf_dir), ["event_type"], "cents")


@query(f"{EVENTS} SELECT event_type, quantile_cont(cents, 0.5)::DOUBLE AS median, round(quantile_cont(cents::DOUBLE, 0.9), 6) AS p90 FROM e GROUP BY event_type")
def percentile_report(spark, sf_dir):
    found = aggregates.percentile_report(events(spark, sf_dir), ["event_type"], "cents")
    return found.withColumn("p90", F.round("p90", 6))


@query(f"{EVENTS} SELECT user_id, coalesce(sqrt(avg(CASE WHEN abs(cents) > 2000 THEN (cents * cents)::DOUBLE END)), 1.0) AS rms FROM e GROUP BY user_id")
def active_rms(spark, sf_dir):
    return aggregates.active_rms(events(spark, sf_dir), ["user_id"], "cents", 2000)


@query(f"{EVENTS} SELECT (event_id // 441)::BIGINT AS frame, sqrt(avg((cents * cents)::DOUBLE)) AS rms FROM e GROUP BY 1 HAVING count(*) = 441")
def frame_rms(spark, sf_dir):
    return aggregates.frame_rms(events(spark, sf_dir), [], "event_id", "cents", 441)


@query(f"{EVENTS} SELECT user_id, count(*) AS n, count_if(cents > 5000) AS loud, count_if(event_type = 'error') AS errors FROM e GROUP BY user_id")
def conditional_report(spark, sf_dir):
    return aggregates.conditional_report(events(spark, sf_dir), ["user_id"], loud=F.col("cents") > 5000, errors=F.col("event_type") == "error")


@query(f"{EVENTS} SELECT user_id, coalesce(min(CASE WHEN event_type = 'error' THEN cents END), 60) AS lowest, coalesce(max(CASE WHEN event_type = 'error' THEN cents END), 60) AS highest FROM e GROUP BY user_id")
def extremes_with_default(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "error", F.col("cents")))
    return aggregates.extremes(e, ["user_id"], "v", 60)


@query(f"""{EVENTS} SELECT event_id, user_id, cents FROM e QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY cents DESC, event_id) <= 8""")
def top_eight(spark, sf_dir):
    return ordered.top_k(events(spark, sf_dir), ["user_id"], [F.desc("cents"), "event_id"], 8).select("event_id", "user_id", "cents")


@query("""WITH x AS (SELECT label, (1 + vec_id % 3)::BIGINT AS w, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    t AS (SELECT label, sum(1 + vec_id % 3) AS w FROM embeddings GROUP BY label)
    SELECT x.label, pos::INT AS pos, sum(x.w * floor(v::DOUBLE * 1000000)::BIGINT)::DOUBLE / any_value(t.w)::DOUBLE AS blend FROM x JOIN t USING (label) GROUP BY x.label, pos""")
def weighted_blend(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: F.floor(v.cast("double") * 1000000).cast("long")).alias("v"))
    return aggregates.weighted_blend(e, ["label"], "v", (1 + F.col("vec_id") % 3).cast("long"))


@query(f"""{EVENTS}, t AS (SELECT event_id + k AS idx, cents * [8, 4, 2, 1][k + 1] AS a FROM e, generate_series(0, 3) AS g(k)) SELECT idx, sum(a)::BIGINT AS amount FROM t GROUP BY idx""")
def overlap_add(spark, sf_dir):
    return aggregates.overlap_add(events(spark, sf_dir), F.col("event_id"), F.col("cents"), [8, 4, 2, 1])


@query(f"""{EVENTS}, g AS (SELECT event_type, (1 + length(event_type))::BIGINT AS gain FROM e GROUP BY event_type) SELECT s // 3600 AS hour, sum(cents * gain)::BIGINT AS cents FROM e JOIN g USING (event_type) GROUP BY 1""")
def mix_bus(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hour", F.floor(F.col("s") / 3600))
    gains = e.select("event_type").distinct().withColumn("gain", (1 + F.length("event_type")).cast("long"))
    return aggregates.mix_bus(e, gains, "event_type", "hour", "cents")


@query("""WITH m AS (SELECT DISTINCT (event_id % 128)::INT AS midi FROM events) SELECT midi, round(440.0::DOUBLE * pow(2.0::DOUBLE, (midi - 69) / 12.0::DOUBLE), 6) AS hz FROM m""")
def midi_hz(spark, sf_dir):
    m = read(spark, sf_dir, "events").select((F.col("event_id") % 128).cast("int").alias("midi")).distinct()
    return m.select("midi", F.round(scalars.midi_hz(F.col("midi")), 6).alias("hz"))


@query("""WITH m AS (SELECT DISTINCT (event_id % 128)::INT AS midi, (event_id % 2 - 1)::INT AS fifths FROM events)
    SELECT midi, fifths, CASE WHEN fifths >= 0 THEN ['C','C','D','D','E','F','F','G','G','A','A','B'][midi % 12 + 1] ELSE ['C','D','D','E','E','F','G','G','A','A','B','B'][midi % 12 + 1] END AS step,
    CASE WHEN (midi % 12) NOT IN (1, 3, 6, 8, 10) THEN 0 WHEN fifths >= 0 THEN 1 ELSE -1 END AS alter_by, (midi // 12 - 1)::INT AS octave FROM m""")
def pitch_spelling(spark, sf_dir):
    m = read(spark, sf_dir, "events").select((F.col("event_id") % 128).cast("int").alias("midi"), (F.col("event_id") % 2 - 1).cast("int").alias("fifths")).distinct()
    p = scalars.spelling(F.col("midi"), F.col("fifths"))
    return m.select("midi", "fifths", p["step"].alias("step"), p["alter"].alias("alter_by"), p["octave"].alias("octave"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN p AND h THEN 'middle' WHEN p THEN 'end' WHEN h THEN 'begin' ELSE 'single' END AS syllabic FROM (
    SELECT l_orderkey, l_linenumber, l_returnflag = 'N' AS h, coalesce(lag(l_returnflag = 'N') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey), false) AS p FROM lineitem)""")
def syllabic(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("h", F.col("l_returnflag") == "N")
    before = F.lag("h").over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    return rows.select("l_orderkey", "l_linenumber", scalars.syllabic(before, F.col("h")).alias("syllabic"))


@query("""SELECT doc_id, trim(regexp_replace(replace(replace(replace(lower(text), '’', ''''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[^a-zäöüß''\\- ]', '', 'g'), '-'' ') AS cleaned FROM documents""")
def clean_word(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", text.clean_word(F.col("text")).alias("cleaned"))


_TOKENS = ["tion", "ing", "and", "the", "th", "er", "re", "on", "an", "en", "a", "e", "i", "o", "u"]


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(text, '({"|".join(_TOKENS)})', 1) AS t FROM documents) SELECT doc_id, len(t) AS n_tokens, array_to_string(t, ' ') AS tokens FROM t""")
def ordered_tokenise(spark, sf_dir):
    t = read(spark, sf_dir, "documents").select("doc_id", text.ordered_tokens(F.col("text"), _TOKENS).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.array_join("t", " ").alias("tokens"))


@query("""SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM pages""")
def escape_xml(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.escape_xml(F.col("html")).alias("escaped"))


@query("""WITH m AS (SELECT conv_id, max(turn) AS last FROM conversations GROUP BY conv_id), p AS (SELECT conv_id, last, unnest([1, 2, 3]) AS pass FROM m)
    SELECT p.conv_id, p.pass, coalesce(e.role, CASE WHEN p.pass > 1 THEN l.role END, f.role) AS verse FROM p LEFT JOIN conversations e ON e.conv_id = p.conv_id AND e.turn = p.pass
    LEFT JOIN conversations l ON l.conv_id = p.conv_id AND l.turn = p.last LEFT JOIN conversations f ON f.conv_id = p.conv_id AND f.turn = 1""")
def verse_pick(spark, sf_dir):
    verses = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("turn", "role"))).alias("m"))
    passes = verses.withColumn("pass", F.explode(F.array(*[F.lit(k) for k in (1, 2, 3)])))
    return passes.select("conv_id", "pass", text.verse_of_pass(F.col("m"), F.col("pass").cast("long")).alias("verse"))


@query(f"""{EVENTS}, k AS (SELECT event_id AS x, cents AS y, lead(event_id) OVER (ORDER BY event_id) AS x2, lead(cents) OVER (ORDER BY event_id) AS y2 FROM e WHERE event_id % 7 = 0)
    SELECT e.event_id AS x, (CASE WHEN e.event_id = k.x OR k.x2 IS NULL THEN k.y::DOUBLE ELSE k.y + (k.y2 - k.y) * (e.event_id - k.x)::DOUBLE / (k.x2 - k.x) END)::DOUBLE AS y FROM e ASOF JOIN k ON e.event_id >= k.x""")
def interpolate_grid(spark, sf_dir):
    return _between_knots(events(spark, sf_dir).select(F.col("event_id").alias("x"), F.col("cents").alias("y")))


def _between_knots(e: DataFrame, size: int = 7 * 1000) -> DataFrame:
    """The y of the rows whose x is a multiple of 7, interpolated at every x from the first of them on, in blocks of the axis."""
    knots = e.where("x % 7 = 0")
    start = knots.agg(F.min("x").alias("__start"))
    reached = e.crossJoin(F.broadcast(start)).where(F.col("x") >= F.col("__start")).drop("__start")
    return signal.interpolate(knots, reached, [], "x", "y", size).select("x", "y")


@query(f"""{EVENTS}, l AS (SELECT user_id, list(cents::DOUBLE ORDER BY s, event_id) AS xs FROM e GROUP BY user_id) SELECT user_id, list_reduce(xs, lambda y, x: y * 0.5::DOUBLE + x) AS last, len(xs) AS n FROM l""")
def recursive_filter(spark, sf_dir):
    e = signal.recursive_filter(events(spark, sf_dir), ["user_id"], ["s", "event_id"], "cents", [1.0], [1.0, -0.5])
    return e.groupBy("user_id").agg(F.max_by("y", F.struct("s", "event_id")).alias("last"), F.count("*").alias("n"))


#: A small dictionary for the segmentation query.
DICTIONARY = frozenset("the then there thing think this that than and any are art here heat hear her ring in ing into on one once over er ever even end ending tion action notion station rest or order nation at ate ten tent out found".split())


@query(f"""WITH RECURSIVE d AS (SELECT unnest([{", ".join(f"'{w}'" for w in sorted(DICTIONARY))}]) AS w),
    v AS (SELECT DISTINCT word FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents)),
    c AS (SELECT word, 0 AS done, []::INT[] AS starts FROM v
        UNION ALL SELECT c.word, c.done + length(d.w), list_prepend(c.done, c.starts) FROM c JOIN d ON substr(c.word, c.done + 1, length(d.w)) = d.w),
    b AS (SELECT word, min(struct_pack(n := len(starts), s := starts)).s AS s FROM c WHERE done = length(word) GROUP BY word)
    SELECT v.word, coalesce(len(b.s), 1)::INT AS n_words, coalesce(array_to_string(list_reverse(b.s), ','), '0') AS starts FROM v LEFT JOIN b USING (word)""")
def fewest_words(spark, sf_dir):
    """Each distinct run of letters of the documents as the fewest words of a small dictionary: where they start. A run that they do not cover stays one word."""
    runs = read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), 0)).alias("word")).distinct()
    ends = runs.select("word", text.segment_column(F.split("word", ""), DICTIONARY).alias("ends"))
    starts = F.concat(F.array(F.lit(0)), F.slice("ends", 1, F.size("ends") - 1))
    return ends.select("word", F.size("ends").alias("n_words"), F.array_join(starts.cast("array<string>"), ",").alias("starts"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS pk, l_suppkey AS sk, l_quantity::BIGINT AS q, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN -1 END AS mark FROM lineitem)
    SELECT l_orderkey, l_linenumber, q, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY l_orderkey, q % 2 ORDER BY l_linenumber, pk, sk, q ROWS UNBOUNDED PRECEDING), 0)::INT AS alter FROM r""")
def accidental_memory(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("c", F.col("q") % 2)
    mark = F.when(F.col("opens"), 1).when(F.col("closes"), -1)
    return ordered.persist_in_bar(rows, ["l_orderkey", "c"], LINE, mark, F.lit(0), "alter").select("l_orderkey", "l_linenumber", "q", "alter")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS pk, l_suppkey AS sk, l_quantity::BIGINT AS q FROM lineitem)
    SELECT l_orderkey, q, (l_linenumber - (first_value(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, pk, sk, q) < 10)::INT)::INT AS number FROM r""")
def pickup_numbering(spark, sf_dir):
    rows = bars(spark, sf_dir).withColumn("number", F.col("l_linenumber"))
    return ordered.pickup_numbers(rows, ["l_orderkey"], LINE, "number", F.col("q") < 10).select("l_orderkey", "q", "number")


@query(f"""{EVENTS} SELECT event_id, (cents * 120)::DOUBLE / nullif(first_value(cents) OVER (PARTITION BY user_id ORDER BY s, event_id), 0) AS cents FROM e""")
def tempo_override(spark, sf_dir):
    return ordered.rescale_to_first(events(spark, sf_dir), ["user_id"], ["s", "event_id"], "cents", F.lit(120)).select("event_id", "cents")


@query("""SELECT l_orderkey, l_quantity::BIGINT AS midi, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC)::INT AS voice FROM lineitem""")
def chord_voices(spark, sf_dir):
    chords = bars(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list("q").alias("chord"))
    return ordered.chord_voices(chords, "chord").select("l_orderkey", "midi", "voice")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey AS pk, l_suppkey AS sk, l_quantity::BIGINT AS q, l_linestatus = 'F' AS up FROM lineitem)
    SELECT l_orderkey, round_even(q / 3.0::DOUBLE, 0)::INT AS place, coalesce(string_agg(q::VARCHAR, '' ORDER BY l_linenumber, pk, sk, q) FILTER (WHERE up), '') AS above,
        coalesce(string_agg(q::VARCHAR, '' ORDER BY l_linenumber, pk, sk, q) FILTER (WHERE NOT up), '') AS below FROM r GROUP BY ALL""")
def stacked_numbers(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), "l_linestatus")
    rows = rows.withColumn("digits", F.col("q").cast("string"))
    return ordered.stacked_numbers(rows, ["l_orderkey"], LINE, "q", "digits", F.col("l_linestatus") == "F", 3.0)


@query(f"""{EVENTS}, l AS (SELECT user_id, list(cents ORDER BY s, event_id) AS xs FROM e GROUP BY user_id)
    SELECT user_id, array_to_string(CASE WHEN len(xs) <= 20 THEN xs ELSE list_transform(range(20), lambda i: xs[(i * len(xs)) // 20 + 1]) END, ',') AS picks FROM l""")
def even_picks(spark, sf_dir):
    e = events(spark, sf_dir).groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "event_id", "cents"))), lambda r: r["cents"]).alias("xs"))
    return e.select("user_id", F.array_join(scalars.even_picks(F.col("xs"), 20).cast("array<string>"), ",").alias("picks"))


@query("""WITH o AS (SELECT o_custkey, o_orderkey, (epoch_us(o_orderdate) // 86400000000)::BIGINT AS d FROM orders),
    p AS (SELECT o_custkey, o_orderkey, d, unnest(range(d // 28, (d + 44) // 28 + 1)) AS bar FROM o)
    SELECT o_orderkey, greatest(d, bar * 28)::BIGINT AS start, least(d + 45, bar * 28 + 28)::BIGINT AS stop, d >= bar * 28 AS first FROM p""")
def split_at_bars(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.unix_date(F.col("o_orderdate").cast("date")).cast("long").alias("d"))
    notes = o.select("o_custkey", "o_orderkey", F.col("d").alias("l_start"), (F.col("d") + 45).alias("l_end"))
    crossed = F.explode(F.sequence(F.floor(F.col("d") / 28), F.floor((F.col("d") + 44) / 28)))
    bars = o.select("o_custkey", crossed.alias("bar")).distinct().select("o_custkey", (F.col("bar") * 28).alias("r_start"), (F.col("bar") * 28 + 28).alias("r_end"))
    return structure.split_at_bars(notes, bars, ["o_custkey"], 56.0).select("o_orderkey", "start", "stop", "first")


VOICES = """r AS (SELECT l_orderkey AS o, l_suppkey % 20 AS s, l_suppkey % 20 + l_quantity::BIGINT % 7 + 1 AS e, l_quantity::BIGINT AS q,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 20, l_linenumber, l_partkey, l_suppkey, l_quantity) AS k FROM lineitem)"""


def voices(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"))
    return rows.withColumn("s", F.col("l_suppkey") % 20).withColumn("e", F.col("s") + F.col("q") % 7 + 1)


@query(f"""WITH RECURSIVE {VOICES},
    w AS (SELECT DISTINCT o, 0::BIGINT AS k, 0::BIGINT AS s, 0::BIGINT AS before, 0::BIGINT AS cur, false AS kept FROM r
        UNION ALL SELECT r.o, r.k, r.s, w.cur, CASE WHEN r.s >= w.cur THEN r.e ELSE w.cur END, r.s >= w.cur FROM w JOIN r ON r.o = w.o AND r.k = w.k + 1),
    l AS (SELECT o, max(cur) AS cur FROM w GROUP BY o)
    SELECT o AS l_orderkey, s AS start, cur AS stop, false AS is_rest FROM w WHERE kept
    UNION ALL SELECT o, before, s, true FROM w WHERE kept AND before < s
    UNION ALL SELECT o, cur, 32, true FROM l WHERE cur < 32""")
def fill_rests(spark, sf_dir):
    return structure.fill_rests(voices(spark, sf_dir), ["l_orderkey"], ["s", "l_linenumber", "l_partkey", "l_suppkey", "q"], "s", "e", F.lit(32).cast("long"))


@query(f"""WITH RECURSIVE {VOICES},
    w AS (SELECT DISTINCT o, 0::BIGINT AS k, []::BIGINT[] AS xs FROM r
        UNION ALL SELECT r.o, r.k, CASE WHEN len(list_filter(w.xs, lambda x: abs(x - r.q) < 6)) = 0 THEN list_append(w.xs, r.q) ELSE w.xs END FROM w JOIN r ON r.o = w.o AND r.k = w.k + 1),
    l AS (SELECT o, arg_max(xs, k) AS xs FROM w GROUP BY o)
    SELECT o AS l_orderkey, unnest(xs) AS q FROM l""")
def keep_apart(spark, sf_dir):
    return structure.keep_apart(voices(spark, sf_dir), ["l_orderkey"], ["s", "l_linenumber", "l_partkey", "l_suppkey", "q"], "q", 6)


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity::BIGINT - 20) + CASE WHEN l_linestatus = 'F' THEN 4 ELSE 0 END AS score, l_linestatus = 'F' AS above FROM lineitem),
    k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY score, l_linenumber, above, l_partkey) AS i FROM c WHERE score < 15)
    SELECT l_orderkey, score, l_linenumber, above, l_partkey FROM k WHERE i = 1""")
def best_scoring(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("dx", F.abs(F.col("l_quantity").cast("long") - 20))
    sides = [rows.where(f"l_linestatus {'=' if above else '<>'} 'F'").select("l_orderkey", "l_linenumber", (F.col("dx") + (4 if above else 0)).alias("score"), F.lit(above).alias("above"), "l_partkey") for above in (False, True)]
    return structure.best_scoring(sides, ["l_orderkey"], "score", "l_linenumber", F.col("score") < 15)


@query("""WITH v AS (SELECT l_suppkey, l_orderkey, l_linenumber, sum(l_quantity::BIGINT % 3 + 1)::BIGINT AS n FROM lineitem GROUP BY ALL),
    m AS (SELECT l_suppkey, l_orderkey, n, count(*) AS c, min(l_linenumber) AS v FROM v GROUP BY ALL),
    b AS (SELECT l_suppkey, l_orderkey, max(n) AS most, first(n ORDER BY c DESC, v) AS mode FROM m GROUP BY ALL)
    SELECT l_suppkey, l_orderkey, CASE WHEN mode = 2 AND l_orderkey <> min(l_orderkey) OVER (PARTITION BY l_suppkey) THEN 2 ELSE most END AS length FROM b""")
def bar_lengths(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") % 3 + 1).alias("dur"))
    return structure.bar_lengths(rows, ["l_suppkey"], "l_orderkey", "l_linenumber", "dur", F.lit(2).cast("long"))


@query("""WITH n AS (SELECT o_orderkey, (o_orderkey % 100)::DOUBLE AS s, (o_custkey % 7 + 1)::DOUBLE AS d, (o_custkey % 4)::INT AS w FROM orders)
    SELECT o_orderkey, part::INT AS part, s + d * part / greatest(w, 1) AS start, d / greatest(w, 1) AS dur FROM (SELECT *, unnest(range(greatest(w, 1))) AS part FROM n)""")
def share_evenly(spark, sf_dir):
    notes = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 100).cast("double").alias("start"), (F.col("o_custkey") % 7 + 1).cast("double").alias("dur"), (F.col("o_custkey") % 4).alias("w"))
    return structure.share_evenly(notes, "start", "dur", F.col("w")).drop("w")


@query(f"""{EVENTS}, n AS (SELECT *, CASE WHEN s - lag(s) OVER w > {GAP} THEN 1 ELSE 0 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY s, event_id)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY s, event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM n)
    SELECT user_id, island, max(s) AS s, bool_or(cents > 9000) AS thick, bool_or(event_type = 'purchase') AS closes FROM i GROUP BY user_id, island""")
def cluster_extents(spark, sf_dir):
    return structure.cluster_extents(events(spark, sf_dir), ["user_id"], ["s", "event_id"], "s", GAP, thick=F.col("cents") > 9000, closes=F.col("event_type") == "purchase")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT AS q, (l_suppkey % 10)::DOUBLE AS onset, (l_partkey % 10)::DOUBLE AS coda, l_quantity * 0.5::DOUBLE AS budget FROM lineitem),
    n AS (SELECT *, coda + coalesce(lead(onset) OVER w, 0) AS need FROM r WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q)),
    s AS (SELECT *, CASE WHEN need > budget THEN budget / need ELSE 1.0::DOUBLE END AS scale FROM n)
    SELECT l_orderkey, l_linenumber, q, onset * coalesce(lag(scale) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, q), 1) AS onset, coda * scale AS coda FROM s""")
def share_budget(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), (F.col("l_suppkey") % 10).cast("double").alias("onset"), (F.col("l_partkey") % 10).cast("double").alias("coda"))
    return structure.share_budget(rows, ["l_orderkey"], LINE, "onset", "coda", F.col("q") * 0.5).select("l_orderkey", "l_linenumber", "q", "onset", "coda")


@query(f"""{EVENTS}, m AS (SELECT n.user_id, n.event_id, n.cents AS target, count(*) AS n, median(f.cents::DOUBLE) AS mid FROM e n JOIN e f
        ON f.user_id = n.user_id AND f.cents > 0 AND f.s >= n.s + 0.3::DOUBLE * 1000000 AND f.s < n.s + 0.7::DOUBLE * 1000000 WHERE n.cents > 0 GROUP BY ALL HAVING count(*) >= 3)
    SELECT user_id, event_id, n, round(1200 * log2(mid / target), 6) AS cents FROM m""")
def pitch_errors(spark, sf_dir):
    e = events(spark, sf_dir).where("cents > 0")
    notes = e.select("user_id", "event_id", F.col("cents").alias("target"), F.col("s").alias("start"), F.lit(1000000).alias("dur"))
    found = structure.pitch_errors(notes, e.select("user_id", F.col("s").alias("t"), F.col("cents").cast("double").alias("hz")), ["user_id"], "event_id", "target", 400000.0)
    return found.withColumn("cents", F.round("cents", 6))


from . import queries_pages, queries_scalars, queries_singing  # noqa: E402, F401 (they add their queries to the tables above)
