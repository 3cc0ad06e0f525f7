"""Registered queries of the curation and evaluation operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions import geometry, motion, text
from ridgeline.operators import aggregate, clean, curate, evaluate, match, order_stats, plans, replicates, select, targets, weights
from ridgeline.operators import prose as prose_module
from ridgeline.plans.views import FRAMES_SQL, OBJECTS_SQL, SERIES_SQL, frames, objects, series, table
from ridgeline.sources import sinks

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


SLOW, LEAST_RUN = 1.0, 3
_KIND = "CASE WHEN intent <> 'GO_STRAIGHT' THEN 'turn' WHEN speed >= 0.5 THEN 'object' ELSE 'empty' END"
_STRIDES = {"turn": 1, "object": 2, "empty": 12}

RUNS_SQL = (
    FRAMES_SQL
    + """, a AS (SELECT *, speed >= 1.0 AS ok, lag(speed >= 1.0) OVER w AS pok, lag(intent) OVER w AS pi FROM frames WINDOW w AS (PARTITION BY scene_id ORDER BY frame_no)),
b AS (SELECT *, sum(CASE WHEN ok AND NOT (coalesce(pok, false) AND pi = intent) THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY frame_no) AS run FROM a),
c AS (SELECT *, sum(ok::INT) OVER (PARTITION BY scene_id, run) AS n FROM b),
r AS (SELECT *, CASE WHEN ok AND n >= 3 THEN run END AS run_id, CASE WHEN ok AND n >= 3 THEN n END AS run_len, CASE WHEN ok AND n >= 3 THEN intent END AS stable FROM c),
d AS (SELECT *, CASE WHEN NOT ok THEN coalesce(
    first_value(stable IGNORE NULLS) OVER (PARTITION BY scene_id ORDER BY frame_no ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
    last_value(stable IGNORE NULLS) OVER (PARTITION BY scene_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), intent) ELSE intent END AS intent_corrected FROM r)"""
)


def _deflickered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean.deflicker(frames(spark, sf_dir), "scene_id", "frame_no", "intent", F.col("speed") < SLOW, LEAST_RUN)


FLAGSHIP_SQL = (
    "WITH "
    + RUNS_SQL
    + """, k AS (SELECT scene_id, frame_no, intent_corrected, CASE WHEN intent_corrected <> 'GO_STRAIGHT' THEN 'turn' WHEN speed >= 0.5 THEN 'object' ELSE 'empty' END AS kind FROM d),
s AS (SELECT *, row_number() OVER (PARTITION BY scene_id, kind ORDER BY frame_no) AS n FROM k),
t AS (SELECT * FROM s WHERE (n - 1) % (CASE kind WHEN 'turn' THEN 1 WHEN 'object' THEN 2 ELSE 12 END) = 0)
SELECT 'intent' AS field, intent_corrected AS value, count(*) AS n FROM t GROUP BY 2 UNION ALL SELECT 'kind', kind, count(*) FROM t GROUP BY 2"""
)


@query(FLAGSHIP_SQL)
def flagship_curation(spark, sf_dir):
    rows = _deflickered(spark, sf_dir).withColumn("intent", F.col("intent_corrected"))
    kept = select.stride_select(rows.withColumn("kind", F.expr(_KIND)), "scene_id", "frame_no", F.col("kind"), _STRIDES)
    return aggregate.marginals(kept, "intent", "kind").orderBy("field", "value")


@query("WITH " + RUNS_SQL + " SELECT scene_id, frame_no, run_id, run_len FROM r")
def stable_runs(spark, sf_dir):
    return clean.runs(frames(spark, sf_dir), "scene_id", "frame_no", "intent", F.col("speed") >= SLOW, LEAST_RUN).select("scene_id", "frame_no", "run_id", "run_len")


@query("WITH " + RUNS_SQL + " SELECT scene_id, frame_no, intent, intent_corrected FROM d")
def deflicker(spark, sf_dir):
    return _deflickered(spark, sf_dir).select("scene_id", "frame_no", "intent", "intent_corrected")


@query("WITH " + RUNS_SQL + " SELECT intent || '->' || intent_corrected AS transition, count(*) AS n FROM d WHERE intent <> intent_corrected GROUP BY 1")
def deflicker_transitions(spark, sf_dir):
    return clean.transitions(_deflickered(spark, sf_dir), "intent", "intent_corrected")


@query("WITH " + RUNS_SQL + " SELECT count(*) AS frames, count(*) FILTER (intent <> intent_corrected) AS changed, count(*) FILTER (intent <> intent_corrected) / count(*)::DOUBLE AS rate FROM d")
def deflicker_report(spark, sf_dir):
    return clean.deflicker_report(_deflickered(spark, sf_dir), "intent", "intent_corrected")


@query(
    "WITH "
    + FRAMES_SQL
    + """, e AS (SELECT scene_id, frame_no, intent AS edit FROM frames WHERE event_type = 'signup')
SELECT f.scene_id, f.frame_no, coalesce(last_value(e.edit IGNORE NULLS) OVER (PARTITION BY f.scene_id ORDER BY f.frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), f.intent) AS intent
FROM frames f LEFT JOIN e ON e.scene_id = f.scene_id AND e.frame_no = f.frame_no"""
)
def propagate_edits(spark, sf_dir):
    f = frames(spark, sf_dir)
    edits = f.where("event_type = 'signup'").select("scene_id", "frame_no", "intent")
    return clean.propagate_edits(f, edits, "scene_id", "frame_no", ["intent"]).select("scene_id", "frame_no", "intent")


@query(
    "WITH "
    + FRAMES_SQL
    + """, k AS (SELECT *, CASE WHEN intent <> 'GO_STRAIGHT' THEN 'turn' WHEN speed >= 0.5 THEN 'object' ELSE 'empty' END AS kind FROM frames),
s AS (SELECT *, row_number() OVER (PARTITION BY scene_id, kind ORDER BY frame_no) AS n FROM k)
SELECT scene_id, frame_no, kind FROM s WHERE (n - 1) % (CASE kind WHEN 'turn' THEN 1 WHEN 'object' THEN 2 ELSE 12 END) = 0"""
)
def stride_selection(spark, sf_dir):
    return select.stride_select(frames(spark, sf_dir).withColumn("kind", F.expr(_KIND)), "scene_id", "frame_no", F.col("kind"), _STRIDES).select("scene_id", "frame_no", "kind")


@query(
    """WITH p AS (SELECT o_orderkey, o_orderstatus = 'F' AS pos FROM orders), n AS (SELECT floor(0.35::DOUBLE / (1::DOUBLE - 0.35::DOUBLE) * count(*) FILTER (pos)) AS most FROM p),
r AS (SELECT o_orderkey, row_number() OVER (ORDER BY md5(concat('7|', o_orderkey)), o_orderkey) AS k FROM p WHERE NOT pos)
SELECT o_orderkey, 'positive' AS side FROM p WHERE pos UNION ALL SELECT o_orderkey, 'negative' FROM r, n WHERE k <= most"""
)
def capped_negatives(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    kept = select.cap_ratio(o, F.col("o_orderstatus") != "F", 0.35, 7, "o_orderkey")
    return kept.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "positive").otherwise("negative").alias("side"))


@query("SELECT p_partkey FROM part ORDER BY md5(concat('3|', p_partkey)), p_partkey LIMIT 50")
def seeded_sample(spark, sf_dir):
    return select.sample_n(table(spark, sf_dir, "part").select("p_partkey"), 50, 3, "p_partkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def excluded_scenes(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return select.exclude(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ids, "o_custkey")


QUOTA_SQL = """s AS (SELECT c_mktsegment AS stratum, count(*) AS size FROM customer GROUP BY 1), t AS (SELECT sum(size) AS total FROM s),
e AS (SELECT stratum, size, size * 40 / total::DOUBLE AS x FROM s, t), b AS (SELECT *, floor(x)::BIGINT AS base, round(x - floor(x), 9) AS rest FROM e),
k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, size DESC, stratum) AS r FROM b),
q AS (SELECT stratum, size, base + CASE WHEN r <= 40 - (SELECT sum(base) FROM b) THEN 1 ELSE 0 END AS quota FROM k)"""


def _segments(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("stratum"))
    return c, select.quota(c.groupBy("stratum").agg(F.count("*").alias("size")), "stratum", "size", 40)


@query("WITH " + QUOTA_SQL + " SELECT stratum, size, quota FROM q")
def stratum_quota(spark, sf_dir):
    return _segments(spark, sf_dir)[1]


@query("WITH " + QUOTA_SQL + ", d AS (SELECT c_custkey, c_mktsegment AS stratum, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5(concat('5|', c_custkey)), c_custkey) AS n FROM customer) SELECT c_custkey, stratum FROM d JOIN q USING (stratum) WHERE n <= quota")
def stratified_draw(spark, sf_dir):
    c, q = _segments(spark, sf_dir)
    return select.stratified_draw(c, q, "stratum", 5, "c_custkey").select("c_custkey", "stratum")


@query()
def split_repair(spark, sf_dir):
    pool = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    found = select.select_scenes(pool, "p_partkey", "p_brand", 20, {"p_size": 900.0, "p_retailprice": 30000.0}, seed=1)
    return select.shortfall(found, {"p_size": 900.0, "p_retailprice": 30000.0})


@query("WITH f AS (SELECT o_custkey, min(o_orderkey) AS m FROM orders GROUP BY 1), r AS (SELECT o_custkey, row_number() OVER (ORDER BY m, o_custkey) AS ordinal FROM f) SELECT o_custkey, ordinal, ((ordinal - 1) // 100 + 1)::BIGINT AS batch FROM r")
def appearance_batches(spark, sf_dir):
    return select.group_by_appearance(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey").select("o_custkey", "ordinal", "batch").distinct()


_MOTION_SQL = (
    "WITH "
    + SERIES_SQL
    + """, m AS (SELECT *, (future[17] + future[18] + future[19] + future[20]) / 4 AS v_end, list_max(future) AS v_max, greatest(1.0, 0.2 * v0) AS b, CASE WHEN len(past) >= 5 THEN past[len(past) - 4] ELSE past[1] END AS v1 FROM series)"""
)


@query(
    _MOTION_SQL
    + """ SELECT scene_id, frame_no, CASE WHEN v0 < 0.5 AND v_max < 0.5 THEN 'stay' WHEN v0 < 0.5 AND v_max >= 1.0 THEN 'start' WHEN v0 >= 0.5 AND v_end < 0.5 THEN 'stop' WHEN v_end < v0 - b THEN 'decel' WHEN v_end > v0 + b THEN 'accel' ELSE 'keep' END AS sample_class,
CASE WHEN v_end < 0.5 THEN 'stop' WHEN (v0 < 0.5 AND v_max >= 1.0) OR v_end - v0 > b THEN 'accelerate' WHEN v0 - v_end > b THEN 'decelerate' ELSE 'keep' END AS lon_class,
CASE WHEN v0 < 0.5 THEN 'stopped' WHEN v0 - v1 > 0.6 THEN 'accelerating' WHEN v0 - v1 < -0.6 THEN 'decelerating' ELSE 'cruising' END AS ego_class,
CASE WHEN v0 < 0.5 THEN 'v0<0.5' WHEN v0 < 3 THEN '0.5<=v0<3' WHEN v0 < 8 THEN '3<=v0<8' ELSE 'v0>=8' END AS bucket FROM m"""
)
def motion_classes(spark, sf_dir):
    s = series(spark, sf_dir)
    v0, v_end, v_max = F.col("v0"), motion.end_speed(F.col("future")), F.array_max("future")
    return s.select("scene_id", "frame_no", motion.sample_class(v0, v_end, v_max).alias("sample_class"), motion.lon_class(v0, v_end, v_max).alias("lon_class"), motion.ego_class(v0, motion.back_in_array(F.col("past"), 4)).alias("ego_class"), motion.speed_bucket(v0).alias("bucket"))


@query(
    _MOTION_SQL
    + """ SELECT scene_id, frame_no, round(v_end, 6) AS v_end, (list_position(list_transform(future, lambda x: x >= 0.5), true) * 0.25)::DOUBLE AS start_t,
CASE WHEN list_position(list_transform(list_reverse(past), lambda x: x < 0.5), false) IS NULL THEN len(past) ELSE list_position(list_transform(list_reverse(past), lambda x: x < 0.5), false) - 1 END::BIGINT AS trailing FROM m"""
)
def speed_summaries(spark, sf_dir):
    s = series(spark, sf_dir)
    return s.select("scene_id", "frame_no", F.round(motion.end_speed(F.col("future")), 6).alias("v_end"), motion.start_time(F.col("future")).cast("double").alias("start_t"), motion.trailing_run(F.col("past")).cast("long").alias("trailing"))


@query(
    "WITH "
    + SERIES_SQL
    + """, p AS (SELECT scene_id, frame_no, v0, future, list_transform(range(1, 21), lambda i: list_sum(future[1:i]) * 0.25) AS truth FROM series),
q AS (SELECT *, list_transform(range(1, 21), lambda i: abs(v0 * i * 0.25 - truth[i])) AS err FROM p)
SELECT scene_id, frame_no, round(list_avg(err[1:4]), 9) AS ade1, round(list_avg(err[1:12]), 9) AS ade3, round(list_avg(err), 9) AS ade5, round(err[20], 9) AS fde, round(exp(-list_avg(err) / 2), 9) AS score FROM q"""
)
def displacement_errors(spark, sf_dir):
    s = series(spark, sf_dir)
    zero = F.lit(0.0)
    travelled = F.transform(motion.running_sums(F.col("future")), lambda d: F.struct((d * 0.25).alias("x"), zero.alias("y")))
    rows = s.withColumn("err", motion.displacement(motion.constant_velocity(F.col("v0"), zero), travelled))
    e = F.col("err")
    ade5 = motion.average_error(e, 20)
    return rows.select("scene_id", "frame_no", *[F.round(c, 9).alias(n) for n, c in (("ade1", motion.average_error(e, 4)), ("ade3", motion.average_error(e, 12)), ("ade5", ade5), ("fde", motion.final_error(e)), ("score", motion.trajectory_score(ade5)))])


@query("SELECT 'o_orderpriority' AS field, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2")
def marginals(spark, sf_dir):
    return aggregate.marginals(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query(
    """SELECT 'all' AS slice, NULL AS value, count(*) AS n, round(avg(o_totalprice), 4) AS mean FROM orders UNION ALL
SELECT 'o_orderpriority', o_orderpriority, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*), round(avg(o_totalprice), 4) FROM orders GROUP BY 2"""
)
def metrics_by_slice(spark, sf_dir):
    return aggregate.by_slice(table(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus"], F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 4).alias("mean"))


@query("SELECT least(n, 8) AS bucket, count(*) AS n FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) GROUP BY 1")
def capped_histogram(spark, sf_dir):
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("k"))
    return aggregate.capped_histogram(n.withColumnRenamed("k", "count"), "count", 8)


@query("SELECT l_returnflag AS class, l_linestatus AS state, count(*) AS n FROM lineitem GROUP BY 1, 2")
def attribute_frequency(spark, sf_dir):
    return aggregate.frequency(objects(spark, sf_dir), "class", "state")


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def top_values(spark, sf_dir):
    return aggregate.top_k(table(spark, sf_dir, "part"), "p_brand", 10)


@query("WITH r AS (SELECT p_brand, p_type, p_partkey, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS n FROM part) SELECT p_brand, p_type, p_partkey FROM r WHERE n = 1 ORDER BY p_partkey LIMIT 60")
def first_examples(spark, sf_dir):
    return aggregate.examples(table(spark, sf_dir, "part").select("p_brand", "p_type", "p_partkey"), "p_partkey", 60, "p_brand", "p_type")


@query(
    "WITH n AS (SELECT o_custkey, o_orderpriority, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS k FROM n) SELECT o_custkey, o_orderpriority, n FROM r WHERE k = 1"
)
def majority_value(spark, sf_dir):
    return aggregate.majority(table(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", "o_orderkey")


_CONF = "c AS (SELECT quality::VARCHAR AS truth, toxic::VARCHAR AS found, count(*) AS n FROM labels GROUP BY 1, 2)"


@query("WITH " + _CONF + " SELECT truth, found, n FROM c")
def confusion(spark, sf_dir):
    return aggregate.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")


_REPORT = (
    _CONF
    + """, t AS (SELECT truth AS label, sum(n)::BIGINT AS support, coalesce(sum(n) FILTER (truth = found), 0)::BIGINT AS tp FROM c GROUP BY 1), p AS (SELECT found AS label, sum(n)::BIGINT AS found FROM c GROUP BY 1),
r AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(found, 0) AS found, coalesce(tp, 0) AS tp FROM t FULL JOIN p ON p.label = t.label)"""
)


@query("WITH " + _REPORT + " SELECT label, support, found, tp, tp / nullif(support, 0)::DOUBLE AS recall, tp / nullif(found, 0)::DOUBLE AS precision FROM r")
def class_report(spark, sf_dir):
    return aggregate.class_report(aggregate.confusion(table(spark, sf_dir, "labels"), "quality", "toxic"))


@query("WITH " + _REPORT + " SELECT avg(tp / support::DOUBLE) FILTER (support >= 10) AS macro_recall, sum(tp) / sum(support)::DOUBLE AS accuracy, (SELECT label FROM r ORDER BY support DESC, label DESC LIMIT 1) AS majority_class, max(support) / sum(support)::DOUBLE AS majority_share FROM r")
def macro_recall(spark, sf_dir):
    return aggregate.macro_recall(aggregate.class_report(aggregate.confusion(table(spark, sf_dir, "labels"), "quality", "toxic")))


@query("SELECT o_orderpriority, round(p[1], 4) AS p10, round(p[2], 4) AS p50, round(p[3], 4) AS p99 FROM (SELECT o_orderpriority, quantile_cont(o_totalprice, [0.1, 0.5, 0.99]) AS p FROM orders GROUP BY 1)")
def percentiles(spark, sf_dir):
    rows = order_stats.quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", [0.1, 0.5, 0.99])
    return rows.select("o_orderpriority", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p10", "p50", "p99"))])


@query("SELECT l_returnflag, count(*) AS n, round(p[1], 4) AS p01, round(p[2], 4) AS p50, round(p[3], 4) AS p999 FROM (SELECT l_returnflag, l_extendedprice, quantile_cont(l_extendedprice, [0.01, 0.5, 0.999]) OVER (PARTITION BY l_returnflag) AS p FROM lineitem) GROUP BY ALL")
def narrowed_percentiles(spark, sf_dir):
    """Every group is larger than what may meet in a task, so each rank is narrowed down."""
    rows = order_stats.quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.01, 0.5, 0.999], few=100)
    return rows.select("l_returnflag", "n", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("p01", "p50", "p999"))])


@query("WITH c AS (SELECT o_orderpriority AS c, avg(o_totalprice) AS m, count(*) AS n, sum(o_totalprice) AS s FROM orders GROUP BY 1) SELECT round(avg(m), 4) AS cluster_mean, round(sum(s) / sum(n), 4) AS row_mean, count(*) AS clusters FROM c")
def cluster_leaderboard(spark, sf_dir):
    found = aggregate.leaderboard(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return found.select(F.round("cluster_mean", 4).alias("cluster_mean"), F.round("row_mean", 4).alias("row_mean"), "clusters")


@query("""WITH m AS (SELECT 'price' AS metric, avg(o_totalprice) AS value FROM orders UNION ALL SELECT 'orders', count(*)::DOUBLE FROM orders), g(metric, op, threshold) AS (VALUES ('price', '>=', 1000.0), ('orders', '<=', 10.0), ('absent', '>=', 0.5))
SELECT g.metric, round(value, 4) AS value, op, threshold::DOUBLE AS threshold, CASE op WHEN '>=' THEN value >= threshold ELSE value <= threshold END AS passed FROM g LEFT JOIN m ON m.metric = g.metric""")
def acceptance_gates(spark, sf_dir):
    o = table(spark, sf_dir, "orders").agg(F.avg("o_totalprice").alias("price"), F.count("*").cast("double").alias("orders"))
    long = o.select(F.explode(F.create_map(F.lit("price"), "price", F.lit("orders"), "orders")).alias("metric", "value"))
    limits = spark.createDataFrame([("price", ">=", 1000.0), ("orders", "<=", 10.0), ("absent", ">=", 0.5)], "metric string, op string, threshold double")
    return aggregate.gates(long, limits).withColumn("value", F.round("value", 4))


@query(
    """WITH p AS (SELECT o_custkey AS k, avg(o_totalprice) FILTER (o_orderstatus = 'F') - avg(o_totalprice) FILTER (o_orderstatus <> 'F') AS d FROM orders GROUP BY 1), v AS (SELECT *, ('0x' || substr(md5('3|' || k), 1, 15))::UBIGINT AS h FROM p WHERE d IS NOT NULL),
a AS (SELECT r, d, ((h::UHUGEINT + (r + 1)::UHUGEINT * 11400714819323198485::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM v, range(2000) t(r)),
b AS (SELECT r, d, ((xor(z, z >> 30)::UHUGEINT * 13787848793156543929::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM a),
c AS (SELECT r, d, ((xor(z, z >> 27)::UHUGEINT * 10723151780598845931::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS z FROM b), w AS (SELECT r, d, xor(z, z >> 31) >> 32 AS u FROM c),
x AS (SELECT r, d, (u >= 1580030169)::INT + (u >= 3160060337)::INT + (u >= 3950075422)::INT + (u >= 4213413783)::INT + (u >= 4279248374)::INT + (u >= 4292415292)::INT + (u >= 4294609778)::INT AS n FROM w), m AS (SELECT r, sum(n * d) / sum(n) AS m FROM x GROUP BY 1)
SELECT (SELECT round(avg(d), 4) FROM v) AS mean_diff, (SELECT count(*) FROM v) AS n, round(quantile_cont(m, 0.025), 4) AS low, round(quantile_cont(m, 0.975), 4) AS high, round(avg((m > 0)::INT), 9) AS share_above FROM m"""
)
def paired_bootstrap(spark, sf_dir):
    o, side = table(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F"
    pairs = o.groupBy("o_custkey").agg(F.avg(F.when(side, F.col("o_totalprice"))).alias("a"), F.avg(F.when(~side, F.col("o_totalprice"))).alias("b"))
    found = replicates.paired_bootstrap(pairs, "o_custkey", "a", "b", 2000, 3)
    return found.select(F.round("mean_diff", 4).alias("mean_diff"), "n", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"), F.round("share_above", 9).alias("share_above"))


@query("SELECT lang, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM documents), 6) AS percent FROM documents GROUP BY 1")
def value_distribution(spark, sf_dir):
    return aggregate.distribution(table(spark, sf_dir, "documents"), "lang").withColumn("percent", F.round("percent", 6))


@query("WITH a AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber > 3 GROUP BY 1, 2), b AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2) SELECT a.l_suppkey, a.l_returnflag, a.n - coalesce(b.n, 0) AS n FROM a LEFT JOIN b USING (l_suppkey, l_returnflag) WHERE a.n > coalesce(b.n, 0)")
def bag_difference(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return aggregate.bag_except(li.where("l_linenumber > 3"), li.where("l_linenumber <= 3"), "l_suppkey", "l_returnflag")


@query("WITH s AS (SELECT l_orderkey, list(DISTINCT l_returnflag) FILTER (l_linenumber <= 3) AS t, list(DISTINCT l_returnflag) FILTER (l_linenumber > 3) AS f FROM lineitem GROUP BY 1), c AS (SELECT len(list_intersect(coalesce(t, []), coalesce(f, []))) AS tp, len(coalesce(f, [])) AS nf, len(coalesce(t, [])) AS nt FROM s), u AS (SELECT sum(tp)::BIGINT AS tp, sum(nf - tp)::BIGINT AS fp, sum(nt - tp)::BIGINT AS fn FROM c) SELECT tp, fp, fn, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, round(2 * (tp / (tp + fp)::DOUBLE) * (tp / (tp + fn)::DOUBLE) / (tp / (tp + fp)::DOUBLE + tp / (tp + fn)::DOUBLE), 9) AS f1 FROM u")
def set_f1(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    sides = li.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_linenumber") <= 3, F.col("l_returnflag"))).alias("t"), F.collect_set(F.when(F.col("l_linenumber") > 3, F.col("l_returnflag"))).alias("f"))
    return aggregate.set_f1(sides, "t", "f").withColumn("f1", F.round("f1", 9))


@query("SELECT p_partkey, round(1.0 / n, 12) AS weight FROM part JOIN (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) USING (p_brand)")
def inverse_frequency(spark, sf_dir):
    return weights.inverse_frequency(table(spark, sf_dir, "part"), "p_brand", "weight").select("p_partkey", F.round("weight", 12).alias("weight"))


@query(
    """WITH a AS (SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1), b AS (SELECT o_orderstatus, count(*) AS m FROM orders GROUP BY 1)
SELECT o_orderkey, round(least(5.0, greatest(1.0, greatest(pow((SELECT max(n) FROM a) / n::DOUBLE, 0.3), pow((SELECT max(m) FROM b) / m::DOUBLE, 0.3)) * CASE WHEN o_totalprice > 200000 THEN 2.0 ELSE 1.0 END)), 9) AS weight
FROM orders JOIN a USING (o_orderpriority) JOIN b USING (o_orderstatus)"""
)
def context_weight(spark, sf_dir):
    o = weights.context_weight(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus", F.col("o_totalprice") > 200000, "weight")
    return o.select("o_orderkey", F.round("weight", 9).alias("weight"))


@query(
    """WITH w AS (SELECT p_partkey, p_size, p_size::DOUBLE / avg(p_size) OVER () AS a, p_retailprice / avg(p_retailprice) OVER () AS b FROM part), x AS (SELECT *, a * b AS c FROM w), y AS (SELECT *, least(c / avg(c) OVER (), 8.0) * CASE WHEN p_size > 40 THEN 2.0 ELSE 1.0 END AS d FROM x)
SELECT p_partkey, round(d / avg(d) OVER (), 6) AS weight FROM y"""
)
def combined_weight(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    found = weights.combined_weight(p, "a", "b", F.when(F.col("p_size") > 40, 2.0).otherwise(1.0), F.lit(1.0), "weight")
    return found.select("p_partkey", F.round("weight", 6).alias("weight"))


@query("SELECT 'p_brand' AS field, p_brand AS value, round(sum(p_size) / (SELECT sum(p_size) FROM part)::DOUBLE, 9) AS share FROM part GROUP BY 2 UNION ALL SELECT 'p_type', p_type, round(sum(p_size) / (SELECT sum(p_size) FROM part)::DOUBLE, 9) FROM part GROUP BY 2")
def weighted_marginals(spark, sf_dir):
    return weights.weighted_marginals(table(spark, sf_dir, "part"), "p_size", "p_brand", "p_type").withColumn("share", F.round("share", 9))


@query("WITH f AS (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) SELECT p_brand, n, round(least(3.0, greatest(0.5, sqrt((SELECT quantile_cont(n, 0.5) FROM f) / n))), 9) AS factor FROM f")
def balance_factor(spark, sf_dir):
    f = aggregate.frequency(table(spark, sf_dir, "part"), "p_brand")
    return weights.balance_factor(f, "p_brand", "n", "factor").withColumn("factor", F.round("factor", 9))


@query("""WITH p AS (SELECT p_partkey, p_size::DOUBLE AS w, substr(md5(p_partkey::VARCHAR), 1, 3) AS b FROM part WHERE p_size > 0),
s AS (SELECT p_partkey, sum(w) OVER (ORDER BY b, p_partkey) - w AS lo, sum(w) OVER (ORDER BY b, p_partkey) AS hi FROM p),
d AS (SELECT i AS draw, (('0x' || substr(md5('11|' || i), 1, 13))::UBIGINT / 4503599627370496.0) * (SELECT sum(w) FROM p) AS u FROM range(500) t(i)) SELECT draw, p_partkey FROM d JOIN s ON u >= lo AND u < hi""")
def weighted_draw(spark, sf_dir):
    return weights.weighted_draw(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("w")), "p_partkey", "w", 500, 11)


@query("WITH " + OBJECTS_SQL + " SELECT frame, g, row_number() OVER (PARTITION BY frame ORDER BY rank, g) AS place, rank AS written_rank FROM objects")
def ranked_objects(spark, sf_dir):
    return match.rank_objects(objects(spark, sf_dir), "frame", "rank", "g").select("frame", "g", "place", "written_rank")


_BOXES = (
    OBJECTS_SQL
    + """, t AS (SELECT * FROM objects WHERE g <= 3), m AS (SELECT * FROM objects WHERE g > 3),
p AS (SELECT t.frame, t.g, m.g AS mg, abs(t.x - m.x) + abs(t.y - m.y) + abs(t.h - m.h) + abs(t.w - m.w) AS d FROM t LEFT JOIN m ON m.frame = t.frame)"""
)


@query("WITH " + _BOXES + ", r AS (SELECT *, row_number() OVER (PARTITION BY frame, g ORDER BY round(d, 6), mg) AS k FROM p) SELECT frame, g, mg AS mask, round(d, 6) AS distance FROM r WHERE k = 1")
def nearest_boxes(spark, sf_dir):
    o = objects(spark, sf_dir)
    o = o.withColumns({c: F.round(c, 6) for c in "xywh"})
    found = match.match_boxes(o.where("g <= 3"), o.where("g > 3").withColumnRenamed("g", "mask"), "frame", "g", "mask")
    return found.withColumn("distance", F.round("distance", 6))


#: Candidate pairs of a frame; objects 1, 2 and 3 then take the nearest prediction that is still free.
_PAIRS = (
    OBJECTS_SQL
    + """, d AS (SELECT t.frame, t.g, p.g AS p, t.class, p.class AS pclass, sqrt(pow(greatest(t.x - p.x, 0, p.x - (t.x + t.w)), 2) + pow(greatest(t.y - p.y, 0, p.y - (t.y + t.h)), 2)) AS d,
  least(300.0, greatest(60.0, 1.5 * sqrt(t.w * t.w + t.h * t.h))) AS gate FROM objects t JOIN objects p ON p.frame = t.frame AND p.g > 3 WHERE t.g <= 3)"""
)


def _greedy_sql(where: str) -> str:
    """Objects 1, 2, 3 of a frame each take the nearest free prediction of those allowed."""
    one = "SELECT frame, g, p, d, row_number() OVER (PARTITION BY frame ORDER BY d, p) AS k FROM ok WHERE g = {g}{free}"
    parts = ["ok AS (SELECT * FROM d WHERE " + where + ")", "a1 AS (SELECT * FROM (" + one.format(g=1, free="") + ") WHERE k = 1)"]
    parts.append("a2 AS (SELECT * FROM (" + one.format(g=2, free=" AND NOT EXISTS (SELECT 1 FROM a1 WHERE a1.frame = ok.frame AND a1.p = ok.p)") + ") WHERE k = 1)")
    parts.append("a3 AS (SELECT * FROM (" + one.format(g=3, free=" AND NOT EXISTS (SELECT 1 FROM a1 WHERE a1.frame = ok.frame AND a1.p = ok.p) AND NOT EXISTS (SELECT 1 FROM a2 WHERE a2.frame = ok.frame AND a2.p = ok.p)") + ") WHERE k = 1)")
    return ", ".join(parts) + ", taken AS (SELECT frame, g, p, d FROM a1 UNION ALL SELECT frame, g, p, d FROM a2 UNION ALL SELECT frame, g, p, d FROM a3)"


def _sides(spark, sf_dir):
    o = objects(spark, sf_dir)
    found = o.where("g > 3").select("frame", F.col("g").alias("p"), F.col("class").alias("pclass"), F.col("x").alias("px"), F.col("y").alias("py"))
    return o.where("g <= 3"), found


@query("WITH " + _PAIRS + ", " + _greedy_sql("d <= gate") + " SELECT frame, g, p, round(d, 6) AS d FROM taken")
def object_assignment(spark, sf_dir):
    return match.assign_objects(*_sides(spark, sf_dir), "frame").withColumn("d", F.round("d", 6))


@query("WITH " + _PAIRS + ", " + _greedy_sql("class = pclass") + " SELECT frame, g, p, round(d, 6) AS d FROM taken")
def typed_assignment(spark, sf_dir):
    return match.assign_typed(*_sides(spark, sf_dir), "frame").withColumn("d", F.round("d", 6))


@query(" UNION ALL ".join("SELECT * FROM (WITH " + _PAIRS + ", " + _greedy_sql(f"d <= gate * {k}") + f" SELECT {k}::DOUBLE AS scale, (SELECT count(*) FROM objects WHERE g <= 3) AS objects, count(*) AS matched, round(count(*) / (SELECT count(*) FROM objects WHERE g <= 3)::DOUBLE, 9) AS recall FROM taken)" for k in (0.1, 0.5, 1.0)))
def assignment_sensitivity(spark, sf_dir):
    return match.assign_sensitivity(*_sides(spark, sf_dir), "frame", (0.1, 0.5, 1.0)).withColumn("recall", F.round("recall", 9))


@query(
    "WITH "
    + OBJECTS_SQL
    + """, t AS (SELECT frame, class, count(*) AS t FROM objects WHERE g <= 3 GROUP BY 1, 2), f AS (SELECT frame, class, count(*) AS f FROM objects WHERE g > 3 GROUP BY 1, 2),
b AS (SELECT coalesce(t.frame, f.frame) AS frame, coalesce(t.class, f.class) AS class, coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM t FULL JOIN f ON f.frame = t.frame AND f.class = t.class)
SELECT frame, class, least(t, f) AS tp, greatest(t - f, 0) AS missed, greatest(f - t, 0) AS extra FROM b"""
)
def multiset_match(spark, sf_dir):
    o = objects(spark, sf_dir)
    return match.match_multiset(o.where("g <= 3"), o.where("g > 3"), "frame", "class")


@query("SELECT doc, c, m FROM (SELECT user_id AS doc, event_id AS c, event_type, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_type <> 'signup', event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM events) WHERE event_type = 'click'")
def points_to_mentions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    e = e.select(F.col("user_id").alias("doc"), F.col("event_id"), "event_type", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.when(F.col("event_type") == "signup", F.col("event_id")).otherwise(0).alias("i")).alias("at"))
    mentions = e.where("event_type = 'signup'").select("doc", F.col("at").withField("i", F.lit(0).cast("long")).alias("at"), F.col("event_id").alias("m"))
    clicks = e.where("event_type = 'click'").select("doc", F.col("at").withField("i", F.lit(1).cast("long")).alias("at"), F.col("event_id").alias("c"))
    return match.attach_points(mentions, clicks, "doc")


@query("WITH " + OBJECTS_SQL + " SELECT frame, g, round(least(300.0, greatest(60.0, 1.5 * sqrt(w * w + h * h))), 6) AS assign_gate, round(least(60.0, greatest(15.0, 0.5 * sqrt(w * w + h * h))), 6) AS location_gate, round(sqrt(pow(greatest(x - 30, 0, 30 - (x + w)), 2) + pow(greatest(y - 5, 0, 5 - (y + h)), 2)), 6) AS distance FROM objects")
def gates_and_distances(spark, sf_dir):
    o = objects(spark, sf_dir)
    c = F.col
    return o.select("frame", "g", F.round(match.assign_gate(c("w"), c("h")), 6).alias("assign_gate"), F.round(match.location_gate(c("w"), c("h")), 6).alias("location_gate"), F.round(match.box_distance(F.lit(30.0), F.lit(5.0), c("x"), c("y"), c("w"), c("h")), 6).alias("distance"))


@query("WITH " + OBJECTS_SQL + ", k AS (SELECT *, (('0x' || substr(md5('5|' || frame || '|' || g), 1, 8))::UBIGINT + 0.5) / 4294967296.0 AS u FROM objects), r AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY -ln(u) / CASE WHEN class = 'R' THEN 3.0 ELSE 1.0 END, g, x, y, w, h) AS n FROM k) SELECT frame, g FROM r WHERE n = 1")
def object_choice(spark, sf_dir):
    return match.pick_object(objects(spark, sf_dir), "frame", "g", F.col("class") == "R", 5).select("frame", "g")


_ANSWER = """'<ego_state>lon=cruising ' || printf('%.1f', speed) || ' m/s | lat=LANE_KEEPING</ego_state><context>weather=Sunny; road=Merge</context><events>' || event_type || ', none2</events><has_objects>yes<n_objects>' || frame_no || '<obj type="Car"><point>(' || frame_no || ', 5)</point><rank>1</rank><location>front</location></obj><final_plan> keep lane </final_plan><motion>lon=' || intent || ' | lat=left turn</motion><traj>[' || frame_no || ', 0.5], [2, 0], [3, 0], [4, 0], [5, 0]</traj>'"""


@query("WITH " + FRAMES_SQL + " SELECT event_id, 'cruising' AS ego, event_type AS event, frame_no AS n_objects, 'Car' AS type, frame_no::DOUBLE AS px, 1 AS rank, 'keep lane' AS plan, 'left_turn' AS lat, frame_no::DOUBLE AS x1, 5 AS points FROM frames")
def parsed_answers(spark, sf_dir):
    f = frames(spark, sf_dir)
    head = F.format_string('<ego_state>lon=cruising %.1f m/s | lat=LANE_KEEPING</ego_state><context>weather=Sunny; road=Merge</context><events>%s, none2</events><has_objects>yes<n_objects>%d', "speed", "event_type", "frame_no")
    body = F.format_string('<obj type="Car"><point>(%d, 5)</point><rank>1</rank><location>front</location></obj><final_plan> keep lane </final_plan><motion>lon=%s | lat=left turn</motion><traj>[%d, 0.5], [2, 0], [3, 0], [4, 0], [5, 0]</traj>', "frame_no", "intent", "frame_no")
    a = f.select("event_id", text.parse_answer(F.concat(head, body)).alias("a"))
    one = F.col("a.objects")[0]
    return a.select("event_id", F.col("a.ego_state.lon_class").alias("ego"), F.col("a.events")[0].alias("event"), F.col("a.n_objects").alias("n_objects"), one["type"].alias("type"), one["point"]["x"].alias("px"), one["rank"].alias("rank"), F.col("a.final_plan").alias("plan"), F.col("a.motion.lat").alias("lat"), F.col("a.traj")[0]["x"].alias("x1"), F.col("a.traj_n_points").alias("points"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(lower(text), '[_\\n]', ' ', 'g'), '\\s+', ' ', 'g'), ' .') AS plan, substr(sha256(text), 1, 16) AS digest FROM documents")
def normal_plans(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.norm_plan(F.col("text")).alias("plan"), text.fingerprint(F.col("text")).alias("digest"))


@query(
    """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '')) AS w FROM benchmark),
p AS (SELECT a.item_id AS a, b.item_id AS b, len(list_intersect(a.w, b.w)) AS i, len(list_distinct(list_concat(a.w, b.w))) AS u FROM w a JOIN w b ON b.item_id = a.item_id + 1)
SELECT a, b, round(i / u::DOUBLE, 9) AS overlap FROM p"""
)
def word_overlap(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    pairs = b.select(F.col("item_id").alias("a"), F.col("text").alias("ta")).join(b.select(F.col("item_id").alias("b"), F.col("text").alias("tb")), F.col("b") == F.col("a") + 1)
    return pairs.select("a", "b", F.round(text.word_overlap(F.col("ta"), F.col("tb")), 9).alias("overlap"))


@query(r"""WITH c AS (SELECT role, text FROM conversations), t AS (SELECT DISTINCT text, length(text) AS n FROM c), p AS (SELECT text, n, unnest(range(1, greatest(n, 75) - 73)) AS i FROM t), q AS (SELECT text, i, unnest(range(25, least(200, (n - i + 1) // 3) + 1)) AS k FROM p WHERE n - i + 1 >= 75),
f AS (SELECT DISTINCT text FROM q WHERE substr(text, i, k) = substr(text, i + k, k) AND substr(text, i, k) = substr(text, i + 2 * k, k)) SELECT c.role, count(*) FILTER (f.text IS NOT NULL) AS degenerate, count(*) AS n FROM c LEFT JOIN f ON f.text = c.text GROUP BY 1""")
def degenerate_texts(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count_if(text.degenerate(F.col("text"))).alias("degenerate"), F.count("*").alias("n"))


@query("WITH a AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0) SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)")
def new_rows_only(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return sinks.new_rows(o, o.where("o_orderkey % 2 = 0"), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'patched' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def overlay_patch(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey"), F.concat(F.lit("p/"), "o_orderkey").alias("path"), F.col("o_orderkey").cast("string").alias("base"), "o_orderpriority")
    full = o.where("o_orderkey % 6 = 0").select(F.col("path").alias("key"), F.lit("patched").alias("o_orderpriority"))
    short = o.where("o_orderkey % 6 = 3").select(F.col("base").alias("key"), F.lit("patched").alias("o_orderpriority"))
    return sinks.apply_overlay(o, full.unionByName(short), "path", "base", ["o_orderpriority"]).select("o_orderkey", "o_orderpriority")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'moving' WHEN 'click' THEN 'slowing/stopped' WHEN 'purchase' THEN 'turning/merging' WHEN 'signup' THEN 'parked' ELSE 'other' END AS behaviour, CASE event_type WHEN 'view' THEN 'stop' WHEN 'click' THEN 'green' ELSE 'other' END AS content, CASE event_type WHEN 'view' THEN 'front left' ELSE 'front' END AS direction, CASE WHEN event_id % 3 = 0 THEN 'ego-lane' WHEN event_id % 3 = 1 THEN 'roadside' END AS lane FROM events")
def canonical_attributes(spark, sf_dir):
    e, t = table(spark, sf_dir, "events"), F.col("event_type")
    state = F.when(t == "view", "Driving  slowly").when(t == "click", "give way").when(t == "purchase", "U turn").when(t == "signup", "pull over and park").otherwise("??")
    sign = F.when(t == "view", "stop here on red").when(t == "click", "GREEN arrow").otherwise("none")
    third = F.col("event_id") % 3
    where = F.concat(F.when(t == "view", "on the left").otherwise("ahead"), F.when(third == 0, ", same lane").when(third == 1, ", at the curb").otherwise(""))
    return e.select("event_id", text.coarse_behaviour(text.behaviour(state)).alias("behaviour"), text.content(sign).alias("content"), text.location_slots(where)["direction"].alias("direction"), text.location_slots(where)["lane"].alias("lane"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'Urban Highway' WHEN 'click' THEN 'Unknown' WHEN 'purchase' THEN NULL ELSE 'Rural' END AS scenario, CASE WHEN event_type = 'click' THEN 'Fog' ELSE 'Fair' END AS weather, CASE event_type WHEN 'view' THEN ['Traffic jam'] WHEN 'click' THEN ['Roadside parking'] ELSE [] END AS types FROM events")
def cleaned_context(spark, sf_dir):
    t = F.col("event_type")
    names = lambda *x: F.array(F.array(*[F.lit(v) for v in x]))
    scenario = F.when(t == "view", "Urban, Highway").when(t == "click", "").when(t == "purchase", None).otherwise("Rural")
    weather = F.when(t == "click", "Fog").when(t == "view", "")
    events = F.when(t == "view", names("traffic jam", "none")).when(t == "click", names("left roadside parking", "Roadside parking")).otherwise(names("Airport"))
    ann = table(spark, sf_dir, "events").select("event_id", F.struct(weather.alias("weather"), scenario.alias("scenario")).alias("context"), events.alias("events"))
    done = clean.clean_context(ann)
    return done.select("event_id", "context.scenario", "context.weather", F.flatten("events").alias("types"))


#: sentence, class when moving, class when stopped
PLAN_SENTENCES = [
    ("Decelerate and stop.", "stop", "stop"),
    ("keep lane and cruise", "keep", "keep"),
    ("wait, then proceed", "stop", "stop"),
    ("proceed_through the intersection", "keep", "accelerate"),
    ("keep lane", "unspecified", "unspecified"),
    ("turn left and accelerate", "accelerate", "accelerate"),
    ("follow the stopped car", "keep", "keep"),
]
_PLANS_SQL = (
    "WITH "
    + FRAMES_SQL
    + ", k(i, plan, moving, still) AS (VALUES "
    + ", ".join(f"({i}, '{p}', '{m}', '{s}')" for i, (p, m, s) in enumerate(PLAN_SENTENCES))
    + "), p AS (SELECT event_id, speed, plan, CASE WHEN speed >= 0.5 THEN moving ELSE still END AS lon FROM frames JOIN k ON k.i = event_id % 7)"
)


def _plans(spark, sf_dir):
    names = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(PLAN_SENTENCES)], "i long, plan string")
    f = frames(spark, sf_dir).join(F.broadcast(names), F.col("event_id") % 7 == F.col("i"))
    return plans.classify_plans(f, "plan", "speed")


@query(_PLANS_SQL + " SELECT event_id, lon, CASE WHEN plan LIKE 'turn left%' THEN 'turn left' ELSE 'keep lane' END AS lateral FROM p")
def plan_classes(spark, sf_dir):
    p = _plans(spark, sf_dir).withColumn("t", plans.taxonomy(F.col("plan_read")))
    return p.select("event_id", F.col("plan_read.lon").alias("lon"), F.col("t.lateral").alias("lateral"))


@query(_PLANS_SQL + """, m AS (SELECT *, CASE WHEN speed < 3 THEN 'decelerate' ELSE 'keep' END AS m_lon FROM p)
SELECT event_id, CASE WHEN lon = 'unspecified' THEN NULL WHEN lon = m_lon THEN true WHEN lon = 'keep' THEN m_lon = 'decelerate' AND speed >= 0.5 WHEN lon = 'accelerate' THEN m_lon = 'keep' WHEN lon = 'stop' THEN m_lon = 'decelerate' OR speed < 1.5 ELSE false END AS consistent FROM m""")
def plan_consistency(spark, sf_dir):
    p = _plans(spark, sf_dir).withColumn("m_lon", F.when(F.col("speed") < 3, "decelerate").otherwise("keep"))
    ok = plans.consistent(F.col("plan_read"), F.col("m_lon"), F.lit(None).cast("string"), F.col("speed"), F.col("speed"), F.lit(None).cast("double"))
    return p.select("event_id", ok.alias("consistent"))


@query()
def plan_repairs(spark, sf_dir):
    f = frames(spark, sf_dir)
    names = spark.createDataFrame([(i, p) for i, (p, _, _) in enumerate(PLAN_SENTENCES)], "i long, plan string")
    f = f.join(F.broadcast(names), F.col("event_id") % 7 == F.col("i")).withColumn("m_lon", F.lit("accelerate")).withColumn("none", F.lit(None).cast("double"))
    done = plans.repair_plans(f.withColumn("m_lat", F.lit("straight")), "plan", "m_lon", "m_lat", "speed", "none", "none")
    return done.groupBy("plan", "new_plan", "reason_weight").agg(F.count("*").alias("n"))


def _paths(spark, sf_dir):
    """Paths of 20 samples that bend with the scene's number."""
    s = series(spark, sf_dir)
    bend = (F.col("scene_id") % 7 - 3) / 20.0
    pts = F.transform(motion.running_sums(F.col("future")), lambda d, i: F.struct((d * 0.25 * F.cos(bend * (i + 1))).alias("x"), (d * 0.25 * F.sin(bend * (i + 1))).alias("y")))
    return s.withColumn("truth", pts)


@query(
    "WITH "
    + SERIES_SQL
    + """, p AS (SELECT intent, (scene_id % 7 - 3) / 60.0 AS b, list_transform(range(0, 21), lambda i: CASE WHEN i = 0 THEN 0.0 ELSE list_sum(list_transform(future[1:i], lambda v: v + 1.6)) * 0.25 END) AS r FROM series),
c AS (SELECT intent, list_transform(range(0, 21), lambda i: r[i + 1] * cos(b * i)) AS x, list_transform(range(0, 21), lambda i: r[i + 1] * sin(b * i)) AS y FROM p),
h AS (SELECT intent, list_transform(range(1, 21), lambda i: atan2(y[i + 1] - y[i], x[i + 1] - x[i])) AS h, list_transform(range(1, 21), lambda i: sqrt(pow(y[i + 1] - y[i], 2) + pow(x[i + 1] - x[i], 2))) AS n FROM c),
m AS (SELECT intent, h, list_avg(h) AS mh, list_transform(range(1, 21), lambda i: list_sum(n[1:i]) - n[i] / 2) AS m FROM h), k AS (SELECT *, list_avg(m) AS mm FROM m),
s AS (SELECT *, list_sum(list_transform(range(1, 21), lambda i: (m[i] - mm) * (h[i] - mh))) / list_sum(list_transform(m, lambda v: (v - mm) * (v - mm))) AS slope FROM k),
t AS (SELECT intent, degrees(h[20] - h[1]) AS theta, degrees(list_max(list_transform(range(1, 21), lambda i: abs(h[i] - mh - slope * (m[i] - mm))))) AS residual FROM s)
SELECT intent, CASE WHEN abs(theta) >= 25 AND (residual >= 5 OR intent <> 'GO_STRAIGHT') THEN CASE WHEN theta > 0 THEN 'left_turn' ELSE 'right_turn' END ELSE 'straight' END AS lat, count(*) AS n, round(avg(theta), 6) AS theta, round(avg(residual), 6) AS residual FROM t GROUP BY 1, 2"""
)
def lateral_motion(spark, sf_dir):
    bend = (F.col("scene_id") % 7 - 3) / 60.0
    steps = motion.running_sums(F.transform("future", lambda v: v + 1.6))
    pts = F.transform(steps, lambda d, i: F.struct((d * 0.25 * F.cos(bend * (i + 1))).alias("x"), (d * 0.25 * F.sin(bend * (i + 1))).alias("y")))
    p = series(spark, sf_dir).withColumn("h", geometry.heading(pts))
    lat = motion.lat_class(F.col("h.theta"), F.col("h.residual"), F.col("intent"))
    return p.groupBy("intent", lat.alias("lat")).agg(F.count("*").alias("n"), F.round(F.avg("h.theta"), 6).alias("theta"), F.round(F.avg("h.residual"), 6).alias("residual"))


@query()
def reference_rows(spark, sf_dir):
    p = _paths(spark, sf_dir).select(F.concat_ws("-", "scene_id", "frame_no").alias("frame_key"), "truth", F.col("v0").alias("vx"), F.lit(0.0).alias("vy"), motion.speed_bucket(F.col("v0")).alias("bucket"))
    rows = evaluate.reference_predictions(p, "frame_key", ("truth", "bucket"))
    return evaluate.trajectory_summary(rows, ["kind", "bucket"])


@query("WITH " + SERIES_SQL + ", p AS (SELECT scene_id || '-' || frame_no AS frame_key, (scene_id % 7 - 3) / 20.0 AS b, list_transform(range(1, 21), lambda i: list_sum(future[1:i]) * 0.25) AS r FROM series) SELECT frame_key, unnest([4, 8, 12, 16, 20]) AS step, round(unnest(list_transform([4, 8, 12, 16, 20], lambda i: r[i] * cos(b * i))), 6) AS x, round(unnest(list_transform([4, 8, 12, 16, 20], lambda i: r[i] * sin(b * i))), 6) AS y FROM p")
def ceiling_knots(spark, sf_dir):
    """The monotone cubic through whole seconds goes through them."""
    p = _paths(spark, sf_dir).select(F.concat_ws("-", "scene_id", "frame_no").alias("frame_key"), "truth", F.col("v0").alias("vx"), F.lit(0.0).alias("vy"))
    rows = evaluate.reference_predictions(p, "frame_key", kinds=("ceiling",))
    knots = rows.select("frame_key", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.col("pred")[i - 1].alias("p")) for i in (4, 8, 12, 16, 20)])).alias("k"))
    return knots.select("frame_key", "k.step", F.round("k.p.x", 6).alias("x"), F.round("k.p.y", 6).alias("y"))


@query("SELECT 'all' AS slice, NULL AS value, 'n' AS metric, count(*)::DOUBLE AS value_of FROM orders UNION ALL SELECT 'o_orderstatus', o_orderstatus, 'n', count(*)::DOUBLE FROM orders GROUP BY 2")
def long_metrics(spark, sf_dir):
    wide = aggregate.by_slice(table(spark, sf_dir, "orders"), ["o_orderstatus"], F.count("*").alias("n"))
    return evaluate.long_metrics(wide.withColumnRenamed("value", "v"), "slice", "v").withColumnRenamed("value", "value_of").withColumnRenamed("v", "value")


@query("WITH " + _PAIRS + ", " + _greedy_sql("d <= gate") + """, t AS (SELECT o.*, k.p, k.d, f.class AS pclass, least(60.0, greatest(15.0, 0.5 * sqrt(o.w * o.w + o.h * o.h))) AS near FROM objects o LEFT JOIN taken k ON k.frame = o.frame AND k.g = o.g LEFT JOIN objects f ON f.frame = k.frame AND f.g = k.p WHERE o.g <= 3)
SELECT count(*) AS objects, count(p) AS matched, round(avg((p IS NOT NULL)::INT), 9) AS recall, round(avg((p IS NOT NULL)::INT) FILTER (rank = 1), 9) AS recall_rank1, round(avg((class = pclass)::INT), 9) AS type_acc, round(avg(d), 6) AS mean_distance, round(avg((d <= near)::INT), 9) AS loc_hit,
(SELECT count(*) FROM objects WHERE g > 3) AS predicted, round(count(p) / (SELECT count(*) FROM objects WHERE g > 3)::DOUBLE, 9) AS precision FROM t""")
def object_scores(spark, sf_dir):
    truth, found = _sides(spark, sf_dir)
    got = evaluate.object_metrics(truth, found, match.assign_objects(truth, found, "frame"), "frame")
    return got.withColumns({c: F.round(c, 6 if c == "mean_distance" else 9) for c in ("recall", "recall_rank1", "type_acc", "mean_distance", "loc_hit", "precision")})


@query(
    "WITH "
    + OBJECTS_SQL
    + """, t AS (SELECT frame, class, count(*) AS t FROM objects WHERE g <= 3 GROUP BY 1, 2), f AS (SELECT frame, class, count(*) AS f FROM objects WHERE g > 3 GROUP BY 1, 2),
b AS (SELECT coalesce(t, 0) AS t, coalesce(f, 0) AS f FROM t FULL JOIN f ON f.frame = t.frame AND f.class = t.class), s AS (SELECT sum(least(t, f))::BIGINT AS tp, sum(greatest(t - f, 0))::BIGINT AS missed, sum(greatest(f - t, 0))::BIGINT AS extra FROM b)
SELECT tp, missed, extra, round(tp / (tp + extra)::DOUBLE, 9) AS precision, round(tp / (tp + missed)::DOUBLE, 9) AS recall, round(2 * tp / (2 * tp + extra + missed)::DOUBLE, 9) AS f1 FROM s"""
)
def typeonly_scores(spark, sf_dir):
    o = objects(spark, sf_dir)
    found = evaluate.typeonly_metrics(o.where("g <= 3"), o.where("g > 3"), "frame", "class")
    return found.select("tp", "missed", "extra", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")])


@query("SELECT o_orderstatus AS status, max(o_custkey) AS longest, round(avg(o_custkey), 6) AS mean, round(quantile_cont(o_custkey, 0.99), 6) AS p99, count(*) FILTER (o_totalprice > 100000) AS hit_cap, count(*) AS n FROM orders GROUP BY 1")
def answer_lengths(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("n_new_tokens"), (F.col("o_totalprice") > 100000).alias("hit_cap"))
    return evaluate.length_summary(o, "status").withColumns({c: F.round(c, 6) for c in ("mean", "p99")})


@query("WITH " + FRAMES_SQL + ", k(target, sentence) AS (VALUES ('stop', 'decelerate to a stop'), ('decelerate', 'decelerate'), ('keep', 'keep lane and cruise'), ('accelerate', 'accelerate')) SELECT event_id, target, 'r ' || intent || '<final_plan>' || sentence || '</final_plan>' AS prefix FROM frames, k WHERE target <> CASE WHEN speed < 1 THEN 'stop' ELSE 'keep' END")
def intervention_prefixes(spark, sf_dir):
    f = frames(spark, sf_dir).select("event_id", F.concat(F.lit("r "), "intent", F.lit("<final_plan>go</final_plan> rest")).alias("answer"), F.when(F.col("speed") < 1, "stop").otherwise("keep").alias("lon"))
    return evaluate.intervention_prefixes(f, "answer", "lon").select("event_id", "target", "prefix")


@query(
    "WITH "
    + FRAMES_SQL
    + """, k(field, origin) AS (VALUES ('reason', 'prose'), ('final_plan', 'prose'), ('traj', 'prose'), ('objects', 'prose')), n AS (SELECT count(*) FILTER (event_id % 2 = 0) AS even, count(*) FILTER (event_id % 2 = 1) AS odd FROM frames)
SELECT field, origin, odd AS n FROM k, n UNION ALL SELECT field, 'strict', even FROM k, n UNION ALL SELECT unnest(['context', 'events', 'motion']), 'none', even + odd FROM n"""
)
def extraction_origins(spark, sf_dir):
    f = frames(spark, sf_dir).select("event_id", "frame_no")
    tagged = F.format_string("<reason>r</reason><final_plan>stop</final_plan><obj type=Car><rank>1</rank></obj><traj>[1, %d], [2, 0], [3, 0], [4, 0], [5, 0]</traj>", "frame_no")
    prose = F.format_string("A white car at (1200, 600) waits. There is no bus.\nReason: it waits\nPlan: stop\nTrajectory: (1.0, %d), (2.0, 0), (3.0, 0), (4.0, 0), (5.0, 0)", "frame_no")
    return prose_module.answer_stats(f.select(F.when(F.col("event_id") % 2 == 0, tagged).otherwise(prose).alias("text")), "text")


@query("WITH " + FRAMES_SQL + """ SELECT event_id, '<context>weather=Fair;daytime=Unknown;visibility=Unknown;scenario=Unknown;road=Merge</context><events>' || event_type || '</events><has_objects>yes</has_objects><obj type=Car><point>' || frame_no || ',5</point><rank>1</rank><state>moving</state></obj><n_objects>1</n_objects>' AS target,
(1.0 + 1.0 + 1.0 + 3.0 + 2.0 + 3.0 + 1.5 + 1.5 + 2.0 + 0.2 * 16)::DOUBLE AS weight FROM frames""")
def target_texts(spark, sf_dir):
    f = frames(spark, sf_dir)
    context = F.struct(F.lit("Fair").alias("weather"), F.lit("").alias("daytime"), F.lit(None).cast("string").alias("visibility"), F.lit(None).cast("string").alias("scenario"), F.lit("Merge").alias("road"))
    none = F.lit(None).cast("string")
    point = F.struct(F.col("frame_no").alias("x"), F.lit(5).alias("y"))
    car = F.struct(F.lit("Car").alias("type"), point.alias("point"), F.lit(1).alias("rank"), none.alias("location"), none.alias("intention"), F.lit("moving").alias("state"), F.lit("red").alias("content"), none.alias("implication"), F.lit(1.0).alias("intention_factor"), F.lit(None).cast("double").alias("state_factor"))
    rows = f.select("event_id", context.alias("context"), F.array(F.array("event_type")).alias("events"), F.array(car).alias("objects"))
    t = targets.segment_columns(targets.build_targets(rows, "s1"))
    return t.select("event_id", "target", F.round(F.aggregate("weights", F.lit(0.0), lambda a, x: a + x), 6).alias("weight"))


@query("SELECT o_orderstatus AS part, count(DISTINCT o_custkey) AS scenes, count(*) AS scanned, count(*) FILTER (o_orderkey % 2 = 0) AS kept, count(*) FILTER (o_orderkey % 2 = 0 AND o_totalprice >= 100000) AS pos, count(*) FILTER (o_orderkey % 2 = 0 AND o_totalprice < 100000) AS neg FROM orders GROUP BY 1")
def index_statistics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("part"), F.col("o_custkey").alias("scene_id"), "o_orderkey", "o_totalprice")
    return curate.index_stats(o, F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") < 100000, "part")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS sc_F, count(*) FILTER (o_orderstatus = 'O') AS sc_O, count(*) FILTER (o_orderstatus = 'P') AS sc_P FROM orders GROUP BY 1")
def class_counts(spark, sf_dir):
    return curate.class_counts(table(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O", "P"])


@query(
    "WITH "
    + FRAMES_SQL
    + """, k AS (SELECT scene_id, frame_no, intent, CASE WHEN speed < 0.5 THEN 'stop' WHEN speed < 1 THEN 'start' ELSE 'keep' END AS kind FROM frames),
i AS (SELECT scene_id, intent, row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, min(frame_no)) AS r FROM k GROUP BY 1, 2), c AS (SELECT scene_id, kind, row_number() OVER (PARTITION BY scene_id ORDER BY count(*) DESC, min(frame_no)) AS r FROM k GROUP BY 1, 2),
n AS (SELECT scene_id, count(*) AS n_frames, count(*) FILTER (kind = 'start') AS n_start, count(*) FILTER (kind = 'stop') AS n_stop, count(*) FILTER (intent = 'GO_LEFT') AS n_left, count(*) FILTER (intent = 'GO_RIGHT') AS n_right FROM k GROUP BY 1)
SELECT n.*, i.intent || '|' || c.kind AS stratum FROM n JOIN i ON i.scene_id = n.scene_id AND i.r = 1 JOIN c ON c.scene_id = n.scene_id AND c.r = 1"""
)
def scene_profiles(spark, sf_dir):
    f = frames(spark, sf_dir).withColumn("kind", F.expr("CASE WHEN speed < 0.5 THEN 'stop' WHEN speed < 1 THEN 'start' ELSE 'keep' END"))
    return curate.scene_profile(f, "frame_no", "intent", "kind")


@query("WITH f AS (SELECT p_brand AS value, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, n FROM part JOIN f ON f.value = p_brand")
def value_frequency(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    freq = aggregate.frequency(p, "p_brand").withColumnRenamed("p_brand", "value")
    return curate.with_frequency(p.select("p_partkey", F.lower("p_brand").alias("b")), "b", freq).select("p_partkey", "n")


@query("WITH b AS (SELECT l_orderkey, l_tax AS base FROM lineitem WHERE l_linenumber = 1) SELECT l_linenumber AS variant, count(*) AS n, round(avg(l_tax), 9) AS mean, round(avg(l_tax - base), 9) AS diff, count(base) AS paired FROM lineitem LEFT JOIN b USING (l_orderkey) GROUP BY 1")
def variant_summary(spark, sf_dir):
    first = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("variant"), "l_tax")
    found = curate.variant_summary(first, "variant", "l_orderkey", "l_tax", 1)
    return found.withColumns({c: F.round(c, 9) for c in ("mean", "diff")})


@query("WITH " + OBJECTS_SQL + ", m AS (SELECT CASE class WHEN 'A' THEN 'cruising' WHEN 'N' THEN 'parking' ELSE 'other' END AS t, g > 3 AS late FROM objects), p AS (SELECT t, CASE WHEN late THEN 'cruising' ELSE t END AS f FROM m) SELECT t AS label, count(*) AS support, round(avg((t = f)::INT), 9) AS recall, round(count(*) FILTER (t = f) / nullif((SELECT count(*) FROM p q WHERE q.f = p.t), 0)::DOUBLE, 9) AS precision FROM p GROUP BY 1")
def behaviour_report(spark, sf_dir):
    o = objects(spark, sf_dir)
    said = F.when(F.col("class") == "A", "driving").when(F.col("class") == "N", "park").otherwise("??")
    rows = o.select(said.alias("state"), F.when(F.col("g") > 3, "cruise").otherwise(said).alias("pred_state"))
    return curate.behaviour_metrics(rows).where("support > 0").select("label", "support", *[F.round(c, 9).alias(c) for c in ("recall", "precision")])
