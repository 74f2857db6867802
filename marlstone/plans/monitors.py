"""Time-ordered monitors (N, D19, D20) on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.operators import monitors as M
from marlstone.plans import bindings as B
from marlstone.plans.book import Book
from marlstone.streaming.watermarked import drained

book = Book()


def samples(spark, d):
    """Events as samples of runs; seconds since the epoch."""
    return B.table(spark, d, "events").select(F.col("event_type").alias("run"), "event_id", F.unix_timestamp("ts").alias("at"), "value")


SAMPLES = "sa AS (SELECT event_type AS run, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS at_, value FROM events)"
HOURLY = """ho AS (SELECT event_type AS series, CAST(floor(epoch(ts)) AS BIGINT) // 3600 AS at_, count(*) AS value FROM events GROUP BY ALL)"""


def hourly(spark, d):
    return B.table(spark, d, "events").groupBy(F.col("event_type").alias("series"), F.expr("unix_timestamp(ts) div 3600").alias("at")).agg(F.count("*").alias("value"))


@book("n1_runtime_state", "SELECT event_id, CASE WHEN event_id % 30 >= 23.5 THEN 'HARD_TIME_LIMIT_REACHED' WHEN event_id % 30 >= 11.5 THEN 'TIME_BUDGET_REACHED' WHEN value < 4 THEN 'RESOURCE_GUARD_STOPPED' ELSE 'CONTINUE' END AS state FROM events")
def runtime_state(spark, d):
    return B.table(spark, d, "events").select("event_id", M.runtime_state((F.col("event_id") % 30).cast("double"), F.col("value"), 11.5, 23.5, 4.0).alias("state"))


@book("n1_start_reasons", "SELECT event_id, array_to_string(list_filter([CASE WHEN value < 20 THEN 'disk_free_low' END, CASE WHEN event_id % 16 < 8 THEN 'memory_available_low' END, CASE WHEN event_id % 12 > 9 THEN 'gpu_memory_used_high' END], lambda x: x IS NOT NULL), ';') AS reasons FROM events")
def start_reasons(spark, d):
    k = F.col("event_id")
    return B.table(spark, d, "events").select("event_id", F.array_join(M.start_reasons(F.col("value"), k % 16, k % 12, (20, 8, 9)), ";").alias("reasons"))


SUSTAINED = f"WITH {SAMPLES}, i AS (SELECT *, coalesce(value > 50, false) AS hi, sum(CASE WHEN coalesce(value > 50, false) THEN 0 ELSE 1 END) OVER (PARTITION BY run ORDER BY at_, event_id ROWS UNBOUNDED PRECEDING) AS isl FROM sa), k AS (SELECT *, min(at_) OVER (PARTITION BY run, isl, hi ORDER BY at_, event_id ROWS UNBOUNDED PRECEDING) AS since, row_number() OVER (PARTITION BY run, isl, hi ORDER BY at_, event_id) AS k FROM i) SELECT event_id, hi AND k > 1 AND at_ - since >= 3600 AS fired FROM k"


@book("n2_sustained_pressure", SUSTAINED)
def sustained(spark, d):
    return M.sustained(samples(spark, d), 50.0, 3600, order=["event_id"]).select("event_id", "fired")


@book("n2_sustained_stream", SUSTAINED)
def sustained_stream(spark, d):
    own = samples(spark, d).select("run", F.col("event_id").alias("id"), F.timestamp_seconds("at").alias("ts"), "value")
    return drained(own, 50.0, 3600).select(F.col("id").alias("event_id"), "fired")


@book("n3_early_stopping", "WITH s AS (SELECT user_id AS run, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events), t AS (SELECT *, b IS NULL OR value > b AS improved FROM s), u AS (SELECT *, k - max(CASE WHEN improved THEN k END) OVER (PARTITION BY run ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS stale FROM t) SELECT run, event_id AS epoch, improved, CAST(stale AS INTEGER) AS stale, stale >= 5 AS stop FROM u")
def early_stopping(spark, d):
    own = B.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("score"))
    return M.early_stopping(own, 5).select("run", "epoch", "improved", "stale", "stop")


@book("n3_early_stopping_gain", """WITH RECURSIVE s AS (SELECT user_id AS run, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
 r AS (SELECT run, event_id, k, true AS improved, CAST(value AS DOUBLE) AS best, 0 AS stale FROM s WHERE k = 1 UNION ALL SELECT s.run, s.event_id, s.k, s.value > r.best + 5, CASE WHEN s.value > r.best + 5 THEN s.value ELSE r.best END, CASE WHEN s.value > r.best + 5 THEN 0 ELSE r.stale + 1 END FROM r JOIN s ON s.run = r.run AND s.k = r.k + 1)
 SELECT run, event_id AS epoch, improved, stale, stale >= 5 AS stop FROM r""")
def early_stopping_gain(spark, d):
    own = B.table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), F.col("value").alias("score"))
    return M.early_stopping_gain(own, 5, 5.0).select("run", "epoch", "improved", "stale", "stop")


@book("n4_elapsed_hours", "WITH a AS (SELECT user_id AS run, CASE WHEN event_id % 3 = 0 THEN value / 10 END AS t, value / 20 - 1 AS e FROM events) SELECT run, round(max(coalesce(t, e)), 6) AS hours, count(*) FILTER (WHERE coalesce(t, e) < 0) AS negative FROM a GROUP BY 1")
def elapsed(spark, d):
    own = B.table(spark, d, "events").select(F.col("user_id").alias("run"), F.when(F.col("event_id") % 3 == 0, F.col("value") / 10).alias("elapsed_hours_total"), (F.col("value") / 20 - 1).alias("elapsed_hours"))
    return B.rounded(M.elapsed_hours(own))


@book("d19_foreground_runs", f"WITH {HOURLY}, l AS (SELECT series, quantile_cont(value, 0.5) * 1.2::DOUBLE AS lv FROM ho WHERE value > 0 GROUP BY 1), g AS (SELECT h.*, CASE WHEN at_ - lag(at_) OVER (PARTITION BY h.series ORDER BY at_) <= 3 THEN 0 ELSE 1 END AS n FROM ho h JOIN l ON h.series = l.series AND value > lv), r AS (SELECT *, sum(n) OVER (PARTITION BY series ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT series, min(at_) AS first, max(at_) AS last, count(*) AS n FROM r GROUP BY series, run")
def foreground(spark, d):
    return M.foreground_runs(hourly(spark, d), 1.2, 2)


@book("d19_series_edges", f"WITH {HOURLY}, j AS (SELECT *, abs(value - lag(value) OVER (PARTITION BY series ORDER BY at_)) AS jump FROM ho), t AS (SELECT *, max(jump) OVER (PARTITION BY series) AS top FROM j) SELECT series, max(at_) AS edge, count(*) AS candidates FROM t WHERE top > 0 AND jump >= 0.8 * top GROUP BY 1")
def series_edges(spark, d):
    return M.edges(hourly(spark, d), 0.8)


@book("d19_spaced_candidates", f"""WITH RECURSIVE {HOURLY}, j AS (SELECT series, at_, abs(value - lag(value) OVER (PARTITION BY series ORDER BY at_)) AS jump FROM ho), o AS (SELECT series, list_sort(list({{'j': -jump, 'a': at_}})) AS l FROM j WHERE jump IS NOT NULL GROUP BY 1),
 s AS (SELECT series, l, 1 AS k, CAST([] AS BIGINT[]) AS c FROM o UNION ALL SELECT series, l, k + 1, CASE WHEN len(c) < 8 AND len(list_filter(c, lambda x: abs(x - l[k].a) < 6)) = 0 THEN list_append(c, l[k].a) ELSE c END FROM s WHERE k <= len(l)) SELECT series, array_to_string(c, ',') AS candidates FROM s WHERE k = len(l) + 1""")
def candidates(spark, d):
    return M.spaced_candidates(hourly(spark, d), 8, 6).select("series", F.array_join("candidates", ",").alias("candidates"))


@book("d20_moving_mean", f"WITH {HOURLY}, s AS (SELECT *, sum(value) OVER (PARTITION BY series ORDER BY at_ ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS smooth, min(value) OVER (PARTITION BY series) AS lo, max(value) OVER (PARTITION BY series) AS hi FROM ho) SELECT series, at_ AS at_hour, round(smooth, 6) AS smooth, round(coalesce((value - lo) / nullif(hi - lo, 0), 0), 6) AS scaled FROM s")
def moving_mean(spark, d):
    return B.rounded(M.scaled(M.moving_mean(hourly(spark, d), 5)).select("series", F.col("at").alias("at_hour"), "smooth", "scaled"))


@book("d20_best_runs", f"WITH {HOURLY}, l AS (SELECT series, quantile_cont(value, 0.5) * 1.2::DOUBLE AS lv FROM ho WHERE value > 0 GROUP BY 1), g AS (SELECT h.*, CASE WHEN at_ - lag(at_) OVER (PARTITION BY h.series ORDER BY at_) <= 3 THEN 0 ELSE 1 END AS n FROM ho h JOIN l ON h.series = l.series AND value > lv), r AS (SELECT *, sum(n) OVER (PARTITION BY series ORDER BY at_ ROWS UNBOUNDED PRECEDING) AS run FROM g), f AS (SELECT series, min(at_) AS first, max(at_) AS last FROM r GROUP BY series, run) SELECT series, first, last FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY last - first + 1 < 4, last - first DESC, first) AS k FROM f) WHERE k = 1")
def best_runs(spark, d):
    return M.best_runs(M.foreground_runs(hourly(spark, d), 1.2, 2), 4)
