"""Queries of recurrences along keys, in batch; the same steps run on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from loomery.operators import feature_store as S
from loomery.operators import recurrences as R
from loomery.operators import timeseries as T
from loomery.plans.series import _daily, _r
from loomery.session import shared_dir, table


def online_learner(s, d):
    """Is a value above 50, and, from the 16th on, is it not? Learned row by row for each type of event; the change is found as drift."""
    e = table(s, d, "events")
    late = (F.col("ts") >= F.lit("2024-01-16").cast("timestamp")).cast("int")
    rows = e.select("event_type", "ts", "event_id", "value", F.hour("ts").alias("hour"), (F.col("user_id") % 10).alias("part"), ((F.col("value") > 50).cast("int") + late).alias("y")).withColumn("y", F.col("y") % 2)
    learned = R.scan(rows, ["event_type"], ["ts", "event_id"], ["y", "value", "hour", "part"], R.OnlineLearner(3))
    return learned.select("event_type", "event_id", "prediction", "error", "drift", F.round("error_rate", 6).alias("error_rate"), "seen", "drifts", "since_drift")


def chart_scan(s, d):
    daily = _daily(s, d)
    limits = daily.filter("day < '2024-01-16'").groupBy("event_type").agg(F.avg("v").alias("m"), F.greatest(F.lit(1e-8), F.stddev_samp("v")).alias("sd"))
    out = R.scan(daily.join(limits, "event_type"), ["event_type"], ["day"], ["v", "m", "sd"], R.ControlChart())
    return _r(out, 6, "z").select("event_type", "day", "z", "rule", "violations")


def _calibrated(s, d):
    """Six-hourly counts by type; the season of the first twenty days of each."""
    e = table(s, d, "events")
    slot = F.timestamp_seconds(F.floor(F.unix_timestamp("ts") / 21600) * 21600)
    x = e.groupBy("event_type", slot.alias("h")).agg(F.count(F.lit(1)).cast("double").alias("x"))
    base = x.filter("h < '2024-01-21'")
    profile = R.seasonal_profile(T.seasonal_decompose(base, ["event_type"], "h", "x", 4), ["event_type"], "h", 4)
    return x.filter("h >= '2024-01-21'"), profile


def seasonal_scan(s, d):
    rows, profile = _calibrated(s, d)
    out = R.scan(rows.join(profile, "event_type"), ["event_type"], ["h"], ["x", "season", "start", "mean", "std"], R.SeasonalResidual(4))
    return _r(out, 9, "trend", "seasonal", "residual", "score").select("event_type", "h", "trend", "seasonal", "residual", "score", "is_anomaly")


def hidden_state_filter(s, d):
    """Chances of the busy state of daily means, day by day, under models fitted to the first half of the month."""
    daily = _daily(s, d)
    models = T.hmm_parameters(daily.filter("day < '2024-01-16'"), ["event_type"], "day", "v")
    out = R.scan(daily.join(models, "event_type"), ["event_type"], ["day"], ["v", "pi", "a", "mu", "sd"], R.HiddenStates())
    return _r(out, 6, "posterior", "log_likelihood")


def _daily_of_users(s, d):
    """Events of each user by day, known from the end of the day on."""
    e = table(s, d, "events")
    day = e.groupBy("user_id", F.date_trunc("day", "ts").alias("day"))
    return day.agg(F.count(F.lit(1)).alias("n_day"), F.round(F.avg("value"), 6).alias("mean_day")).withColumn("known", F.col("day") + F.expr("INTERVAL 1 DAY"))


def asof_features(s, d):
    """Purchases with what was known of their user then: events and mean value of the user's last day with events, at most five days old."""
    e = table(s, d, "events").filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return S.as_of_join(e, _daily_of_users(s, d), "user_id", "ts", "known", ["n_day", "mean_day"], ttl="5 DAYS", age="age").withColumn("age", F.round("age", 3))


def asof_orders(s, d):
    """Orders with the state of their customer as of the last earlier day on which they ordered."""
    o = table(s, d, "orders")
    daily = o.groupBy("o_custkey", F.to_timestamp("o_orderdate").alias("day")).agg(F.sum("o_totalprice").alias("spent"), F.count(F.lit(1)).alias("n"))
    daily = daily.select("o_custkey", (F.col("day") + F.expr("INTERVAL 1 DAY")).alias("known"), F.round("spent", 2).alias("spent"), "n")
    return S.as_of_join(o.select("o_orderkey", "o_custkey", "o_orderdate"), daily, "o_custkey", "o_orderdate", "known", ["spent", "n"], width="180 days")


def online_latest(s, d):
    """The online store after upserts of the month in two halves, the first of them twice and after the second."""
    rows = _daily_of_users(s, d).select("user_id", "known", F.when(F.col("n_day") > 2, F.col("n_day")).alias("n_day"), "mean_day")
    store = S.OnlineStore(s, f"{shared_dir(s)}/online-{uuid.uuid4().hex}", "user_id", "known", {"n_day": "bigint", "mean_day": "double"}, buckets=8)
    early, late = rows.filter("known < '2024-01-16'"), rows.filter("known >= '2024-01-16'")
    for batch, part in ((1, early), (2, late), (1, early), (3, early)):
        store.upsert(part, batch)
    return store.read()


def cache_replay(s, d):
    """Turns of users asked of a cache for each of eight tenants; the next turn of the conversation is the answer that is kept."""
    c = table(s, d, "conversations")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    asked = c.filter("role = 'user'").join(nxt, ["conv_id", "turn"], "left").select((F.col("conv_id") % 8).alias("tenant"), "conv_id", "turn", "text", "answer", (F.col("conv_id") * 60_000_000 + F.col("turn") * 1_000_000).alias("at"))
    out = R.scan(asked, ["tenant"], ["conv_id", "turn"], ["at", "text", "answer"], R.SemanticCache(0.2, 50, 7200.0))
    return out.select("conv_id", "turn", "hit", F.sha2(F.col("answer").cast("binary"), 256).alias("answer_sha256"), F.round("similarity", 6).alias("similarity"), "entries", "hits", "misses", "evicted", "expired")


def session_memory(s, d):
    """Types of events of each user: the last five of the session before each, sessions ending after twelve quiet hours."""
    e = table(s, d, "events").select("user_id", "ts", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    out = R.scan(e, ["user_id"], ["ts", "event_id"], ["at", "event_type"], R.SessionMemory(5, 43_200.0))
    return out.select("event_id", F.array_join("recent", ",").alias("recent"), "cold", "seen", "length")


QUERIES = {"cache_replay": cache_replay, "session_memory": session_memory, "asof_features": asof_features, "asof_orders": asof_orders, "online_latest": online_latest, "online_learner": online_learner, "chart_scan": chart_scan, "seasonal_scan": seasonal_scan, "hidden_state_filter": hidden_state_filter}

_DAYS = """SELECT user_id, date_trunc('day', ts) + INTERVAL 1 DAY AS known, count(*) AS n_day, round(avg(value), 6) AS mean_day FROM events GROUP BY 1, 2"""

SQL = {
    "session_memory": """WITH e AS (SELECT *, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER w > 43200000000, true) AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
g AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e),
r AS (SELECT event_id, event_type, row_number() OVER w AS length, list(event_type) OVER (w ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS recent FROM g WINDOW w AS (PARTITION BY user_id, session ORDER BY ts, event_id))
SELECT event_id, coalesce(array_to_string(recent, ','), '') AS recent, length = 1 AS cold, coalesce(list_contains(recent, event_type), false) AS seen, length FROM r""",
    "asof_features": f"""WITH h AS ({_DAYS})
SELECT event_id, e.user_id, ts, CASE WHEN known + INTERVAL 5 DAY >= ts THEN n_day END AS n_day, CASE WHEN known + INTERVAL 5 DAY >= ts THEN mean_day END AS mean_day,
  CASE WHEN known + INTERVAL 5 DAY >= ts THEN round((epoch_us(ts) - epoch_us(known)) / 1e6, 3) END AS age
FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN h ON e.user_id = h.user_id AND e.ts >= h.known""",
    "asof_orders": """WITH h AS (SELECT o_custkey, o_orderdate + INTERVAL 1 DAY AS known, round(sum(o_totalprice), 2) AS spent, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderkey, o.o_custkey, o_orderdate, spent, n FROM orders o ASOF LEFT JOIN h ON o.o_custkey = h.o_custkey AND o.o_orderdate >= h.known""",
    "online_latest": f"""WITH h AS ({_DAYS}) SELECT user_id, max(known) AS known, arg_max(n_day, known) FILTER (n_day > 2) AS n_day, arg_max(mean_day, known) AS mean_day FROM h GROUP BY 1""",
    "chart_scan": """WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2),
b AS (SELECT event_type, avg(v) AS m, greatest(1e-8, stddev_samp(v)) AS sd FROM d WHERE day < DATE '2024-01-16' GROUP BY 1), z AS (SELECT event_type, day, (v - m) / sd AS z FROM d JOIN b USING (event_type)),
r AS (SELECT *, CASE WHEN abs(z) > 3 THEN 1
  WHEN count(*) OVER w3 = 3 AND greatest(count(*) FILTER (z > 2) OVER w3, count(*) FILTER (z < -2) OVER w3) >= 2 THEN 2
  WHEN count(*) OVER w5 = 5 AND greatest(count(*) FILTER (z > 1) OVER w5, count(*) FILTER (z < -1) OVER w5) >= 4 THEN 3
  WHEN count(*) OVER w8 = 8 AND greatest(count(*) FILTER (z > 0) OVER w8, count(*) FILTER (z < 0) OVER w8) >= 8 THEN 4 ELSE 0 END AS rule FROM z
  WINDOW w3 AS (PARTITION BY event_type ORDER BY day ROWS 2 PRECEDING), w5 AS (PARTITION BY event_type ORDER BY day ROWS 4 PRECEDING), w8 AS (PARTITION BY event_type ORDER BY day ROWS 7 PRECEDING))
SELECT event_type, day, round(z, 6) AS z, rule, count(*) FILTER (rule > 0) OVER (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS violations FROM r""",
    "seasonal_scan": """WITH x AS (SELECT event_type, to_timestamp(floor(epoch(ts) / 21600) * 21600)::TIMESTAMPTZ AT TIME ZONE 'UTC' AS h, CAST(count(*) AS DOUBLE) AS x FROM events GROUP BY 1, 2),
b AS (SELECT *, (row_number() OVER w - 1) % 4 AS p, CASE WHEN count(*) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) = 5 THEN (avg(x) OVER (w ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) + avg(x) OVER (w ROWS BETWEEN 1 PRECEDING AND 2 FOLLOWING)) / 2 END AS t
  FROM x WHERE h < TIMESTAMP '2024-01-21' WINDOW w AS (PARTITION BY event_type ORDER BY h)),
s AS (SELECT event_type, p, coalesce(avg(x - t), 0) AS s FROM b GROUP BY 1, 2), c AS (SELECT event_type, p, s - avg(s) OVER (PARTITION BY event_type) AS s FROM s),
e AS (SELECT b.event_type, x - t - s AS r FROM b JOIN c USING (event_type, p)), m AS (SELECT event_type, median(r) AS m FROM e GROUP BY 1),
q AS (SELECT event_type, any_value(m) AS m, greatest(1e-8, 1.4826 * median(abs(r - m))) AS sd FROM e JOIN m USING (event_type) GROUP BY 1), n AS (SELECT event_type, count(*) AS n FROM b GROUP BY 1),
o AS (SELECT x.event_type, h, x, avg(x) OVER (w ROWS 3 PRECEDING) AS trend, (n + row_number() OVER w - 1) % 4 AS p FROM x JOIN n USING (event_type) WHERE h >= TIMESTAMP '2024-01-21' WINDOW w AS (PARTITION BY x.event_type ORDER BY h)),
f AS (SELECT event_type, h, trend, s AS seasonal, x - trend - s AS residual, abs(x - trend - s - m) / sd AS z FROM o JOIN c USING (event_type, p) JOIN q USING (event_type))
SELECT event_type, h, round(trend, 9) AS trend, round(seasonal, 9) AS seasonal, round(residual, 9) AS residual, round(z / (z + 3), 9) AS score, z > 3 AS is_anomaly FROM f""",
}
