"""Queries on drift, series, control charts and service levels, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import drift as D
from loomery.operators import quality_control as Q
from loomery.operators import timeseries as T
from loomery.plans.governance import DRIFT_REPORT
from loomery.session import table

SPLIT = "2024-01-16"


def _r(df, places: int, *cols: str):
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def _halves(s, d):
    return table(s, d, "events").select(F.when(F.col("ts") < F.lit(SPLIT).cast("timestamp"), "ref").otherwise("cur").alias("side"), F.col("event_type").alias("column"), F.col("value").alias("value"))


def _hourly(s, d):
    e = table(s, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.round(F.avg("value"), 6).alias("v"), F.count(F.lit(1)).alias("n"))


def _daily(s, d):
    return table(s, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))


def _flat(x):
    return x.select("event_type", "day", "v")


def rolling_zscore(s, d):
    return _r(T.rolling_zscore(table(s, d, "events").select("event_id", "event_type", "ts", "value"), ["event_type"], ["ts", "event_id"], "value"), 6, "score").select("event_id", "score", "is_anomaly")


def spc_weco(s, d):
    daily = _daily(s, d)
    base = daily.filter("day < '2024-01-16'").groupBy("event_type").agg(F.avg("v").alias("m"), F.greatest(F.lit(1e-8), F.stddev_samp("v")).alias("sd"))
    return _r(Q.shewhart(daily.join(base, "event_type"), ["event_type"], "day", "v", F.col("m"), F.col("sd")), 6, "z").select("event_type", "day", "z", "rule")


def cusum(s, d):
    out = T.cusum(_daily(s, d).withColumn("day", F.col("day").cast("string")), ["event_type"], "day", "v", F.lit(100.0), F.lit(40.0))
    return _r(out, 6, "hi", "lo")


def stl_decompose(s, d):
    out = T.seasonal_decompose(_hourly(s, d).select("event_type", "h", F.col("n").cast("double").alias("x")), ["event_type"], "h", "x", 24)
    return _r(out, 4, "trend", "seasonal", "residual", "z")


def ensemble_vote(s, d):
    z = T.rolling_zscore(_daily(s, d), ["event_type"], ["day"], "v", 7, 2.0)
    one = z.select("event_type", "day", F.lit(1.0).alias("w"), F.col("is_anomaly").alias("f"), F.col("score").alias("sc"))
    two = z.select("event_type", "day", F.lit(2.0).alias("w"), (F.col("v") > 120).alias("f"), (F.col("v") / 100).alias("sc"))
    three = z.select("event_type", "day", F.lit(0.5).alias("w"), (F.col("v") < 80).alias("f"), (F.col("v") / 200).alias("sc"))
    return _r(T.ensemble(one.unionByName(two).unionByName(three), ["event_type", "day"], "f", "sc", "w"), 6, "weighted_score", "share")


def _monthly(s, d):
    return table(s, d, "orders").groupBy("o_orderstatus", F.date_trunc("month", "o_orderdate").alias("m")).agg(F.round(F.sum("o_totalprice") / 1e6, 6).alias("v"))


def holt_forecast(s, d):
    fitted = T.holt(_monthly(s, d), ["o_orderstatus"], "m", "v", 0.3, 0.1)
    return _r(T.forecast(fitted, ["o_orderstatus"], 6), 4, "forecast", "lo", "hi")


def burn_rate(s, d):
    e = table(s, d, "events")
    last = e.agg(F.max("ts").alias("now"))
    out = Q.burn_rates(e.crossJoin(F.broadcast(last)), "event_type", F.col("value") < 250, "ts", F.col("now"), 0.9)  # one row
    return _r(out, 6, "burn_1h", "burn_6h", "burn_72h", "error_rate", "consumed")


def lineage_hops(s, d):
    n, r = table(s, d, "nation"), table(s, d, "region")
    edges = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("src"), F.col("n_name").alias("dst"))
    c = table(s, d, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("src"), F.col("s_name").alias("dst"))
    return Q.hops(edges.unionByName(c), edges.select(F.col("src").alias("id")).filter("id < 'B'"))


def mmd_rbf(s, d):
    e = table(s, d, "embeddings")
    side = lambda k: e.filter(F.col("label") == k).select(F.col("vec_id").alias("id"), "embedding")
    return _r(D.mmd_rbf(side(0), side(1), "embedding", 0.05), 6, "mmd")


QUERIES = {
    "psi_equal_width": lambda s, d: _r(D.psi_equal_width(_halves(s, d), ["column"]), 6, "psi"),
    "psi_quantile": lambda s, d: _r(D.psi_quantile(_halves(s, d), ["column"]), 6, "psi"),
    "psi_unit": lambda s, d: _r(D.psi_unit(_halves(s, d).withColumn("value", F.col("value") / 500), ["column"]), 6, "psi"),
    "ks_statistic": lambda s, d: _r(D.ks_test(_halves(s, d), ["column"]).drop("p_value"), 6, "ks"),
    "wasserstein_quantile": lambda s, d: _r(D.wasserstein(_halves(s, d), ["column"]), 5, "wasserstein"),
    "js_divergence": lambda s, d: _r(D.js_divergence(_halves(s, d), ["column"]), 6, "js"),
    "chi2_statistic": lambda s, d: _r(D.chi2(_halves(s, d), "side", "column"), 6, "chi2"),
    "welch_z": lambda s, d: _r(D.welch_z(_halves(s, d), ["column"]), 6, "z"),
    "drift_report": lambda s, d: _r(D.drift_report(_halves(s, d)), 6, "psi", "ks", "p_value"),
    "wap_gate": lambda s, d: _r(D.audit_gate(table(s, d, "events").filter(F.col("ts") >= SPLIT), table(s, d, "events").filter(F.col("ts") < SPLIT), "value"), 6, "psi"),
    "mmd_rbf": mmd_rbf, "rolling_zscore": rolling_zscore, "spc_weco": spc_weco, "cusum": cusum, "stl_decompose": stl_decompose, "ensemble_vote": ensemble_vote,
    "holt_forecast": holt_forecast, "holt_grid": lambda s, d: _r(T.holt_grid(_monthly(s, d), ["o_orderstatus"], "m", "v"), 4, "level", "trend", "sse"),
    "burn_rate": burn_rate, "lineage_hops": lineage_hops,
    "kalman_level": lambda s, d: _r(T.kalman(_daily(s, d), ["event_type"], "day", "v"), 6, "level", "trend", "nis"),
    "hmm_viterbi": lambda s, d: _r(T.hmm_states(_daily(s, d), ["event_type"], "day", "v"), 6, "posterior"),
    "isolation_forest": lambda s, d: _r(T.isolation_forest(table(s, d, "lineitem").withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber")), "k", ["l_quantity", "l_extendedprice", "l_discount"]), 6, "score"),
    "sliding_windows": lambda s, d: T.sliding_windows(_daily(s, d), ["event_type"], "day", "v", 7, 3).select("event_type", "start", F.size("window").alias("n"), F.round(F.array_max("window"), 6).alias("top")),
}

_H = f"h AS (SELECT CASE WHEN ts < TIMESTAMP '{SPLIT}' THEN 'ref' ELSE 'cur' END AS side, event_type AS c, value AS v FROM events)"
_DAY = "daily AS (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS v FROM events GROUP BY ALL)"


def _bins(bins: int) -> str:
    return f"""WITH {_H}, b AS (SELECT c, min(v) AS lo, max(v) AS hi, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM h GROUP BY c),
        k AS (SELECT h.c, least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) AS k, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h JOIN b USING (c) GROUP BY ALL),
        x AS (SELECT b.c, coalesce(r, 0) / nr AS p, coalesce(n, 0) / nc AS q FROM b CROSS JOIN range({bins}) g(i) LEFT JOIN k ON k.c = b.c AND k.k = g.i)"""


SQL = {
    "drift_report": DRIFT_REPORT,
    "psi_equal_width": _bins(10) + ' SELECT c AS "column", round(sum((q + 1e-8 - p - 1e-8) * ln((q + 1e-8) / (p + 1e-8))), 6) AS psi FROM x GROUP BY c',
    "js_divergence": _bins(20) + ', y AS (SELECT c, (p + 1e-10) / (1 + 20e-10) AS p, (q + 1e-10) / (1 + 20e-10) AS q FROM x) SELECT c AS "column", round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / (2 * ln(2)), 6) AS js FROM y GROUP BY c',
    "psi_quantile": f"""WITH {_H}, e AS (SELECT c, list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM h WHERE side = 'ref' GROUP BY c),
        n AS (SELECT c, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM h GROUP BY c),
        k AS (SELECT h.c, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS k, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS m FROM h JOIN e USING (c) WHERE v >= e[1] AND v <= e[-1] GROUP BY ALL),
        g AS (SELECT c, unnest(range(1, len(e))) AS k FROM e), x AS (SELECT c, coalesce(r, 0) / (nr + 1e-6) + 1e-6 AS p, coalesce(m, 0) / (nc + 1e-6) + 1e-6 AS q FROM g LEFT JOIN k USING (c, k) JOIN n USING (c))
        SELECT c AS "column", round(sum((q - p) * ln(q / p)), 6) AS psi FROM x GROUP BY c""",
    "psi_unit": f"""WITH {_H}, k AS (SELECT c, least(floor(greatest(0, least(1, v / 500)) * 10), 9) AS k, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h GROUP BY ALL),
        t AS (SELECT c, sum(r) AS nr, sum(n) AS nc FROM k GROUP BY c), x AS (SELECT t.c, (coalesce(r, 0) / nr + 1e-6) / (1 + 1e-5) AS p, (coalesce(n, 0) / nc + 1e-6) / (1 + 1e-5) AS q FROM t CROSS JOIN range(10) g(i) LEFT JOIN k ON k.c = t.c AND k.k = g.i)
        SELECT c AS "column", round(sum((q - p) * ln(q / p)), 6) AS psi FROM x GROUP BY c""",
    "ks_statistic": f"""WITH {_H}, s AS (SELECT c, v, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h GROUP BY ALL),
        f AS (SELECT c, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY c) - sum(n) OVER w / sum(n) OVER (PARTITION BY c)) AS g FROM s WINDOW w AS (PARTITION BY c ORDER BY v)) SELECT c AS "column", round(max(g), 6)::DOUBLE AS ks FROM f GROUP BY c""",
    "wasserstein_quantile": f"""WITH {_H}, q AS (SELECT c, quantile_cont(v, (SELECT list(i / 999.0::DOUBLE ORDER BY i) FROM range(1000) t(i))) AS q, side FROM h GROUP BY c, side)
        SELECT a.c AS "column", round(list_sum(list_transform(list_zip(a.q, b.q), lambda x: abs(x[1] - x[2]))) / 1000, 5) AS wasserstein FROM q a JOIN q b ON a.c = b.c AND a.side = 'ref' AND b.side = 'cur'""".replace("(SELECT list(i / 999.0::DOUBLE ORDER BY i) FROM range(1000) t(i))", "[" + ", ".join(repr(i / 999) for i in range(1000)) + "]"),
    "chi2_statistic": f"WITH {_H}, x AS (SELECT c, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h GROUP BY c), y AS (SELECT n, r / sum(r) OVER () * sum(n) OVER () AS e FROM x) SELECT round(sum((n - e) * (n - e) / e), 6)::DOUBLE AS chi2, count(*) - 1 AS dof FROM y WHERE e >= 1",
    "welch_z": f"""WITH {_H} SELECT c AS "column", round((avg(v) FILTER (side = 'cur') - avg(v) FILTER (side = 'ref')) / sqrt(var_pop(v) FILTER (side = 'ref') / count(*) FILTER (side = 'ref') + var_pop(v) FILTER (side = 'cur') / count(*) FILTER (side = 'cur')), 6) AS z FROM h GROUP BY c""",
    "wap_gate": f"""WITH b AS (SELECT min(value) AS lo, max(value) AS hi, count(*) FILTER (ts < TIMESTAMP '{SPLIT}') AS nr, count(*) FILTER (ts >= TIMESTAMP '{SPLIT}') AS nc FROM events),
        k AS (SELECT least(floor((value - lo) / ((hi - lo) / 10)), 9) AS k, count(*) FILTER (ts < TIMESTAMP '{SPLIT}') AS r, count(*) FILTER (ts >= TIMESTAMP '{SPLIT}') AS n FROM events, b GROUP BY 1),
        x AS (SELECT coalesce(r, 0) / nr + 1e-8 AS p, coalesce(n, 0) / nc + 1e-8 AS q FROM b CROSS JOIN range(10) g(i) LEFT JOIN k ON k.k = g.i) SELECT round(sum((q - p) * ln(q / p)), 6) AS psi, sum((q - p) * ln(q / p)) < 0.2 AS published FROM x""",
    "mmd_rbf": "WITH e AS (SELECT embedding::DOUBLE[] AS v, CASE label WHEN 0 THEN 1 ELSE -1 END AS s, count(*) OVER (PARTITION BY label) AS n FROM embeddings WHERE label IN (0, 1)) SELECT round(greatest(0, sum(a.s * b.s * exp(-0.05 * pow(list_distance(a.v, b.v), 2)) / (a.n * b.n))), 6)::DOUBLE AS mmd FROM e a, e b",
    "rolling_zscore": """WITH z AS (SELECT event_id, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS k, avg(value) OVER w AS m, stddev_pop(value) OVER w AS sd FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))
        SELECT event_id, CASE WHEN k <= 50 OR sd = 0 THEN 0 ELSE round(abs(v - m) / sd, 6) END AS score, CASE WHEN k <= 50 OR sd = 0 THEN false ELSE abs(v - m) / sd > 3 END AS is_anomaly FROM z""",
    "spc_weco": f"""WITH {_DAY}, b AS (SELECT event_type, avg(v) AS m, greatest(1e-8, stddev_samp(v)) AS sd FROM daily WHERE day < DATE '2024-01-16' GROUP BY 1), z AS (SELECT event_type, day, (v - m) / sd AS z FROM daily JOIN b USING (event_type)),
        r AS (SELECT *, count(*) OVER w3 AS n3, count(*) OVER w5 AS n5, count(*) OVER w8 AS n8, sum((z > 2)::INT) OVER w3 AS u2, sum((z < -2)::INT) OVER w3 AS d2, sum((z > 1)::INT) OVER w5 AS u1, sum((z < -1)::INT) OVER w5 AS d1, sum((z > 0)::INT) OVER w8 AS u0, sum((z < 0)::INT) OVER w8 AS d0 FROM z
        WINDOW w3 AS (PARTITION BY event_type ORDER BY day ROWS 2 PRECEDING), w5 AS (PARTITION BY event_type ORDER BY day ROWS 4 PRECEDING), w8 AS (PARTITION BY event_type ORDER BY day ROWS 7 PRECEDING))
        SELECT event_type, day, round(z, 6) AS z, CASE WHEN abs(z) > 3 THEN 1 WHEN n3 = 3 AND greatest(u2, d2) >= 2 THEN 2 WHEN n5 = 5 AND greatest(u1, d1) >= 4 THEN 3 WHEN n8 = 8 AND greatest(u0, d0) >= 8 THEN 4 ELSE 0 END AS rule FROM r""",
    "cusum": f"""WITH RECURSIVE {_DAY}, o AS (SELECT event_type, day, (v - 100) / 40 AS z, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k FROM daily),
        s AS (SELECT event_type, k, day, CASE WHEN greatest(0, z - 0.5) > 5 THEN 0 ELSE greatest(0, z - 0.5) END::DOUBLE AS hi, CASE WHEN greatest(0, -z - 0.5) > 5 THEN 0 ELSE greatest(0, -z - 0.5) END::DOUBLE AS lo, CASE WHEN z - 0.5 > 5 THEN 1 WHEN -z - 0.5 > 5 THEN -1 ELSE 0 END AS alarm FROM o WHERE k = 1
        UNION ALL SELECT o.event_type, o.k, o.day, CASE WHEN greatest(0, hi + z - 0.5) > 5 THEN 0 ELSE greatest(0, hi + z - 0.5) END, CASE WHEN greatest(0, lo - z - 0.5) > 5 THEN 0 ELSE greatest(0, lo - z - 0.5) END, CASE WHEN hi + z - 0.5 > 5 THEN 1 WHEN lo - z - 0.5 > 5 THEN -1 ELSE 0 END FROM s JOIN o ON o.event_type = s.event_type AND o.k = s.k + 1)
        SELECT event_type, day::VARCHAR AS day, round(hi, 6) AS hi, round(lo, 6) AS lo, alarm FROM s""",
    "ensemble_vote": f"""WITH {_DAY}, z AS (SELECT event_type, day, v, row_number() OVER (PARTITION BY event_type ORDER BY day) AS k, avg(v) OVER w AS m, stddev_pop(v) OVER w AS sd FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)),
        x AS (SELECT event_type, day, v, CASE WHEN k <= 7 OR sd = 0 THEN 0 ELSE abs(v - m) / sd END AS sc FROM z), y AS (SELECT event_type, day, (sc > 2)::INT + (v > 120)::INT + (v < 80)::INT AS n, (sc + 2 * v / 100 + 0.5 * v / 200) / 3.5 AS ws FROM x)
        SELECT event_type, day, n / 3 > 0.5 AS majority, round(ws, 6)::DOUBLE AS weighted_score, n > 0 AS any_vote, n = 3 AS all_votes, round(n / 3, 6) AS share FROM y""",
    "holt_forecast": """WITH RECURSIVE m AS (SELECT o_orderstatus, date_trunc('month', o_orderdate) AS m, round(sum(o_totalprice) / 1e6, 6) AS v FROM orders GROUP BY ALL), o AS (SELECT o_orderstatus, v, row_number() OVER (PARTITION BY o_orderstatus ORDER BY m) AS k FROM m),
        s AS (SELECT a.o_orderstatus, 1::BIGINT AS k, a.v AS l, b.v - a.v AS t, 0::DOUBLE AS sse FROM o a JOIN o b ON a.o_orderstatus = b.o_orderstatus AND a.k = 1 AND b.k = 2
        UNION ALL SELECT o_orderstatus, k, nl, 0.1 * (nl - l) + 0.9 * t, sse + (v - nl) * (v - nl) FROM (SELECT s.o_orderstatus, o.k, o.v, s.l, s.t, s.sse, 0.3 * o.v + 0.7 * (s.l + s.t) AS nl FROM s JOIN o ON o.o_orderstatus = s.o_orderstatus AND o.k = s.k + 1)),
        f AS (SELECT o_orderstatus, max_by(l, k) AS l, max_by(t, k) AS t, max_by(sse, k) AS sse, max(k) AS n FROM s GROUP BY 1)
        SELECT o_orderstatus, h::INT AS h, round(greatest(0, l + h * t), 4) AS forecast, round(greatest(0, l + h * t - 1.96 * sqrt(sse / n) * sqrt(h)), 4) AS lo, round(greatest(0, l + h * t + 1.96 * sqrt(sse / n) * sqrt(h)), 4) AS hi FROM f, range(1, 7) g(h)""",
    "burn_rate": """WITH e AS (SELECT event_type, (value < 250)::INT AS g, ts, max(ts) OVER () AS now FROM events), s AS (SELECT event_type, count(*) AS n, """
    + ", ".join(f"coalesce(avg(1 - g) FILTER (ts > now - INTERVAL {h} HOUR), 0) / (1 - 0.9::DOUBLE) AS b{h}" for h in (1, 6, 72))
    + " , avg(1 - g) AS er FROM e GROUP BY 1) SELECT event_type AS service, n, round(b1, 6) AS burn_1h, round(b6, 6) AS burn_6h, round(b72, 6) AS burn_72h, round(er, 6) AS error_rate, round(least(1 - 0.9::DOUBLE, er), 6) AS consumed, er <= 1 - 0.9::DOUBLE AS compliant_raw, CASE WHEN b1 >= 14.4 THEN 'page_fast' WHEN b6 >= 6 THEN 'page_slow' WHEN b72 >= 3 THEN 'ticket' ELSE 'ok' END AS alert FROM s",
    "lineage_hops": """WITH RECURSIVE e AS (SELECT r_name AS src, n_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT n_name, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
        h AS (SELECT DISTINCT src AS id, 0 AS hops FROM e WHERE src IN (SELECT r_name FROM region WHERE r_name < 'B') UNION SELECT dst, hops + 1 FROM h JOIN e ON h.id = e.src WHERE hops < 10) SELECT id, min(hops)::INT AS hops FROM h GROUP BY id""",
    "sliding_windows": f"WITH {_DAY}, o AS (SELECT event_type, v, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n, max(v) OVER w AS top, count(*) OVER w AS c FROM daily WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)) SELECT event_type, i::INT AS start, c::INT AS n, round(top, 6) AS top FROM o WHERE i % 3 = 0 AND i < n - 7",
}
