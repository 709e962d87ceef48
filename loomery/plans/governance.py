"""Queries on contracts, audits, drift decisions, monitors and reviews, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import audit, contracts, drift, monitoring, profile, review
from loomery.session import table

SHIP_SPLIT = "1995-06-17"


def _r(df, places: int, *cols: str):
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def contract_validation(s, d):
    R = contracts.Rule
    rules = [
        R("o_orderkey", "integer", False), R("o_orderstatus", "string", False, allowed=["F", "O"]), R("o_totalprice", "float", True, low=1000, high=400000),
        R("o_orderpriority", "string", True, low=1), R("o_gone", "string"),
    ]
    return contracts.validate(table(s, d, "orders"), rules)


def schema_registry(s, d):
    orders = profile.infer_contract(table(s, d, "orders"))
    known = contracts.register(s.createDataFrame([], contracts.REGISTRY), "orders", orders)
    less = orders.filter("column <> 'o_orderstatus'")
    known = contracts.register(known, "orders", less, allow_breaking=True)
    known = contracts.register(known, "orders", less.unionByName(s.createDataFrame([("o_note", "string", True)], "column string, dtype string, nullable boolean")))
    return contracts.versions(known)


def security_audit(s, d):
    fields = ["prediction", "raw_score"]
    return audit.run_audit(table(s, d, "customer"), ["c_acctbal"], ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "c_mktsegment", fields)


def _shipped(s, d):
    names = ["l_quantity", "l_extendedprice", "l_linenumber"]
    rows = table(s, d, "lineitem").withColumn("side", F.when(F.col("l_shipdate") < F.lit(SHIP_SPLIT).cast("timestamp"), "ref").otherwise("cur"))
    return rows.select("side", *[F.col(c).cast("double") for c in names]).unpivot("side", names, "column", "value")


def extended_drift(s, d):
    return _r(monitoring.extended_drift(_shipped(s, d)), 5, "wasserstein", "js", "chi2", "p_value")


def _halves(s, d):
    return table(s, d, "events").select(F.when(F.col("ts") < F.lit("2024-01-16").cast("timestamp"), "ref").otherwise("cur").alias("side"), F.col("event_type").alias("column"), "value")


def retraining_decision(s, d):
    return _r(monitoring.retraining_decision(drift.psi_quantile(_halves(s, d), ["column"]), 0.86, 0.79), 6, "max_psi")


def drift_alert(s, d):
    return _r(monitoring.drift_alert(drift.drift_report(_halves(s, d)), "ok"), 6, "max_psi")


def prediction_drift(s, d):
    e = table(s, d, "events").withColumn("p", F.col("value") / 500)
    return _r(monitoring.prediction_drift(monitoring.monitor_windows(e, "event_type", ["ts", "event_id"], "p"), "event_type"), 6, "psi", "z", "rate_delta")


def prediction_stats(s, d):
    e = table(s, d, "events").withColumn("p", F.col("value") / 500)
    return _r(monitoring.prediction_stats(e, ["event_type"], "p"), 6, "mean", "std", "min", "max", "positive_rate")


def kernel_drift(s, d):
    e = table(s, d, "embeddings").withColumnRenamed("vec_id", "id")
    a, b = e.filter("label = 0"), e.filter("label = 1")
    gamma = monitoring.median_gamma(a, b, "embedding")
    null = monitoring.null_distribution(a, "embedding", gamma, 5)
    return _r(monitoring.kernel_drift("mmd", null, drift.mmd_rbf(a, b, "embedding", gamma)), 6, "statistic", "threshold")


def _comments(s, d):
    c = table(s, d, "conversations")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("suggestion", "minor", "major", "critical")]), (F.pmod(F.col("conv_id") * 3 + F.col("turn") * 5, F.lit(11)) % 4 + 1).cast("int"))
    return c.filter("role = 'assistant'").select("conv_id", "text", kind.alias("severity"), F.when(F.pmod(F.col("conv_id") + F.col("turn"), F.lit(9)) == 0, "security").otherwise("style").alias("category"))


def review_routing(s, d):
    return _r(review.route_reviews(_comments(s, d), "conv_id", "severity", "category"), 6, "risk_score", "confidence")


def _verdicts(s, d):
    c = table(s, d, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    words = F.filter(F.split(F.lower("q"), "[^a-z]+"), lambda w: F.length(w) >= 5)
    examples = c.select("conv_id", F.when(F.col("conv_id") % 3 > 0, words).alias("keywords"))
    return review.lexical_judge(examples, _comments(s, d), "conv_id", "keywords", "text", "severity")


def review_judgement(s, d):
    return _r(_verdicts(s, d), 6, "faithfulness", "helpfulness", "false_positive_rate", "overall_score")


def review_regression(s, d):
    v = _verdicts(s, d).withColumn("domain", F.when(F.col("conv_id") % 2 == 0, "even").otherwise("odd"))
    return _r(review.regression_report(v, "domain", 0.4), 5, "faithfulness", "helpfulness", "false_positive_rate", "overall_score")


QUERIES = {
    "contract_validation": contract_validation, "contract_summary": lambda s, d: contracts.summary(contract_validation(s, d)), "schema_registry": schema_registry, "security_audit": security_audit,
    "security_score": lambda s, d: profile.audit_score(security_audit(s, d)), "extended_drift": extended_drift, "extended_drift_summary": lambda s, d: monitoring.batch_summary(extended_drift(s, d)),
    "retraining_decision": retraining_decision, "drift_alert": drift_alert, "prediction_drift": prediction_drift, "prediction_stats": prediction_stats, "kernel_drift": kernel_drift,
    "review_routing": review_routing, "review_judgement": review_judgement, "review_regression": review_regression,
}

_CHECKS = """SELECT 'o_orderkey' AS "column", 'column_exists' AS "check", true AS passed, 0 AS violations
  UNION ALL SELECT 'o_orderkey', 'nullable', count(*) FILTER (o_orderkey IS NULL) = 0, count(*) FILTER (o_orderkey IS NULL) FROM orders
  UNION ALL SELECT 'o_orderstatus', 'column_exists', true, 0
  UNION ALL SELECT 'o_orderstatus', 'nullable', count(*) FILTER (o_orderstatus IS NULL) = 0, count(*) FILTER (o_orderstatus IS NULL) FROM orders
  UNION ALL SELECT 'o_orderstatus', 'allowed_values', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
  UNION ALL SELECT 'o_totalprice', 'column_exists', true, 0 UNION ALL SELECT 'o_totalprice', 'nullable', true, 0
  UNION ALL SELECT 'o_totalprice', 'value_range', count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) = 0, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) FROM orders
  UNION ALL SELECT 'o_orderpriority', 'column_exists', true, 0 UNION ALL SELECT 'o_orderpriority', 'nullable', true, 0 UNION ALL SELECT 'o_orderpriority', 'value_range', true, 0
  UNION ALL SELECT 'o_gone', 'column_exists', false, 1"""
_AUDIT = """WITH c AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) - 1 AS i, count(*) OVER () AS n FROM customer), q AS (SELECT max(x) FILTER (i = n // 4) AS q1, max(x) FILTER (i = 3 * n // 4) AS q3 FROM c),
  o AS (SELECT avg((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT) AS r FROM c, q),
  u AS (SELECT 'c_custkey' AS c, count(DISTINCT c_custkey) / count(*) AS r FROM customer UNION ALL SELECT 'c_name', count(DISTINCT c_name) / count(*) FROM customer UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) / count(*) FROM customer UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment) / count(*) FROM customer),
  m AS (SELECT string_agg(c, ',' ORDER BY c) AS a FROM u WHERE r > 0.95), l AS (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment), t AS (SELECT sum(n) AS t, count(*) AS k FROM l), e AS (SELECT -sum(n / t * log2(n / t)) / log2(max(k)) AS e FROM l, t),
  f AS (SELECT 'input_manipulation' AS risk, 'high' AS severity, 'c_acctbal' AS affected FROM o WHERE r > 0.15 UNION ALL SELECT 'data_poisoning', 'high', 'label' FROM e WHERE e < 0.3 UNION ALL SELECT 'membership_inference', 'medium', a FROM m WHERE a IS NOT NULL
  UNION ALL SELECT 'model_inversion', 'medium', 'raw_score' UNION ALL SELECT 'model_theft', 'high', '' UNION ALL SELECT 'output_integrity', 'low', '')"""
_LONG = f"""h AS (SELECT CASE WHEN l_shipdate < TIMESTAMP '{SHIP_SPLIT}' THEN 'ref' ELSE 'cur' END AS side, unnest(['l_quantity', 'l_extendedprice', 'l_linenumber']) AS c, unnest([l_quantity::DOUBLE, l_extendedprice::DOUBLE, l_linenumber::DOUBLE]) AS v FROM lineitem)"""
_GRID = "[" + ", ".join(repr(i / 999) for i in range(1000)) + "]"
_EXTENDED = f"""WITH {_LONG}, k AS (SELECT c, CASE WHEN count(DISTINCT v) <= 20 THEN 'categorical' ELSE 'continuous' END AS kind, stddev_pop(v) AS sd FROM h WHERE side = 'ref' GROUP BY c),
  q AS (SELECT c, side, quantile_cont(v, {_GRID}) AS q FROM h GROUP BY c, side),
  w AS (SELECT a.c, round(list_sum(list_transform(list_zip(a.q, b.q), lambda x: abs(x[1] - x[2]))) / 1000, 6) AS w FROM q a JOIN q b ON a.c = b.c AND a.side = 'ref' AND b.side = 'cur'),
  b AS (SELECT c, min(v) AS lo, max(v) AS hi, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM h GROUP BY c),
  p AS (SELECT h.c, least(floor((v - lo) / ((hi - lo) / 20)), 19) AS k, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h JOIN b USING (c) GROUP BY ALL),
  x AS (SELECT b.c, (coalesce(r, 0) / nr + 1e-10) / (1 + 20e-10) AS p, (coalesce(n, 0) / nc + 1e-10) / (1 + 20e-10) AS q FROM b CROSS JOIN range(20) g(i) LEFT JOIN p ON p.c = b.c AND p.k = g.i),
  j AS (SELECT c, round(sum(p * ln(p / ((p + q) / 2)) + q * ln(q / ((p + q) / 2))) / (2 * ln(2)), 6) AS js FROM x GROUP BY c),
  ce AS (SELECT c, v, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h GROUP BY ALL), ex AS (SELECT c, n, r / sum(r) OVER (PARTITION BY c) * sum(n) OVER (PARTITION BY c) AS e FROM ce),
  ch AS (SELECT c, sum((n - e) * (n - e) / e) AS chi2 FROM ex WHERE e >= 1 GROUP BY c),
  a AS (SELECT k.c, kind, CASE WHEN kind = 'continuous' THEN w END AS w, js, CASE WHEN kind = 'categorical' THEN chi2 END AS chi2, CASE WHEN kind = 'categorical' THEN exp(-chi2 / 2) * (1 + chi2 / 2 + chi2 * chi2 / 8) END AS p, sd FROM k JOIN w USING (c) JOIN j USING (c) JOIN ch USING (c)),
  s AS (SELECT *, CASE WHEN kind = 'continuous' THEN CASE WHEN w / sd < 0.05 THEN 0 WHEN w / sd < 0.15 THEN 1 ELSE 2 END ELSE (p < 0.05)::INT END AS s1, CASE WHEN js < 0.05 THEN 0 WHEN js < 0.1 THEN 1 ELSE 2 END AS s2 FROM a),
  o AS (SELECT c AS "column", kind AS feature_type, round(w, 5) AS wasserstein, round(js, 5) AS js, round(chi2, 5)::DOUBLE AS chi2, round(p, 5)::DOUBLE AS p_value, CASE WHEN greatest(s1, s2) = 0 THEN 'ok' WHEN greatest(s1, s2) = 2 THEN 'critical' WHEN s1 = 1 AND kind = 'categorical' THEN 'drift' ELSE 'moderate' END AS severity, ((s1 > 0)::INT + (s2 > 0)::INT) / 2 AS confidence, s1 + s2 > 0 AS drift_detected FROM s)"""
_H = "h AS (SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'ref' ELSE 'cur' END AS side, event_type AS c, value AS v FROM events)"
_PSI = f"""{_H}, b AS (SELECT c, min(v) AS lo, max(v) AS hi, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM h GROUP BY c),
  k AS (SELECT h.c, least(floor((v - lo) / ((hi - lo) / 10)), 9) AS k, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h JOIN b USING (c) GROUP BY ALL),
  x AS (SELECT b.c, coalesce(r, 0) / nr + 1e-8 AS p, coalesce(n, 0) / nc + 1e-8 AS q FROM b CROSS JOIN range(10) g(i) LEFT JOIN k ON k.c = b.c AND k.k = g.i), psi AS (SELECT c, sum((q - p) * ln(q / p)) AS psi FROM x GROUP BY c),
  s AS (SELECT c, v, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h GROUP BY ALL), f AS (SELECT c, abs(sum(r) OVER w / sum(r) OVER (PARTITION BY c) - sum(n) OVER w / sum(n) OVER (PARTITION BY c)) AS g FROM s WINDOW w AS (PARTITION BY c ORDER BY v)),
  ks AS (SELECT c, max(g)::DOUBLE AS ks FROM f GROUP BY c), l AS (SELECT c, ks, sqrt(nr * nc / (nr + nc)) * ks AS l FROM ks JOIN b USING (c)),
  rep AS (SELECT c AS "column", psi, ks, CASE WHEN l < 0.2 THEN 1 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 51), lambda k: (CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END) * exp(-2.0 * k * k * l * l))))) END::DOUBLE AS p_value FROM psi JOIN l USING (c))"""
DRIFT_REPORT = f"""WITH {_PSI} SELECT "column", round(psi, 6) AS psi, round(ks, 6) AS ks, round(p_value, 6) AS p_value, psi >= 0.1 OR p_value < 0.05 AS drifted, CASE WHEN psi < 0.1 THEN 'ok' WHEN psi < 0.25 THEN 'moderate' ELSE 'critical' END AS severity FROM rep"""
_QUANTILE_PSI = f"""{_H}, e AS (SELECT c, list_sort(list_distinct(quantile_cont(v, [{', '.join(str(i / 10) for i in range(11))}]))) AS e FROM h WHERE side = 'ref' GROUP BY c), n AS (SELECT c, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM h GROUP BY c),
  k AS (SELECT h.c, least(len(list_filter(e, lambda x: x <= v)), len(e) - 1) AS k, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS m FROM h JOIN e USING (c) WHERE v >= e[1] AND v <= e[-1] GROUP BY ALL),
  g AS (SELECT c, unnest(range(1, len(e))) AS k FROM e), x AS (SELECT c, coalesce(r, 0) / (nr + 1e-6) + 1e-6 AS p, coalesce(m, 0) / (nc + 1e-6) + 1e-6 AS q FROM g LEFT JOIN k USING (c, k) JOIN n USING (c)), y AS (SELECT c, sum((q - p) * ln(q / p)) AS psi FROM x GROUP BY c)"""
_CONV = """c AS (SELECT conv_id, text, ['suggestion', 'minor', 'major', 'critical'][(conv_id * 3 + turn * 5) % 11 % 4 + 1] AS severity, CASE WHEN (conv_id + turn) % 9 = 0 THEN 'security' ELSE 'style' END AS category FROM conversations WHERE role = 'assistant')"""
_HAS = lambda words: " OR ".join(f"contains(t, '{w}')" for w in words.split())
_VERDICTS = f"""{_CONV}, ex AS (SELECT conv_id, CASE WHEN conv_id % 3 > 0 THEN list_filter(regexp_split_to_array(lower(min_by(text, turn)), '[^a-z]+'), lambda w: length(w) >= 5) ELSE [] END AS k FROM conversations WHERE role = 'user' GROUP BY conv_id),
  cm AS (SELECT conv_id, lower(text) AS t, severity FROM c WHERE NOT (contains(lower(text), 'api_key') OR contains(lower(text), 'api key not set'))),
  ju AS (SELECT ex.conv_id, len(k) = 0 AS is_clean, count(t) AS n, count(*) FILTER ({_HAS('should fix change replace use avoid remove add consider refactor switch instead recommend suggest prefer')}) AS help, count(*) FILTER (severity IN ('critical', 'major')) AS high, count(*) FILTER (t IS NOT NULL AND len(list_filter(k, lambda w: contains(t, w))) > 0) AS hit FROM ex LEFT JOIN cm USING (conv_id) GROUP BY ex.conv_id, k),
  ve AS (SELECT conv_id, is_clean, n, CASE WHEN n = 0 THEN is_clean::INT WHEN is_clean THEN 1 - high / n ELSE hit / n END::DOUBLE AS f, CASE WHEN n = 0 THEN is_clean::INT ELSE help / n END::DOUBLE AS h FROM ju),
  v AS (SELECT conv_id, is_clean, n, f, h, CASE WHEN n = 0 THEN 0 ELSE 1 - f END AS x FROM ve), vo AS (SELECT *, 0.4 * f + 0.3 * h + 0.3 * (1 - x) AS o FROM v)"""

SQL = {
    "contract_validation": _CHECKS,
    "contract_summary": f"SELECT bool_and(passed) AS passed, count(*) AS total_checks, count(*) FILTER (passed) AS passed_checks, count(*) FILTER (NOT passed) AS failed_checks FROM ({_CHECKS})",
    "schema_registry": "SELECT * FROM (SELECT 'orders' AS name, '1.0.0' AS version, count(*) AS n_columns, false AS is_latest FROM (DESCRIBE orders) UNION ALL SELECT 'orders', '2.0.0', count(*) - 1, false FROM (DESCRIBE orders) UNION ALL SELECT 'orders', '2.1.0', count(*), true FROM (DESCRIBE orders))",
    "security_audit": _AUDIT + " SELECT * FROM f",
    "security_score": _AUDIT + " SELECT greatest(0, 100 - sum(CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 20 WHEN 'medium' THEN 10 ELSE 5 END))::BIGINT AS score FROM f",
    "extended_drift": _EXTENDED + " SELECT * FROM o",
    "extended_drift_summary": _EXTENDED + """ SELECT count(*) AS columns_checked, count(*) FILTER (drift_detected) AS columns_with_drift, coalesce(string_agg("column", ',' ORDER BY "column") FILTER (severity = 'critical'), '') AS critical_columns, bool_or(drift_detected) AS overall_drift FROM o""",
    "retraining_decision": f"WITH {_QUANTILE_PSI} SELECT round(max(psi), 6) AS max_psi, coalesce(string_agg(c, ',' ORDER BY c) FILTER (psi >= 0.2), '') AS drifted, bool_or(psi >= 0.2) AS has_drift, true AS degraded, true AS retrain, CASE WHEN bool_or(psi >= 0.2) THEN 'drift; performance' ELSE 'performance' END AS reason FROM y",
    "drift_alert": f"""WITH {_PSI}, z AS (SELECT *, psi >= 0.1 OR p_value < 0.05 AS d FROM rep) SELECT round(max(psi), 6) AS max_psi, count(*) AS columns_checked, count(*) FILTER (d) AS columns_with_drift, coalesce(string_agg("column", ',' ORDER BY "column") FILTER (d), '') AS features, CASE WHEN max(psi) >= 0.25 THEN 'critical' WHEN max(psi) >= 0.1 THEN 'warning' ELSE 'ok' END AS severity FROM z""",
    "prediction_drift": """WITH r AS (SELECT event_type, value / 500 AS p, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS j, count(*) OVER (PARTITION BY event_type) AS n FROM events),
  h AS (SELECT event_type AS c, 'ref' AS side, p AS v FROM r WHERE i <= 200 AND n >= 200 UNION ALL SELECT event_type, 'cur', p FROM r WHERE j <= 1000 AND n >= 200),
  k AS (SELECT c, least(floor(greatest(0, least(1, v)) * 10), 9) AS k, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS n FROM h GROUP BY ALL), t AS (SELECT c, sum(r) AS nr, sum(n) AS nc FROM k GROUP BY c),
  x AS (SELECT t.c, (coalesce(r, 0) / nr + 1e-6) / (1 + 1e-5) AS p, (coalesce(n, 0) / nc + 1e-6) / (1 + 1e-5) AS q FROM t CROSS JOIN range(10) g(i) LEFT JOIN k ON k.c = t.c AND k.k = g.i), y AS (SELECT c, sum((q - p) * ln(q / p)) AS psi FROM x GROUP BY c),
  z AS (SELECT c, (avg(v) FILTER (side = 'cur') - avg(v) FILTER (side = 'ref')) / sqrt(var_pop(v) FILTER (side = 'ref') / 200 + var_pop(v) FILTER (side = 'cur') / count(*) FILTER (side = 'cur')) AS z, abs(avg((v > 0.5)::INT) FILTER (side = 'cur') - avg((v > 0.5)::INT) FILTER (side = 'ref')) AS d FROM h GROUP BY c)
  SELECT c AS event_type, round(psi, 6) AS psi, round(z, 6) AS z, round(d, 6) AS rate_delta, CASE WHEN psi >= 0.2 THEN 'critical' WHEN psi >= 0.1 OR abs(z) > 3 THEN 'warning' ELSE 'ok' END AS severity, psi >= 0.1 OR abs(z) > 3 AS has_drift FROM y JOIN z USING (c)""",
    "prediction_stats": "SELECT event_type, count(value) AS n, round(avg(value / 500), 6) AS mean, round(stddev_pop(value / 500), 6) AS std, round(min(value / 500), 6) AS min, round(max(value / 500), 6) AS max, round(avg((value / 500 > 0.5)::INT), 6) AS positive_rate FROM events GROUP BY 1",
    "review_routing": f"""WITH {_CONV}, r AS (SELECT conv_id, least(100, sum(CASE severity WHEN 'critical' THEN 10 WHEN 'major' THEN 4 WHEN 'minor' THEN 1 ELSE 0.3 END))::DOUBLE AS risk, count(*) FILTER (severity = 'critical' OR category = 'security') AS e, count(*) AS n FROM c GROUP BY 1),
  f AS (SELECT *, CASE WHEN risk <= 0.5 THEN 0.5 + 0.5 * (1 - risk / 0.5) WHEN risk >= 8 THEN least(1, 0.5 + 0.5 * (risk - 8) / 8) ELSE 0.1 + 0.4 * abs(risk - 4.25) / 3.75 END AS s FROM r)
  SELECT conv_id, round(risk, 6) AS risk_score, e AS escalations, n AS n_comments, CASE WHEN e > 0 OR risk >= 8 THEN 'auto_reject' WHEN risk <= 0.5 THEN 'auto_approve' ELSE 'human_review' END AS decision, round(CASE WHEN e > 0 THEN least(1, s + 0.3) ELSE s END, 6)::DOUBLE AS confidence FROM f""",
    "review_judgement": f"WITH {_VERDICTS} SELECT conv_id, is_clean, n, round(f, 6) AS faithfulness, round(h, 6) AS helpfulness, round(x, 6)::DOUBLE AS false_positive_rate, round(o, 6)::DOUBLE AS overall_score FROM vo",
    "review_regression": f"WITH {_VERDICTS}, g AS (SELECT *, CASE WHEN conv_id % 2 = 0 THEN 'even' ELSE 'odd' END AS domain FROM vo) SELECT domain, count(*) AS n, round(avg(f), 5) AS faithfulness, round(avg(h), 5) AS helpfulness, round(avg(x), 5)::DOUBLE AS false_positive_rate, round(avg(o), 5)::DOUBLE AS overall_score, avg(o) >= 0.4 AS passed FROM g GROUP BY ROLLUP (domain)",
}
