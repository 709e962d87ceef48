"""Queries on experiments, model decisions, survival, recommendation measures, graph features and lineage, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import centrality, decisions, detection, experiment, features, lineage, quality_control, recommending, recsys, survival
from loomery.operators import graph as J
from loomery.plans.texts import _G, _edges, _graph, _written_graph
from loomery.session import table


def _r(df, places: int, *cols: str):
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def experiment_decision(s, d):
    c = table(s, d, "customer").select(experiment.route(F.col("c_custkey"), [("a", 0.5), ("b", 0.5)]).alias("variant"), ((F.col("c_acctbal") + 1000) / 11000).alias("p"))
    return _r(decisions.experiment_decision(c, "variant", "p", "a", "b").drop("p_value_prob"), 6, "p_value_rate")


def welch_t(s, d):
    c = table(s, d, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "a").otherwise("b").alias("g"), "c_acctbal")
    return _r(decisions.welch_t(c, "g", "c_acctbal", "a", "b").drop("p_value"), 6, "t", "dof")


def _uplift(s, d):
    c = table(s, d, "customer").select("c_custkey", ((F.col("c_acctbal") + 1000) / 11000).alias("p_t"), (F.col("c_custkey") % 97 / 97.0).alias("p_c"))
    return c.withColumns({"cate": F.col("p_t") - F.col("p_c"), "segment": decisions.uplift_segment(F.col("p_t"), F.col("p_c"))})


def uplift_summary(s, d):
    return _r(decisions.uplift_summary(_uplift(s, d), "cate", "segment"), 6, "avg_cate", "targeting_uplift")


def qini_coefficient(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), (F.pmod("c_custkey", F.lit(2)) == 1).cast("int").alias("t"))
    return _r(decisions.qini_coefficient(c, "score", "y", "t", "c_custkey"), 6, "qini", "auuc", "random_auuc")


def _scored(s, d):
    return table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang"), "doc_id").select("lang", "quality", (F.pmod(F.col("doc_id") * 7, F.lit(128)) / 128.0).alias("p"))


def equal_thresholds(s, d):
    return decisions.equal_thresholds(_scored(s, d), "lang", "quality", "p")


def binary_metrics(s, d):
    return _r(decisions.binary_metrics(_scored(s, d), ["lang"], "quality", "p"), 6, "f1_score", "precision", "recall", "roc_auc")


def model_leaderboard(s, d):
    m = binary_metrics(s, d).withColumnRenamed("lang", "model")
    return _r(decisions.leaderboard(m, "model"), 5, "roc_auc", "f1_score", "auc_margin").select("model", "rank", "roc_auc", "f1_score", "auc_margin", "is_significant")


def regression_metrics(s, d):
    p = table(s, d, "part")
    mean = p.groupBy("p_brand").agg(F.avg("p_retailprice").alias("pred"))
    return _r(decisions.regression_metrics(p.join(mean, "p_brand"), "p_retailprice", "pred"), 5, "r2", "rmse", "mae", "mape")


def interval_coverage(s, d):
    p = table(s, d, "part").select((F.col("p_retailprice") - 150).alias("lo"), (F.col("p_retailprice") + 20 - F.col("p_size") * 3).alias("hi"), "p_retailprice")
    return _r(decisions.interval_coverage(p, "lo", "hi", "p_retailprice", 12.5), 6, "coverage", "mean_width")


def monthly_cost(s, d):
    e = table(s, d, "events").groupBy("event_type").agg((F.count(F.lit(1)) / 100.0).alias("rps"))
    return decisions.monthly_cost(e, "rps")


def batch_size(s, d):
    e = table(s, d, "events").groupBy("event_type", (F.col("user_id") % 5 + 1).alias("batch")).agg(F.round(F.avg("value"), 6).alias("latency"))
    return decisions.best_batch(e, ["event_type"], "batch", "latency", 110.0)


def investment_analysis(s, d):
    rates = table(s, d, "part").filter("p_brand <> 'Brand#11'").groupBy("p_brand").agg((F.round(F.avg("p_retailprice"), 4) / 7000).alias("rate"))
    p = decisions.market_rent(table(s, d, "part").select("p_partkey", "p_brand", "p_size", "p_retailprice"), "p_brand", "p_size", rates, "rate")
    cols = ["rent", "gross_yield_pct", "net_yield_pct", "payback_years", "monthly_cashflow", "recovery_months"]
    out = _r(decisions.investment(p, "p_retailprice", "rent"), 4, *cols[1:])
    return _r(out, 9, "rent").select("p_partkey", *cols, "verdict")  # a rate times a whole size: no tie at the ninth place


def _subjects(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), F.datediff("l_shipdate", "o_orderdate").alias("t"), (F.col("l_linestatus") == "F").cast("int").alias("e"), F.round(F.col("l_discount") * 10 - 0.5, 3).alias("h"))


def baseline_hazard(s, d):
    return _r(survival.baseline_hazard(_subjects(s, d), "t", "e", "h"), 6, "cumulative")


def survival_curves(s, d):
    x = _subjects(s, d)
    out = survival.survival_curves(x.select("h").distinct().withColumn("k", F.col("h")), "k", "h", survival.baseline_hazard(x, "t", "e", "h"), [0.5, 20.5, 60.25, 500.0])
    return _r(out, 6, "survival")


def median_survival(s, d):
    x = _subjects(s, d)
    return survival.median_survival(x, "k", "h", survival.baseline_hazard(x, "t", "e", "h"))


# -- recommendation ----------------------------------------------------------------------------------------------------
def _bought(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.col("o_custkey").alias("user"), F.col("l_partkey").alias("item"), F.col("l_quantity").alias("rating"), (F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp")).alias("early"))


def _recs(s, d):
    scores = _bought(s, d).filter("early").groupBy("user", "item").agg(F.sum("rating").cast("double").alias("score"))
    return recsys.top_k(scores, ["user"], [F.desc("score"), F.col("item")], 10)


def factor_recommend(s, d):
    n = F.broadcast(table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("n")))  # one row
    x = _bought(s, d).filter("early").crossJoin(n).select("user", (F.col("item") % F.col("n")).alias("item"), "rating").groupBy("user", "item").agg(F.sum("rating").alias("rating"))
    f = table(s, d, "embeddings").select(F.col("vec_id").alias("item"), "embedding")
    return recommending.factor_recommend(x, f, "user", "item", "rating", "embedding", 5, 3)


def ranking_measures(s, d):
    return _r(recommending.ranking_measures(_recs(s, d), _bought(s, d).filter("NOT early"), "user", "item", "rating", 10, 25.0), 6, "precision_at_k", "recall_at_k", "ndcg_at_k")


def debiased_ranking(s, d):
    out = recommending.debias_scores(_recs(s, d), recsys.propensities(_bought(s, d), "item"), "user", "item")
    return _r(out, 5, "score")


def ips_evaluation(s, d):
    relevant = _bought(s, d).filter("NOT early AND rating >= 25")
    cols = ["ndcg_standard", "ndcg_ips", "precision_standard", "precision_ips", "popularity_bias", "catalog_coverage"]
    return _r(recommending.ips_evaluation(_recs(s, d), relevant, recsys.propensities(_bought(s, d), "item"), "user", "item"), 6, *cols)


def list_diversity(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding", F.col("label").alias("q"), ((F.col("vec_id") * 37 % 101) / 101.0).alias("rel"))
    lists = recsys.top_k(e, ["q"], [F.desc("rel"), F.col("vec_id")], 8)
    return recommending.diversity(lists, "q", "vec_id", "embedding", recsys.top_k(e, ["q"], [F.desc("rel"), F.col("vec_id")], 1))


def linucb_recommend(s, d):
    e = table(s, d, "events").select("event_type", F.round(F.col("value") / 500, 4).alias("x0"), F.lit(1.0).alias("x1"), (F.col("user_id") % 2).cast("double").alias("r"))
    sums = recsys.linucb_statistics(e, "event_type", ["x0", "x1"], "r")
    asked = e.groupBy("event_type").agg(F.array(F.round(F.avg("x0"), 3), F.lit(1.0)).alias("context")).unionByName(s.createDataFrame([("new", [0.5, 1.0])], "event_type string, context array<double>"))
    return recommending.linucb_recommend(asked, sums, "event_type", "context", 0.7)


def preference_recommend(s, d):
    return recommending.preference_recommend(table(s, d, "part"), "p_partkey", ["p_brand", "p_size"], {"p_brand": "Brand#23", "p_size": "15"}, 20)


# -- graphs, lineage, series -------------------------------------------------------------------------------------------
def neighbourhood_features(s, d):
    n, e = _graph(s, d)
    fraud = n.filter("id % 10 = 0").withColumn("is_fraud", F.lit(1))
    return _r(centrality.neighbourhood_features(e, fraud), 6, "neighbor_fraud_ratio", "hub_proximity")


def risk_flags(s, d):
    n, e = _written_graph(s, d)
    rows = centrality.augment(n, "id", J.degrees(n, e), J.clustering(n, e).select("id", "clustering"))
    flags = centrality.centrality_flags(F.lit(0.0), F.round("in_centrality", 6), F.lit(0.0), F.col("clustering"), F.lit(0.0))
    levels = centrality.temporal_levels(rows.join(_r(J.temporal_features(_edges(s, d)).select("id", "burst", "concentration"), 6, "burst", "concentration"), "id"))
    return levels.select("id", flags.alias("flags"), "burst_level", "concentration_level")


def betweenness(s, d):
    return _r(centrality.betweenness(_graph(s, d)[1]), 6, "betweenness")


def _events(s, d):
    state = F.element_at(F.array(*[F.lit(x) for x in ("START", "COMPLETE", "FAIL")]), (F.col("event_id") % 3 + 1).cast("int"))
    return table(s, d, "events").select(
        F.col("event_id").cast("string").alias("event_id"), state.alias("event_type"), F.concat(F.lit("job-"), (F.col("user_id") % 7).cast("string")).alias("job"), F.concat(F.lit("run-"), (F.col("event_id") % 50).cast("string")).alias("run_id"),
        F.array(F.concat(F.lit("in-"), F.col("event_type"))).alias("inputs"), F.array(F.concat(F.lit("out-"), (F.col("user_id") % 11).cast("string"))).alias("outputs"), F.col("ts").cast("timestamp").alias("event_time"),
    )


def lineage_events(s, d):
    return lineage.get_events(_events(s, d), "job-3", "COMPLETE", 20).select("event_id", "run_id")


def compliance_report(s, d):
    e = table(s, d, "events")
    now = F.broadcast(e.agg(F.max("ts").alias("now")))  # one row
    rates = quality_control.burn_rates(e.crossJoin(now), "event_type", F.col("value") < 250, "ts", F.col("now"), 0.9)
    return lineage.compliance_report(rates.withColumnRenamed("compliant_raw", "compliant"))


def _metrics(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("h"), (F.col("user_id") % 3).alias("g")).agg(F.round(F.avg("value"), 6).alias("cpu"), F.count(F.lit(1)).cast("double").alias("requests"), F.round(F.max("value"), 6).alias("latency"))


def multi_metric(s, d):
    return _r(detection.multi_metric(_metrics(s, d), ["g"], ["h"], ["cpu", "latency", "requests"], 12, 2.5), 5, "score").select("g", "h", "score", "is_anomaly")


def detection_summary(s, d):
    return _r(detection.detection_summary(multi_metric(s, d), ["g"]), 5, "anomaly_rate", "max_score", "mean_score")


def metric_alerts(s, d):
    out = detection.alerts(detection.multi_metric(_metrics(s, d), ["g"], ["h"], ["cpu", "latency", "requests"], 12, 2.5), ["cpu", "latency", "requests"], 2.5)
    return out.select("g", "h", "metric_name", "metric_value", "severity")


def snapshot_anomalies(s, d):
    x = table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "value"))).alias("a"))
    x = x.select("user_id", F.transform("a", lambda v: v["value"]).alias("cpu"), F.transform("a", lambda v: F.round(v["value"] % 7, 3)).alias("latency"))
    return detection.snapshot_anomalies(x, ["cpu", "latency"], 2.0).select("user_id", "max_score", F.array_join("affected", ",").alias("affected"), "is_anomaly")


def dataset_stats(s, d):
    return features.class_balance(table(s, d, "documents"), "lang", "source")


def interaction_stats(s, d):
    return _r(features.interaction_stats(_bought(s, d), "user", "item", "rating"), 8, "sparsity", "mean_rating")


QUERIES = {
    "experiment_decision": experiment_decision, "welch_t": welch_t, "uplift_summary": uplift_summary, "qini_coefficient": qini_coefficient, "equal_thresholds": equal_thresholds, "binary_metrics": binary_metrics,
    "model_leaderboard": model_leaderboard, "regression_metrics": regression_metrics, "interval_coverage": interval_coverage, "monthly_cost": monthly_cost, "batch_size": batch_size, "investment_analysis": investment_analysis,
    "baseline_hazard": baseline_hazard, "survival_curves": survival_curves, "median_survival": median_survival, "factor_recommend": factor_recommend, "ranking_measures": ranking_measures, "debiased_ranking": debiased_ranking,
    "ips_evaluation": ips_evaluation, "list_diversity": list_diversity, "linucb_recommend": linucb_recommend, "preference_recommend": preference_recommend, "neighbourhood_features": neighbourhood_features, "risk_flags": risk_flags,
    "betweenness": betweenness, "lineage_events": lineage_events, "lineage_summary": lambda s, d: lineage.summary(_events(s, d)), "compliance_report": compliance_report, "multi_metric": multi_metric,
    "detection_summary": detection_summary, "metric_alerts": metric_alerts, "snapshot_anomalies": snapshot_anomalies, "dataset_stats": dataset_stats, "interaction_stats": interaction_stats,
    "category_cube": lambda s, d: features.cube_counts(table(s, d, "orders"), ["o_orderstatus", "o_orderpriority"]),
    "property_features": lambda s, d: features.property_features(table(s, d, "part").withColumn("built", 1950 + F.col("p_size")), "built", "p_retailprice", "p_size", F.col("p_size") % 2 == 1, 2026).select("p_partkey", "age", "unit_price", "has_garage"),
    "labelled_split": lambda s, d: features.labelled_split(table(s, d, "nation").withColumn("kind", F.col("n_nationkey") % 3), "n_nationkey", "kind"),
}

_ERFC = lambda x: f"((1 / (1 + 0.5 * ({x}))) * exp(-({x}) * ({x}) + list_reduce([0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]::DOUBLE[], lambda p, c: p * (1 / (1 + 0.5 * ({x}))) + c)))"
_UPLIFT = "u AS (SELECT c_custkey, (c_acctbal + 1000) / 11000 AS pt, c_custkey % 97 / 97.0::DOUBLE AS pc FROM customer), v AS (SELECT *, pt - pc AS cate, CASE WHEN pt - pc < -0.05 THEN 'persuadable' WHEN pt - pc > 0.05 THEN 'sleeping_dog' WHEN pc >= 0.5 THEN 'lost_cause' ELSE 'sure_thing' END AS segment FROM u)"
_SCORED = "x AS (SELECT lang, quality AS y, doc_id * 7 % 128 / 128.0::DOUBLE AS p FROM labels JOIN documents USING (doc_id))"
_METRICS = f"""{_SCORED}, r AS (SELECT lang, y, p, count(*) FILTER (y = 0) OVER (PARTITION BY lang ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, count(*) FILTER (y = 0) OVER (PARTITION BY lang, p) AS same FROM x),
  m AS (SELECT lang, sum(CASE WHEN y = 1 THEN upto - same / 2 END) / nullif(sum(y) * sum(1 - y), 0) AS auc, sum(y * (p >= 0.5)::INT) AS tp, sum((p >= 0.5)::INT) AS pp, sum(y) AS ps FROM r GROUP BY lang)"""
_HAZARD = """s AS (SELECT l_orderkey * 10 + l_linenumber AS k, date_diff('day', o_orderdate::DATE, l_shipdate::DATE)::DOUBLE AS t, (l_linestatus = 'F')::INT AS e, round(l_discount * 10 - 0.5, 3) AS h FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
  ti AS (SELECT t, sum(exp(h)) AS w, sum(e) AS d FROM s GROUP BY t), ri AS (SELECT t, d, sum(w) OVER (ORDER BY t DESC) AS r FROM ti), b AS (SELECT 0.0::DOUBLE AS t, 0.0::DOUBLE AS c UNION ALL SELECT t, sum(d / r) OVER (ORDER BY t) FROM ri WHERE d > 0)"""
_BOUGHT = """bo AS (SELECT o_custkey AS u, l_partkey AS i, l_quantity AS w, o_orderdate < TIMESTAMP '1996-01-01' AS early FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_RECS = f"""{_BOUGHT}, sc AS (SELECT u, i, sum(w)::DOUBLE AS score FROM bo WHERE early GROUP BY ALL), rk AS (SELECT *, row_number() OVER (PARTITION BY u ORDER BY score DESC, i) AS rank FROM sc), rec AS (SELECT * FROM rk WHERE rank <= 10)"""
_PROP = "pn AS (SELECT i, count(*) AS n FROM bo GROUP BY i), pt AS (SELECT sum(sqrt(n)) AS t, count(*) AS c FROM pn), pr AS (SELECT i, n, greatest(0.0001, sqrt(n) / t) AS p, least(10, 1 / greatest(0.0001, sqrt(n) / t)) AS ipw FROM pn, pt)"
_ZED = """m AS (SELECT date_trunc('hour', ts) AS h, user_id % 3 AS g, round(avg(value), 6) AS cpu, count(*)::DOUBLE AS requests, round(max(value), 6) AS latency FROM events GROUP BY ALL),
  w AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY h) AS k, avg(cpu) OVER f AS m1, stddev_pop(cpu) OVER f AS s1, avg(latency) OVER f AS m2, stddev_pop(latency) OVER f AS s2, avg(requests) OVER f AS m3, stddev_pop(requests) OVER f AS s3 FROM m WINDOW f AS (PARTITION BY g ORDER BY h ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)),
  z AS (SELECT *, CASE WHEN k <= 12 THEN 0 ELSE greatest(CASE WHEN s1 = 0 THEN 0 ELSE abs(cpu - m1) / s1 END, CASE WHEN s2 = 0 THEN 0 ELSE abs(latency - m2) / s2 END, CASE WHEN s3 = 0 THEN 0 ELSE abs(requests - m3) / s3 END) END AS sc FROM w)"""
_LIN = """ev AS (SELECT event_id, ['START', 'COMPLETE', 'FAIL'][event_id % 3 + 1] AS st, 'job-' || user_id % 7 AS job, 'run-' || event_id % 50 AS run_id, 'in-' || event_type AS i, 'out-' || user_id % 11 AS o, ts FROM events)"""
_B = ", b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"

SQL = {
    "experiment_decision": f"""WITH c AS (SELECT CASE WHEN ('0x' || md5(c_custkey::VARCHAR)[1:8])::BIGINT / 4294967295.0 < 0.5 THEN 'a' ELSE 'b' END AS v, (c_acctbal + 1000) / 11000 AS p FROM customer),
  s AS (SELECT count(*) FILTER (v = 'a') AS nc, count(*) FILTER (v = 'b') AS nt, round(avg((p >= 0.5)::INT) FILTER (v = 'a'), 4) AS rc, round(avg((p >= 0.5)::INT) FILTER (v = 'b'), 4) AS rt FROM c), x AS (SELECT *, round(rc * nc) AS a, round(rt * nt) AS b FROM s),
  q AS (SELECT *, least(a, nc - a, b, nt - b) >= 5 AS ok, (nc + nt) * pow(a * (nt - b) - (nc - a) * b, 2) / (nc::DOUBLE * nt * (a + b) * (nc - a + nt - b)) AS chi FROM x), y AS (SELECT *, least(nc, nt) >= 385 AS enough, CASE WHEN ok THEN {_ERFC('sqrt(chi / 2)')} END AS p FROM q)
  SELECT nc AS n_c, nt AS n_t, rc AS rate_c, rt AS rate_t, CASE WHEN NOT enough THEN 'not_enough_data' WHEN coalesce(p < 0.05, false) THEN 'significant' ELSE 'inconclusive' END AS status, CASE WHEN enough THEN round(p, 6) END AS p_value_rate,
  CASE WHEN enough AND rc > 0 THEN round((rt - rc) / rc * 100, 2) END AS relative_effect, CASE WHEN enough AND coalesce(p < 0.05, false) THEN CASE WHEN rt < rc THEN 'b' ELSE 'a' END END AS winner FROM y""",
    "welch_t": "WITH s AS (SELECT count(*) FILTER (c_custkey % 2 = 0) AS n0, count(*) FILTER (c_custkey % 2 = 1) AS n1, avg(c_acctbal) FILTER (c_custkey % 2 = 0) AS m0, avg(c_acctbal) FILTER (c_custkey % 2 = 1) AS m1, var_samp(c_acctbal) FILTER (c_custkey % 2 = 0) AS v0, var_samp(c_acctbal) FILTER (c_custkey % 2 = 1) AS v1 FROM customer), x AS (SELECT *, v0 / n0 AS u, v1 / n1 AS w FROM s) SELECT round((m0 - m1) / sqrt(u + w), 6) AS t, round(pow(u + w, 2) / (u * u / (n0 - 1) + w * w / (n1 - 1)), 6) AS dof FROM x",
    "uplift_summary": f"WITH {_UPLIFT} SELECT count(*) FILTER (segment = 'persuadable') AS n_persuadable, count(*) FILTER (segment = 'sure_thing') AS n_sure_thing, count(*) FILTER (segment = 'lost_cause') AS n_lost_cause, count(*) FILTER (segment = 'sleeping_dog') AS n_sleeping_dog, round(avg(cate), 6) AS avg_cate, round(coalesce(avg(cate) FILTER (segment = 'persuadable'), 0), 6) AS targeting_uplift FROM v",
    "qini_coefficient": """WITH c AS (SELECT c_custkey, c_acctbal AS s, (c_mktsegment = 'BUILDING')::INT AS y, c_custkey % 2 AS t FROM customer), r AS (SELECT row_number() OVER w AS i, count(*) OVER () AS n, sum(t) OVER () AS nt, sum(t * y) OVER w AS ct, sum((1 - t) * y) OVER w AS cc FROM c WINDOW w AS (ORDER BY s DESC, c_custkey)),
  q AS (SELECT i, n, ct / nt - cc / (n - nt) * i / n AS q FROM r), z AS (SELECT i, n, q, coalesce(lag(q) OVER (ORDER BY i), 0) AS p FROM q), a AS (SELECT sum(q + p) / 2 / max(n) AS auuc, max_by(q, i) / 2 AS ra FROM z) SELECT round(auuc - ra, 6)::DOUBLE AS qini, round(auuc, 6)::DOUBLE AS auuc, round(ra, 6)::DOUBLE AS random_auuc FROM a""",
    "equal_thresholds": f"""WITH {_SCORED}, g AS (SELECT DISTINCT lang FROM x), t AS (SELECT lang, i, 0.01::DOUBLE + (i - 1) * 0.98::DOUBLE / 98 AS t FROM g, range(1, 100) r(i)), v AS (SELECT t.lang, t.i, coalesce(avg((x.p >= t.t)::INT), 0) AS v FROM t LEFT JOIN x ON x.lang = t.lang AND x.y = 1 GROUP BY ALL), m AS (SELECT avg(v) AS m FROM v),
  k AS (SELECT lang, i, row_number() OVER (PARTITION BY lang ORDER BY round(abs(v - m), 12), i) AS k FROM v, m) SELECT lang AS grp, round(i / 100, 2) AS threshold FROM k WHERE k = 1""",
    "binary_metrics": f"WITH {_METRICS} SELECT lang, coalesce(round(2 * tp / nullif(pp + ps, 0), 6), 0)::DOUBLE AS f1_score, coalesce(round(tp / nullif(pp, 0), 6), 0)::DOUBLE AS precision, coalesce(round(tp / nullif(ps, 0), 6), 0)::DOUBLE AS recall, round(auc, 6)::DOUBLE AS roc_auc FROM m",
    "model_leaderboard": f"""WITH {_METRICS}, b AS (SELECT lang, round(auc, 6)::DOUBLE AS a, coalesce(round(2 * tp / nullif(pp + ps, 0), 6), 0)::DOUBLE AS f FROM m), l AS (SELECT *, row_number() OVER w AS k, lead(a) OVER w AS n FROM b WINDOW w AS (ORDER BY a DESC NULLS LAST, f DESC, lang))
  SELECT lang AS model, k::INT AS rank, round(a, 5) AS roc_auc, round(f, 5) AS f1_score, CASE WHEN k = 1 THEN round(coalesce(a - n, 0), 5) END AS auc_margin, CASE WHEN k = 1 THEN n IS NULL OR a - n >= 0.02 END AS is_significant FROM l""",
    "regression_metrics": "WITH p AS (SELECT p_retailprice AS y, avg(p_retailprice) OVER (PARTITION BY p_brand) AS m FROM part) SELECT round(1 - sum(pow(y - m, 2)) / (var_pop(y) * count(*)), 5) AS r2, round(sqrt(avg(pow(y - m, 2))), 5) AS rmse, round(avg(abs(y - m)), 5) AS mae, round(100 * avg(abs((y - m) / y)), 5) AS mape FROM p",
    "interval_coverage": "WITH p AS (SELECT p_retailprice - 150 - 12.5 AS a, p_retailprice + 20 - p_size * 3 + 12.5 AS b, p_retailprice AS y FROM part) SELECT round(avg((y >= a AND y <= b)::INT), 6) AS coverage, round(avg(b - a), 6) AS mean_width, count(*) AS n, abs(avg((y >= a AND y <= b)::INT) - 0.9) <= 0.05 AS well_calibrated FROM p",
    "monthly_cost": """WITH e AS (SELECT event_type, count(*) / 100 AS rps FROM events GROUP BY 1), k AS (SELECT *, CASE WHEN rps <= 10 THEN 'aws_c6i_large' ELSE 'aws_c6i_xlarge' END AS it, CASE WHEN rps <= 10 THEN 0.085 ELSE 0.17 END::DOUBLE AS p FROM e), n AS (SELECT *, greatest(1, ceil(rps / 50))::INT AS n FROM k)
  SELECT event_type, rps, it AS instance_type, n AS n_instances, round(p * n, 4) AS cost_per_hour, round(p * n * 720, 2) AS cost_per_month, round(p * n / (rps * 3600) * 1000000, 4) AS cost_per_million, rps > 50 * n * 0.8 AS near_capacity FROM n""",
    "batch_size": """WITH e AS (SELECT event_type, user_id % 5 + 1 AS b, round(avg(value), 6) AS l FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY l <= 110 DESC, CASE WHEN l <= 110 THEN -b / l ELSE l END, CASE WHEN l <= 110 THEN l ELSE b END) AS k FROM e)
  SELECT event_type, b AS batch_size, round(b / l * 1000, 2) AS throughput, round(l, 2) AS latency, l <= 110 AS within_limit FROM r WHERE k = 1""",
    "investment_analysis": """WITH r AS (SELECT p_brand, round(avg(p_retailprice), 4) / 7000 AS rate FROM part WHERE p_brand <> 'Brand#11' GROUP BY 1), m AS (SELECT avg(rate) AS m FROM r), x AS (SELECT p_partkey, p_retailprice AS p, coalesce(rate, m) * p_size AS rent FROM part LEFT JOIN r USING (p_brand), m),
  y AS (SELECT *, rent * 0.8 AS net, p * 0.8 * (0.165 / 12) * pow(1 + 0.165 / 12, 240) / (pow(1 + 0.165 / 12, 240) - 1) AS pay FROM x)
  SELECT p_partkey, round(rent, 9) AS rent, round(rent * 12 / p * 100, 4) AS gross_yield_pct, round(net * 12 / p * 100, 4) AS net_yield_pct, round(p / (net * 12), 4) AS payback_years, round(net - pay, 4) AS monthly_cashflow, round(p * 0.2 / net, 4) AS recovery_months,
  CASE WHEN net - pay >= 0 AND p / (net * 12) <= 20 THEN 'strong_buy' WHEN p / (net * 12) <= 25 THEN 'buy' WHEN p / (net * 12) <= 35 THEN 'hold' ELSE 'avoid' END AS verdict FROM y""",
    "baseline_hazard": f"WITH {_HAZARD} SELECT t, round(c, 6) AS cumulative FROM b",
    "survival_curves": f"""WITH {_HAZARD}, l AS (SELECT t, c, lead(t) OVER (ORDER BY t) AS t2, lead(c) OVER (ORDER BY t) AS c2 FROM b), a AS (SELECT unnest([0.5, 20.5, 60.25, 500.0]::DOUBLE[]) AS q), g AS (SELECT q, c + coalesce((q - t) / (t2 - t) * (c2 - c), 0) AS g FROM a JOIN l ON q >= t AND (t2 IS NULL OR q < t2)) SELECT h AS k, q AS t, round(exp(-exp(h) * g), 6) AS survival FROM (SELECT DISTINCT h FROM s), g""",
    "median_survival": f"WITH {_HAZARD}, h AS (SELECT DISTINCT h FROM s), m AS (SELECT h, min(t) AS m FROM h JOIN b ON c >= ln(2) / exp(h) GROUP BY h) SELECT k, m AS median FROM s LEFT JOIN m USING (h)",
    "factor_recommend": f"""WITH {_BOUGHT}, n AS (SELECT count(*) AS n FROM embeddings), x AS (SELECT u, i % n AS i, sum(w) AS w FROM bo, n WHERE early GROUP BY ALL), f AS (SELECT vec_id AS i, embedding::DOUBLE[] AS v FROM embeddings),
  l AS (SELECT u, p, sum(w * v[p]) AS x FROM x JOIN f USING (i), range(1, 65) g(p) GROUP BY ALL), us AS (SELECT u, list(x ORDER BY p) AS v FROM l GROUP BY u), sc AS (SELECT us.u, f.i, round(list_dot_product(us.v, f.v), 3) AS score FROM us, f), k AS (SELECT sc.*, row_number() OVER (PARTITION BY sc.u ORDER BY score DESC, sc.i) AS rank FROM sc ANTI JOIN x ON x.u = sc.u AND x.i = sc.i)
  SELECT u AS "user", i AS item, score, rank FROM k WHERE rank <= 5""",
    "ranking_measures": f"""WITH {_RECS}, rl AS (SELECT DISTINCT u, i FROM bo WHERE NOT early AND w >= 25), n AS (SELECT u, count(*) AS n FROM rl WHERE u IN (SELECT u FROM rec) GROUP BY u), h AS (SELECT u, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg FROM rec JOIN rl USING (u, i) GROUP BY u),
  e AS (SELECT coalesce(h, 0) AS h, coalesce(dcg, 0) AS dcg, n, (SELECT sum(1 / log2(j + 1)) FROM range(1, least(n, 10) + 1) g(j)) AS ideal FROM n LEFT JOIN h USING (u)) SELECT round(avg(h / 10), 6) AS precision_at_k, round(avg(h / n), 6) AS recall_at_k, round(avg(dcg / ideal), 6) AS ndcg_at_k, count(*) AS n_users FROM e""",
    "debiased_ranking": f"""WITH {_RECS}, {_PROP}, x AS (SELECT u, i, score * least(pow(p, -0.3), 10) AS score FROM rec JOIN pr USING (i)) SELECT u AS "user", i AS item, round(score, 5) AS score, row_number() OVER (PARTITION BY u ORDER BY round(score, 9) DESC, i) AS rank FROM x""",
    "ips_evaluation": f"""WITH {_RECS}, {_PROP}, rl AS (SELECT DISTINCT u, i FROM bo WHERE NOT early AND w >= 25), ab AS (SELECT n, (SELECT coalesce(count(*), 0) FROM pn q WHERE q.n > p.n) AS a FROM (SELECT DISTINCT n FROM pn) p),
  x AS (SELECT rec.u, rec.rank, (rl.i IS NOT NULL)::INT AS h, ipw, a FROM rec SEMI JOIN (SELECT u FROM rl) ru ON ru.u = rec.u LEFT JOIN rl ON rl.u = rec.u AND rl.i = rec.i JOIN pr ON pr.i = rec.i JOIN ab USING (n)),
  p AS (SELECT u, sum(h / log2(rank + 1)) AS dcg, sum(h * ipw / log2(rank + 1)) AS idcg, sum(h) AS h, sum(h * ipw) / sum(ipw) AS ip, sum(a) AS a, count(*) AS c FROM x GROUP BY u),
  rr AS (SELECT u, ipw, row_number() OVER (PARTITION BY u ORDER BY ipw DESC, i) AS k FROM rl JOIN pr USING (i)), id AS (SELECT u, sum(ipw / log2(k + 1)) AS best, sum(1 / log2(k + 1)) AS ideal FROM rr WHERE k <= 10 GROUP BY u)
  SELECT round(avg(dcg / ideal), 6) AS ndcg_standard, round(avg(idcg / best), 6) AS ndcg_ips, round(avg(h / 10), 6) AS precision_standard, round(avg(ip), 6) AS precision_ips, round(sum(a / (SELECT c FROM pt)) / sum(c), 6) AS popularity_bias, count(*) AS n_users, round((SELECT count(DISTINCT i) FROM rec) / (SELECT c FROM pt), 6) AS catalog_coverage FROM p JOIN id USING (u)""",
    "list_diversity": """WITH e AS (SELECT label AS q, vec_id AS i, embedding::DOUBLE[] AS v, row_number() OVER (PARTITION BY label ORDER BY vec_id * 37 % 101 DESC, vec_id) AS k FROM embeddings), l AS (SELECT * FROM e WHERE k <= 8), f AS (SELECT q, v AS f FROM e WHERE k = 1),
  p AS (SELECT a.q, 1 - list_cosine_similarity(a.v, b.v) AS d FROM l a JOIN l b ON a.q = b.q AND a.i < b.i), m AS (SELECT q, avg(d) AS ild FROM p GROUP BY q), b AS (SELECT q, least(floor(d * 5), 4) AS b, count(*) AS c FROM p WHERE d >= 0 AND d <= 1 GROUP BY ALL), t AS (SELECT q, c / sum(c) OVER (PARTITION BY q) AS s FROM b), n AS (SELECT q, -sum(s * log2(s)) AS eff FROM t GROUP BY q),
  o AS (SELECT l.q, count(DISTINCT sign(list_sum(l.v[1:32]))::INT * 10 + sign(list_sum(l.v[33:64]))::INT) / count(*) AS cov, avg(1 - list_cosine_similarity(l.v, f.f)) AS nov FROM l JOIN f USING (q) GROUP BY l.q)
  SELECT q, round(greatest(0, coalesce(ild, 0)), 4) AS intra_list_diversity, round(least(1, cov), 4) AS coverage, round(greatest(0, nov), 4) AS novelty, round(greatest(0, coalesce(eff, 0)), 4)::DOUBLE AS effective_diversity FROM o LEFT JOIN m USING (q) LEFT JOIN n USING (q)""",
    "linucb_recommend": """WITH e AS (SELECT event_type AS arm, round(value / 500, 4) AS x, (user_id % 2)::DOUBLE AS r FROM events), s AS (SELECT arm, 1 + sum(x * x) AS a, sum(x) AS b, 1 + count(*) AS d, sum(x * r) AS u, sum(r) AS v, round(avg(x), 3) AS c FROM e GROUP BY arm UNION ALL SELECT 'new', 1, 0, 1, 0, 0, 0.5),
  i AS (SELECT arm, c, d / (a * d - b * b) AS ia, -b / (a * d - b * b) AS ib, a / (a * d - b * b) AS id, u, v FROM s), z AS (SELECT arm, (ia * u + ib * v) * c + ib * u + id * v AS ex, 0.7 * sqrt(greatest(0, ia * c * c + 2 * ib * c + id)) AS bo FROM i) SELECT arm AS event_type, round(ex, 6)::DOUBLE AS expected, round(bo, 6)::DOUBLE AS bonus, round(ex + bo, 6)::DOUBLE AS ucb FROM z""",
    "preference_recommend": "SELECT p_partkey, round(((p_brand = 'Brand#23')::INT + (p_size = 15)::INT) / 2.0::DOUBLE, 6) AS score FROM part ORDER BY score DESC, p_partkey LIMIT 20",
    "neighbourhood_features": f"WITH {_G}{_B}, k AS (SELECT src AS dst, count(*) AS k FROM b GROUP BY 1) SELECT src AS id, round(avg((b.dst % 10 = 0)::INT), 6) AS neighbor_fraud_ratio, round(ln(1 + avg(k)), 6) AS hub_proximity FROM b JOIN k ON k.dst = b.dst GROUP BY src",
    "risk_flags": f"""WITH {_G}{_B}, i AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1), n AS (SELECT count(*) - 1 AS n FROM nodes), kk AS (SELECT src AS id, count(*) AS k FROM b GROUP BY 1), t AS (SELECT x.src AS id, count(*) AS t FROM b x JOIN b y ON x.src = y.src AND x.dst < y.dst JOIN b z ON z.src = x.dst AND z.dst = y.dst GROUP BY 1),
  tn AS (SELECT src AS id, amount, ts FROM ed UNION ALL SELECT dst, amount, ts FROM ed), w AS (SELECT id, amount, ts - lag(ts) OVER (PARTITION BY id ORDER BY ts, amount) AS g, sum(amount) OVER (PARTITION BY id) AS s FROM tn), f AS (SELECT id, round(CASE WHEN avg(g) > 0 THEN stddev_pop(g) / avg(g) ELSE 0 END, 6) AS bu, round(sum(pow(amount / s, 2)), 6) AS co FROM w GROUP BY id),
  a AS (SELECT nodes.id, round(coalesce(i.k, 0) / n, 6) AS ic, CASE WHEN kk.k < 2 THEN 0 ELSE 2 * coalesce(t, 0) / (kk.k * (kk.k - 1)) END AS cl, bu, co FROM nodes LEFT JOIN i USING (id) JOIN kk USING (id) LEFT JOIN t USING (id) JOIN f USING (id), n)
  SELECT id, CASE WHEN ic > 0.3 AND cl > 0.5 THEN 'in_degree,clustering' WHEN ic > 0.3 THEN 'in_degree' WHEN cl > 0.5 THEN 'clustering' ELSE 'no_centrality_risk_flags' END AS flags, CASE WHEN bu > 3 THEN 'HIGH' WHEN bu > 1 THEN 'MEDIUM' ELSE 'LOW' END AS burst_level, CASE WHEN co > 0.7 THEN 'HIGH' WHEN co > 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS concentration_level FROM a""",
    "lineage_events": f"WITH {_LIN} SELECT event_id::VARCHAR AS event_id, run_id FROM ev WHERE job = 'job-3' AND st = 'COMPLETE' ORDER BY ts DESC, event_id::VARCHAR DESC LIMIT 20",
    "lineage_summary": f"""WITH {_LIN}, l AS (SELECT * FROM ev WHERE st <> 'FAIL') SELECT st AS what, count(*) AS n FROM ev GROUP BY 1 UNION ALL SELECT 'events', count(*) FROM ev UNION ALL SELECT 'nodes', count(*) FROM (SELECT job FROM l UNION SELECT i FROM l UNION SELECT o FROM l) UNION ALL SELECT 'edges', count(*) FROM (SELECT i AS a, job AS b FROM l UNION SELECT job, o FROM l)""",
    "compliance_report": """WITH e AS (SELECT event_type, (value < 250)::INT AS g, ts, max(ts) OVER () AS now FROM events), s AS (SELECT event_type, """
    + ", ".join(f"coalesce(avg(1 - g) FILTER (ts > now - INTERVAL {h} HOUR), 0) / (1 - 0.9::DOUBLE) AS b{h}" for h in (1, 6, 72))
    + ", avg(1 - g) AS er FROM e GROUP BY 1) SELECT count(*) AS total_services, count(*) FILTER (er <= 1 - 0.9::DOUBLE) AS compliant_services, count(*) FILTER (er > 1 - 0.9::DOUBLE) AS non_compliant_services, count(*) FILTER (b1 >= 14.4) AS critical_alerts, count(*) FILTER (b1 < 14.4 AND b6 >= 6) AS high_alerts FROM s",
    "multi_metric": f"WITH {_ZED} SELECT g, h, round(sc, 5)::DOUBLE AS score, sc > 2.5 AS is_anomaly FROM z",
    "detection_summary": f"WITH {_ZED}, y AS (SELECT g, round(sc, 5)::DOUBLE AS sc, sc > 2.5 AS a FROM z) SELECT g, count(*) AS n_total, count(*) FILTER (a) AS n_anomalies, round(avg(a::INT), 5) AS anomaly_rate, round(max(sc), 5) AS max_score, round(avg(sc), 5) AS mean_score FROM y GROUP BY g",
    "metric_alerts": f"WITH {_ZED} SELECT g, h, CASE WHEN cpu >= latency AND cpu >= requests THEN 'cpu' WHEN latency >= requests THEN 'latency' ELSE 'requests' END AS metric_name, greatest(cpu, latency, requests) AS metric_value, CASE WHEN sc > 5 THEN 'critical' ELSE 'warning' END AS severity FROM z WHERE sc > 2.5",
    "snapshot_anomalies": """WITH a AS (SELECT user_id, list(value ORDER BY ts, event_id) AS c, list(round(value % 7, 3) ORDER BY ts, event_id) AS l FROM events GROUP BY 1), b AS (SELECT user_id, len(c) AS n, greatest(len(c) - 5, 0) AS en, c, l FROM a), s AS (SELECT user_id, n, en, c[greatest(en - 20, 0) + 1 : en] AS rc, c[en + 1 :] AS nc, l[greatest(en - 20, 0) + 1 : en] AS rl, l[en + 1 :] AS nl FROM b),
  z AS (SELECT user_id, CASE WHEN n < 10 OR len(rc) < 2 THEN 0 WHEN list_stddev_pop(rc) = 0 THEN CASE WHEN list_max(list_transform(nc, lambda x: abs(x - list_avg(rc)))) > 0 THEN 10 ELSE 0 END ELSE list_max(list_transform(nc, lambda x: abs(x - list_avg(rc)))) / list_stddev_pop(rc) END AS z1,
    CASE WHEN n < 10 OR len(rl) < 2 THEN 0 WHEN list_stddev_pop(rl) = 0 THEN CASE WHEN list_max(list_transform(nl, lambda x: abs(x - list_avg(rl)))) > 0 THEN 10 ELSE 0 END ELSE list_max(list_transform(nl, lambda x: abs(x - list_avg(rl)))) / list_stddev_pop(rl) END AS z2 FROM s)
  SELECT user_id, round(greatest(z1, z2), 4)::DOUBLE AS max_score, CASE WHEN z1 > 2 AND z2 > 2 THEN 'cpu,latency' WHEN z1 > 2 THEN 'cpu' WHEN z2 > 2 THEN 'latency' ELSE '' END AS affected, z1 > 2 OR z2 > 2 AS is_anomaly FROM z""",
    "dataset_stats": "WITH c AS (SELECT 'class' AS kind, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'split', source, count(*) FROM documents GROUP BY ALL), i AS (SELECT round(max(n) / min(n), 3) AS imbalance FROM c WHERE kind = 'class') SELECT kind, value, n, imbalance FROM c, i",
    "interaction_stats": f"WITH {_BOUGHT} SELECT count(DISTINCT u) AS n_users, count(DISTINCT i) AS n_items, count(*) AS n_ratings, round(1 - count(*) / (count(DISTINCT u)::DOUBLE * count(DISTINCT i)), 8) AS sparsity, round(avg(w), 8) AS mean_rating FROM bo",
    "category_cube": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    "property_features": "SELECT p_partkey, (2026 - 1950 - p_size)::INT AS age, round(p_retailprice / p_size)::BIGINT AS unit_price, CASE WHEN p_size % 2 = 1 THEN 'yes' ELSE 'no' END AS has_garage FROM part",
    "labelled_split": "SELECT n_nationkey, CASE n_nationkey % 3 WHEN 1 THEN 1 ELSE 0 END AS label FROM nation WHERE n_nationkey % 3 <> 0",
}
