"""Queries on features, profiles, expectations, experiments and risk, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import experiment as X
from loomery.operators import features as G
from loomery.operators import guards, profile, recsys, resolve
from loomery.session import table


def _r(df, places: int, *cols: str):
    return df.withColumns({c: F.round(F.col(c), places) for c in cols})


def item_popularity(s, d):
    return _r(G.item_features(table(s, d, "lineitem"), "l_partkey", "l_quantity"), 6, "avg_value", "score")


def _purchases(s, d):
    o, li, p = table(s, d, "orders"), table(s, d, "lineitem"), table(s, d, "part")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(p.select("p_partkey", "p_type", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))


def user_features(s, d):
    f = G.user_features(_purchases(s, d), "o_custkey", "l_quantity", "o_orderdate", "p_type", F.lit("2001-12-01").cast("timestamp"))
    return _r(f.drop("last_ts"), 6, "avg_value")


def temporal_split(s, d):
    return G.temporal_split(table(s, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "split")


def online_feature_lookup(s, d):
    f = table(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return G.online_lookup(table(s, d, "customer").select("c_custkey"), f, "c_custkey", ["n_orders", "spent"])


def group_median_enrich(s, d):
    return _r(G.median_enrich(table(s, d, "part").select("p_partkey", "p_brand", "p_retailprice"), "p_brand", "p_retailprice"), 4, "group_median", "ratio")


def pivot_avg(s, d):
    j = table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    pri = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    out = j.groupBy("c_mktsegment").pivot("o_orderpriority", pri).agg(F.round(F.avg("o_totalprice"), 2))
    return out.select("c_mktsegment", *[F.col(f"`{p}`").alias("p" + p[0]) for p in pri])


def profile_numeric(s, d):
    return _r(profile.profile_numeric(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]), 4, "mean", "std", "min", "max", "q25", "median", "q75")


def expectation_suite(s, d):
    C = profile.Check
    suite = [
        C("not_null", "o_orderkey"), C("unique", "o_orderkey"), C("unique", "o_custkey"), C("in_range", "o_totalprice", 1000, 400000),
        C("exists", "o_orderdate"), C("in_set", "o_orderstatus", allowed=["F", "O"]), C("not_null", "no_such"),
    ]
    return profile.run_suite(table(s, d, "orders"), suite).drop("error")


def schema_diff(s, d):
    old = profile.infer_contract(table(s, d, "orders"))
    new = old.filter("column <> 'o_orderstatus'").withColumn("dtype", F.when(F.col("column") == "o_orderdate", "string").when(F.col("column") == "o_custkey", "float").otherwise(F.col("dtype")))
    return profile.schema_diff(old, new.unionByName(s.createDataFrame([("o_new", "integer", False)], "column string, dtype string, nullable boolean")))


def confident_joint(s, d):
    rows = table(s, d, "labels").select("doc_id", F.col("quality").alias("y"), F.array(F.lit(1.0) - F.pmod("doc_id", F.lit(128)) / 128.0, F.pmod("doc_id", F.lit(128)) / 128.0).alias("p"))
    return resolve.confident_joint(rows, "doc_id", "y", "p")


def entity_resolution(s, d):
    v = table(s, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("bal"))
    return resolve.resolve(v, "id", ["nation"], {"name": ("text", 2.0), "bal": ("numeric", 1.0)}, 0.55)


def ab_results(s, d):
    c = table(s, d, "customer").select(X.route(F.col("c_custkey"), [("a", 0.5), ("b", 0.3), ("c", 0.2)]).alias("variant"), ((F.col("c_acctbal") + 1000) / 11000).alias("p"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"))
    return X.variant_stats(c, "variant", "p", "y")


def _survival(s, d):
    j = table(s, d, "lineitem").join(table(s, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return j.select(F.datediff("l_shipdate", "o_orderdate").alias("t"), (F.col("l_linestatus") == "F").cast("int").alias("e"), "o_orderpriority", F.col("l_discount").alias("risk"))


def kaplan_meier(s, d):
    return _r(X.kaplan_meier(_survival(s, d).filter("t >= 0"), "t", "e"), 6, "survival", "variance")


def log_rank(s, d):
    return _r(X.log_rank(_survival(s, d).filter("t >= 0").withColumn("g", F.col("o_orderpriority") == "1-URGENT"), "t", "e", "g", True).drop("p_value"), 4, "observed", "expected", "chi2")


def concordance(s, d):
    return _r(X.concordance(_survival(s, d).filter("t >= 0"), "risk", "t", "e"), 6, "c_index")


def fairness_metrics(s, d):
    j = table(s, d, "labels").join(table(s, d, "documents").select("doc_id", "lang", "n_chars"), "doc_id").withColumn("pred", (F.col("n_chars") > 1500).cast("int"))
    return _r(X.fairness_gaps(X.group_metrics(j, "lang", "quality", "pred")), 6, "dp", "eo", "eodds", "pp", "di")


def qini_curve(s, d):
    c = table(s, d, "customer").select("c_custkey", F.col("c_acctbal").alias("score"), (F.col("c_mktsegment") == "BUILDING").cast("int").alias("y"), (F.pmod("c_custkey", F.lit(2)) == 1).cast("int").alias("t"))
    return _r(X.qini(c, "score", "y", "t", "c_custkey"), 6, "qini")


def mortgage_table(s, d):
    m = X.mortgage(table(s, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice")
    return _r(m.withColumn("afford", X.affordability(F.col("monthly"), F.col("p_retailprice") / 5)), 4, "loan", "monthly", "total_paid", "overpayment").drop("ltv")


def risk_profile(s, d):
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("amt"), F.count(F.lit(1)).alias("n"), F.datediff(F.lit("1999-01-01"), F.min("o_orderdate")).alias("age"))
    fraud = X.fraud_probability(F.col("amt") / 20, F.col("n").cast("double"), F.col("age").cast("double"))
    churn = X.churn_probability(F.col("age") / 30.0, F.col("amt") / 2000, F.lit(0.5), F.lit(0.52))
    rows = o.withColumns({"fraud": F.round(fraud, 6), "churn": F.round(churn, 6)})
    combined, action = X.risk_action(F.col("fraud"), F.col("churn"), F.lit(0.0))
    return rows.select("o_custkey", "fraud", "churn", F.round(combined, 5).alias("combined"), action.alias("action"))


def gini_concentration(s, d):
    n = table(s, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"))
    return _r(recsys.gini(n, "n"), 6, "gini", "top_share")


def comps_knn(s, d):
    p = table(s, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("size"), "p_retailprice")
    out = recsys.comparables(p, p, "p_partkey", {"size": 1.0, "p_retailprice": 2.0}, "p_retailprice")
    return _r(out.drop("similarity"), 6, "distance")


QUERIES = {
    "item_popularity": item_popularity, "user_features": user_features, "temporal_split": temporal_split, "online_feature_lookup": online_feature_lookup,
    "group_median_enrich": group_median_enrich, "pivot_avg": pivot_avg, "profile_numeric": profile_numeric,
    "profile_top_values": lambda s, d: profile.top_values(table(s, d, "customer"), "c_mktsegment"),
    "expectation_suite": expectation_suite, "schema_diff": schema_diff,
    "iqr_outliers": lambda s, d: _r(profile.iqr_outlier_ratio(table(s, d, "lineitem"), "l_extendedprice", ["l_returnflag"]), 6, "outlier_ratio"),
    "label_entropy": lambda s, d: _r(profile.label_entropy(table(s, d, "labels"), "quality"), 6, "entropy"),
    "column_audit": lambda s, d: _r(profile.column_audit(table(s, d, "customer")), 6, "null_ratio", "distinct_ratio"),
    "distribution_type": lambda s, d: profile.distribution_type(table(s, d, "lineitem"), "l_quantity"),
    "pii_scan": lambda s, d: guards.pii_scan(table(s, d, "documents"), "text"),
    "pii_mask": lambda s, d: table(s, d, "customer").select("c_custkey", guards.mask(F.col("c_name"), "full_name").alias("masked"), guards.mask(F.concat(F.col("c_custkey").cast("string"), F.lit("-12-3456")), "ssn").alias("ssn")),
    "input_guard": lambda s, d: guards.input_guard(table(s, d, "conversations"), "text").select("conv_id", "turn", "injection", "has_pii", "is_safe", "risk_score"),
    "output_guard": lambda s, d: guards.output_guard(table(s, d, "conversations").filter("role = 'assistant'"), "text").select("conv_id", "turn", "is_safe", "risk_score"),
    "confident_joint": confident_joint, "entity_resolution": entity_resolution, "ab_results": ab_results, "kaplan_meier": kaplan_meier, "logrank": log_rank,
    "concordance": concordance, "fairness_metrics": fairness_metrics, "qini_curve": qini_curve, "mortgage_table": mortgage_table,
    "latency_percentiles": lambda s, d: _r(X.latency(table(s, d, "events"), "value", ["event_type"]), 6, "p50", "p95", "p99", "mean", "max"),
    "risk_profile": risk_profile, "gini_concentration": gini_concentration, "comps_knn": comps_knn,
    "ips_debias": lambda s, d: _r(recsys.propensities(table(s, d, "lineitem"), "l_partkey"), 8, "propensity", "ips_weight"),
    "beta_posterior": lambda s, d: _r(recsys.beta_posteriors(table(s, d, "events"), "user_id", (F.col("event_type") == "purchase").cast("double")), 6, "mean", "std"),
    "synthetic_rows": lambda s, d: resolve.fidelity(table(s, d, "lineitem"), resolve.synthesize(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], 20000), ["l_quantity", "l_extendedprice", "l_discount"]),
}

_SURVIVAL = "SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) AS t, (l_linestatus = 'F')::INT AS e, o_orderpriority, l_discount AS risk FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
_PROFILE = " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", count(*) AS count, count(*) FILTER ({c} IS NULL) AS null_count, round(100.0 * count(*) FILTER ({c} IS NULL) / count(*), 2) AS null_pct, "
    f"count(DISTINCT {c}) + coalesce(max(({c} IS NULL)::BIGINT), 0) AS unique_count, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, round(min({c}), 4) AS min, round(max({c}), 4) AS max, "
    f"round(quantile_cont({c}, 0.25), 4) AS q25, round(quantile_cont({c}, 0.5), 4) AS median, round(quantile_cont({c}, 0.75), 4) AS q75 FROM lineitem"
    for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
)
# RE2's \b knows ASCII letters only, and it can't look around: borders and excluded numbers are spelled out
_B, _E = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"
_PII = [
    ("email", "high", _B + r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}" + _E),
    ("phone", "medium", r"(^|[^\d])(\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}($|[^\d])"),
    ("ssn", "critical", _B + r"(0([1-9]\d|0[1-9])|[1-578]\d\d|6([0-57-9]\d|6[0-57-9]))[-\s]?(0[1-9]|[1-9]\d)[-\s]?(000[1-9]|00[1-9]\d|0[1-9]\d\d|[1-9]\d{3})" + _E),
    ("credit_card", "critical", _B + r"(4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(011|5\d{2}))[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}" + _E),
    ("ip_address", "low", _B + r"((25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(25[0-5]|2[0-4]\d|[01]?\d\d?)" + _E),
    ("passport", "high", _B + r"[A-Z]{1,2}\d{6,9}" + _E),
    ("iban", "high", _B + r"[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}[A-Z0-9]{0,16}" + _E),
    ("date_of_birth", "medium", _B + r"((19|20)\d{2}[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])|(0[1-9]|[12]\d|3[01])[-/](0[1-9]|1[0-2])[-/](19|20)\d{2})" + _E),
    ("full_name", "low", _B + r"[A-Z][a-z]{2,}\s[A-Z][a-z]{2,}" + _E),
]
_PII_SQL = " UNION ALL ".join(
    f"SELECT '{k}' AS pii_type, count(*) FILTER (regexp_matches(text, '{p}')) AS match_count, round(count(*) FILTER (regexp_matches(text, '{p}')) / count(*) FILTER (trim(text) <> ''), 4) AS fraction, '{v}' AS severity FROM documents"
    for k, v, p in _PII
)
_INJ = r"""regexp_matches(text, '(?i)ignore\s+((previous|all|prior|above)\s+){1,2}(instructions?|prompts?|context|rules?)|forget\s+(everything|all|previous|prior|your\s+instructions)|you\s+are\s+now\s+(a|an)\s+\w+|act\s+as\s+(if\s+you\s+are|a|an)\s+|(system\s*prompt|system\s*message)\s*[:=]|\bjailbreak\b|\bdan\s*(mode|prompt|jailbreak)\b|pretend\s+(you\s+are|to\s+be)\s+|\[system\]|\[user\]|\[assistant\]|override\s+(safety|guidelines|rules|restrictions|filters|constraints)|disregard\s+your\s+(training|guidelines|instructions|constraints)|new\s+instruction[s]?:\s*|</?(s|system|instruction|context)>')"""
_SEEN = lambda text, *more: " OR ".join(f"regexp_matches({text}, '{p}')" for p in (r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", r"(\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b", r"\b\d{3}[\-\s]\d{2}[\-\s]\d{4}\b", r"\b(\d{4}[\s\-]?){3}\d{4}\b", *more))
_QPII, _APII = _SEEN("text[1:2000]", r"\b\d{4}\s?\d{6}\b"), _SEEN("text")
_HARM = r"""regexp_matches(text, '(?i)how\s+to\s+(make|build|create|synthesize)\s+(a\s+)?(bomb|explosive|weapon|poison|drug)|suicide\s+method|how\s+to\s+self[\s\-]?harm|steps?\s+to\s+(kill|harm)\s+(yourself|oneself)|how\s+to\s+hack\s+into|unauthorized\s+access\s+to\s+|bypass\s+authentication|step[\s\-]by[\s\-]step\s+(instructions?|guide)\s+(to|for)\s+(attack|exploit|compromise)')"""

SQL = {
    "item_popularity": "SELECT *, row_number() OVER (ORDER BY n DESC, item) AS popularity_rank FROM (SELECT l_partkey AS item, round(avg(l_quantity), 6) AS avg_value, count(l_quantity) AS n, round((avg(l_quantity) * count(l_quantity) + 30.0) / (count(l_quantity) + 10.0), 6) AS score FROM lineitem GROUP BY 1)",
    "user_features": """WITH j AS (SELECT o_custkey AS u, l_quantity AS v, o_orderdate AS ts, p_type AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
        f AS (SELECT u, c, row_number() OVER (PARTITION BY u ORDER BY count(*) DESC, c) AS k FROM j GROUP BY u, c)
        SELECT j.u AS "user", round(avg(v), 6) AS avg_value, count(v) AS n, max(f.c) AS favorite, floor((epoch(TIMESTAMP '2001-12-01') - epoch(max(ts))) / 86400)::BIGINT AS recency_days FROM j JOIN f ON j.u = f.u AND f.k = 1 GROUP BY j.u""",
    "temporal_split": "SELECT o_custkey, o_orderkey, CASE WHEN row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) <= floor(0.8 * count(*) OVER (PARTITION BY o_custkey)) THEN 'train' ELSE 'test' END AS split FROM orders",
    "online_feature_lookup": "SELECT c_custkey, n_orders, spent, CASE WHEN n_orders IS NULL THEN 'n_orders,spent' ELSE '' END AS missing FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) ON c_custkey = o_custkey",
    "group_median_enrich": "SELECT p_partkey, p_brand, p_retailprice, round(m, 4) AS group_median, n AS group_n, round(p_retailprice / m, 4) AS ratio FROM part JOIN (SELECT p_brand, median(p_retailprice) AS m, count(p_retailprice) AS n FROM part GROUP BY 1) USING (p_brand)",
    "pivot_avg": "SELECT c_mktsegment, " + ", ".join(f"round(avg(o_totalprice) FILTER (o_orderpriority = '{p}'), 2) AS p{p[0]}" for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
    "profile_numeric": _PROFILE,
    "profile_top_values": "SELECT c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 10",
    "expectation_suite": """SELECT * FROM (SELECT 0 AS id, 'not_null' AS kind, 'o_orderkey' AS "column", count(*) FILTER (o_orderkey IS NULL) = 0 AS passed, count(*) FILTER (o_orderkey IS NULL) AS violations FROM orders
        UNION ALL SELECT 1, 'unique', 'o_orderkey', count(o_orderkey) = count(DISTINCT o_orderkey), count(o_orderkey) - count(DISTINCT o_orderkey) FROM orders
        UNION ALL SELECT 2, 'unique', 'o_custkey', count(o_custkey) = count(DISTINCT o_custkey), count(o_custkey) - count(DISTINCT o_custkey) FROM orders
        UNION ALL SELECT 3, 'in_range', 'o_totalprice', count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) = 0, count(*) FILTER (o_totalprice < 1000 OR o_totalprice > 400000) FROM orders
        UNION ALL SELECT 4, 'exists', 'o_orderdate', true, 0
        UNION ALL SELECT 5, 'in_set', 'o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) = 0, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) FROM orders
        UNION ALL SELECT 6, 'not_null', 'no_such', false, NULL)""",
    "schema_diff": "SELECT * FROM (VALUES ('o_orderstatus', 'removed'), ('o_orderdate', 'type_changed'), ('o_new', 'new_required')) t(\"column\", change)",
    "iqr_outliers": "WITH r AS (SELECT l_returnflag, l_extendedprice AS x, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem), q AS (SELECT l_returnflag, max(x) FILTER (i = n // 4) AS q1, max(x) FILTER (i = 3 * n // 4) AS q3 FROM r GROUP BY 1) SELECT r.l_returnflag, round(avg((x < q1 - 1.5 * (q3 - q1) OR x > q3 + 1.5 * (q3 - q1))::INT), 6) AS outlier_ratio FROM r JOIN q USING (l_returnflag) GROUP BY 1",
    "label_entropy": "WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1), t AS (SELECT sum(n) AS t, count(*) AS k FROM n) SELECT round(-sum(n / t * log2(n / t)) / log2(max(k)), 6) AS entropy FROM n, t",
    "column_audit": "SELECT c AS \"column\", nr AS null_ratio, round(dr, 6) AS distinct_ratio, CASE WHEN nr > 0.3 AND dr > 0.95 THEN 'model_skewing,membership_inference' WHEN nr > 0.3 THEN 'model_skewing' WHEN dr > 0.95 THEN 'membership_inference' ELSE '' END AS findings FROM ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, avg(({c} IS NULL)::INT)::DOUBLE AS nr, count(DISTINCT {c}) / count(*) AS dr FROM customer" for c in ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")) + ")",
    "pii_scan": _PII_SQL,
    "pii_mask": "SELECT c_custkey, c_name[1:2] || '***' || c_name[-2:] AS masked, repeat('*', length(c_custkey::VARCHAR) + 2) || '3456' AS ssn FROM customer",
    "input_guard": f"SELECT conv_id, turn, NOT regexp_matches(text, '^\\s*$') AND ({_INJ}) AS injection, ({_QPII}) AS has_pii, NOT (regexp_matches(text, '^\\s*$') OR ({_INJ})) AS is_safe, CASE WHEN regexp_matches(text, '^\\s*$') THEN 1.0 WHEN {_INJ} THEN 0.95 WHEN {_QPII} THEN 0.4 WHEN length(text) > 2000 THEN 0.3 ELSE 0.0 END::DOUBLE AS risk_score FROM conversations",
    "output_guard": f"SELECT conv_id, turn, NOT ({_HARM}) AS is_safe, CASE WHEN {_HARM} THEN 1.0 WHEN {_APII} THEN 0.6 WHEN length(trim(text)) < 10 THEN 0.2 ELSE 0.1 END::DOUBLE AS risk_score FROM conversations WHERE role = 'assistant'",
    "confident_joint": "WITH r AS (SELECT doc_id, quality AS y, 1.0::DOUBLE - doc_id % 128 / 128.0::DOUBLE AS p0, doc_id % 128 / 128.0::DOUBLE AS p1 FROM labels), t AS (SELECT avg(p0) FILTER (y = 0) AS t0, avg(p1) FILTER (y = 1) AS t1 FROM r), g AS (SELECT y, CASE WHEN p0 >= t0 AND (p1 < t1 OR p0 >= p1) THEN 0 WHEN p1 >= t1 THEN 1 END AS g FROM r, t) SELECT y AS label, g AS guess, count(*) AS n FROM g WHERE g IS NOT NULL AND g <> y GROUP BY 1, 2",
    "ab_results": "WITH b AS (SELECT ('0x' || md5(c_custkey::VARCHAR)[1:8])::BIGINT / 4294967295.0 AS b, (c_acctbal + 1000) / 11000 AS p, (c_mktsegment = 'BUILDING')::INT AS y FROM customer) SELECT CASE WHEN b < 0.5 THEN 'a' WHEN b < 0.8 THEN 'b' ELSE 'c' END AS variant, count(*) AS n, round(avg(p), 4) AS mean_prob, round(avg((p >= 0.5)::INT), 4) AS high_risk_rate, round(avg(y), 4) AS outcome_rate FROM b GROUP BY 1",
    "kaplan_meier": f"WITH s AS ({_SURVIVAL}), t AS (SELECT t, count(*) AS n, sum(e) AS d FROM s WHERE t >= 0 GROUP BY t), r AS (SELECT t, d, sum(n) OVER (ORDER BY t DESC) AS r FROM t), v AS (SELECT t, d, r, CASE WHEN min(r - d) OVER w <= 0 THEN 0 ELSE exp(sum(CASE WHEN d < r THEN ln(1 - d / r) END) OVER w) END AS s, coalesce(sum(CASE WHEN r > d THEN d / (r * (r - d)) END) OVER w, 0) AS g FROM r WHERE d > 0 WINDOW w AS (ORDER BY t)) SELECT t, d::BIGINT AS events, r::BIGINT AS at_risk, round(s, 6)::DOUBLE AS survival, round(s * s * g, 6)::DOUBLE AS variance FROM v",
    "logrank": f"WITH s AS ({_SURVIVAL}), t AS (SELECT t, count(*) FILTER (o_orderpriority = '1-URGENT') AS na, count(*) AS n, coalesce(sum(e) FILTER (o_orderpriority = '1-URGENT'), 0) AS da, sum(e) AS d FROM s WHERE t >= 0 GROUP BY t), r AS (SELECT *, sum(na) OVER (ORDER BY t DESC) AS ra, sum(n) OVER (ORDER BY t DESC) AS r FROM t), a AS (SELECT sum(da) AS o, sum(d * ra / r) AS e, sum(CASE WHEN r > 1 THEN d * ra * (r - ra) * (r - d) / (r * r * (r - 1.0::DOUBLE)) ELSE 0 END) AS v FROM r WHERE d > 0) SELECT round(o, 4)::DOUBLE AS observed, round(e, 4)::DOUBLE AS expected, round((o - e) * (o - e) / v, 4)::DOUBLE AS chi2 FROM a",
    "concordance": f"WITH s AS ({_SURVIVAL}), c AS (SELECT risk, t, e, count(*) AS n FROM s WHERE t >= 0 GROUP BY ALL), l AS (SELECT risk AS r2, t AS t2, sum(n) AS n2 FROM c GROUP BY ALL) SELECT round(sum(CASE WHEN risk > r2 THEN n * n2 WHEN risk = r2 THEN n * n2 / 2 ELSE 0 END) / sum(n * n2), 6)::DOUBLE AS c_index, sum(n * n2)::BIGINT AS pairs FROM c JOIN l ON t2 > t WHERE e = 1",
    "fairness_metrics": "WITH j AS (SELECT lang, quality AS y, (n_chars > 1500)::INT AS p FROM labels JOIN documents USING (doc_id)), m AS (SELECT lang AS g, avg(p) AS pr, avg(p) FILTER (y = 1) AS tpr, avg(p) FILTER (y = 0) AS fpr, avg(y) FILTER (p = 1) AS ppv FROM j GROUP BY 1), x AS (SELECT a.g AS group_a, b.g AS group_b, abs(a.pr - b.pr) AS dp, abs(a.tpr - b.tpr) AS eo, greatest(abs(a.tpr - b.tpr), abs(a.fpr - b.fpr)) AS eodds, abs(a.ppv - b.ppv) AS pp, least(a.pr, b.pr) / greatest(a.pr, b.pr) AS di FROM m a JOIN m b ON a.g < b.g) SELECT group_a, group_b, round(dp, 6) AS dp, round(eo, 6) AS eo, round(eodds, 6) AS eodds, round(pp, 6) AS pp, round(di, 6) AS di, CASE WHEN di < 0.8 OR eo > 0.1 THEN 'high' WHEN di < 0.9 OR eo > 0.05 THEN 'medium' ELSE 'low' END AS severity FROM x",
    "qini_curve": "WITH c AS (SELECT c_custkey, c_acctbal AS s, (c_mktsegment = 'BUILDING')::INT AS y, c_custkey % 2 AS t FROM customer), r AS (SELECT c_custkey, row_number() OVER w AS rank, sum(t) OVER w AS nt, sum(1 - t) OVER w AS nc, sum(t * y) OVER w AS yt, sum((1 - t) * y) OVER w AS yc FROM c WINDOW w AS (ORDER BY s DESC, c_custkey)) SELECT c_custkey, rank, round(yt - CASE WHEN nc > 0 THEN yc * nt / nc ELSE 0 END, 6)::DOUBLE AS qini FROM r",
    "mortgage_table": "WITH m AS (SELECT p_partkey, p_retailprice, p_retailprice * 0.8 AS loan, p_retailprice * 0.8 * 0.01 * pow(1.01, 240) / (pow(1.01, 240) - 1) AS pay FROM part) SELECT p_partkey, p_retailprice, round(loan, 4) AS loan, round(pay, 4) AS monthly, round(pay * 240, 4) AS total_paid, round(pay * 240 - loan, 4) AS overpayment, CASE WHEN pay * 12 / (p_retailprice / 5) <= 0.28 THEN 'comfortable' WHEN pay * 12 / (p_retailprice / 5) <= 0.43 THEN 'stretched' ELSE 'unaffordable' END AS afford FROM m",
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(max(value), 6) AS max FROM events GROUP BY 1",
    "gini_concentration": "WITH n AS (SELECT count(*)::DOUBLE AS x FROM lineitem GROUP BY l_partkey), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM n) SELECT round(2 * sum(i * x) / (max(n) * sum(x)) - (max(n) + 1) / max(n), 6) AS gini, round(sum(x) FILTER (i > n - n // 10) / sum(x), 6) AS top_share FROM r",
    "ips_debias": "WITH n AS (SELECT l_partkey AS item, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT sum(sqrt(n)) AS t FROM n) SELECT item, n, round(greatest(0.0001, sqrt(n) / t), 8) AS propensity, round(least(10.0, 1 / greatest(0.0001, sqrt(n) / t)), 8) AS ips_weight FROM n, t",
    "beta_posterior": "WITH s AS (SELECT user_id AS arm, 1 + count(*) FILTER (event_type = 'purchase') AS alpha, 1 + count(*) FILTER (event_type <> 'purchase') AS beta FROM events GROUP BY 1) SELECT arm, alpha, beta, round(alpha / (alpha + beta), 6) AS mean, round(sqrt(alpha * beta / ((alpha + beta) * (alpha + beta) * (alpha + beta + 1.0::DOUBLE))), 6) AS std, alpha + beta - 2 AS pulls FROM s",
    "comps_knn": "WITH b AS (SELECT min(p_size) AS l1, max(p_size) AS h1, min(p_retailprice) AS l2, max(p_retailprice) AS h2 FROM part), f AS (SELECT p_partkey, p_retailprice, (p_size - l1) / (h1 - l1)::DOUBLE AS f1, 2 * (p_retailprice - l2) / (h2 - l2) AS f2 FROM part, b), p AS (SELECT s.p_partkey AS subject, f.p_partkey, f.p_retailprice, sqrt(pow(f.f1 - s.f1, 2) + pow(f.f2 - s.f2, 2)) AS d FROM f s JOIN f ON f.p_partkey <> s.p_partkey), r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY round(d, 9), p_partkey) AS rank FROM p) SELECT subject, p_partkey, rank, round(d, 6) AS distance, p_retailprice FROM r WHERE rank <= 5",
    "risk_profile": "WITH o AS (SELECT o_custkey, avg(o_totalprice) AS amt, count(*) AS n, date_diff('day', min(o_orderdate)::DATE, DATE '1999-01-01') AS age FROM orders GROUP BY 1), f AS (SELECT o_custkey, round(least(0.97, greatest(0.03, 0.45 * least(1, greatest(0, (ln(1 + amt / 20) - ln(1 + exp(5.32))) / (ln(1 + exp(9.125)) - ln(1 + exp(5.32))))) + 0.30 * CASE WHEN age <= 0 THEN 1 ELSE least(1, greatest(0, 1 - ln(1 + age) / ln(366))) END + 0.25 * least(1, greatest(0, (n - 5) / 25.0)))), 6) AS fraud, round(least(0.96, greatest(0.04, 0.16 + 0.28 * CASE WHEN age / 30.0 <= 0 THEN 1.0 WHEN age / 30.0 <= 12 THEN 1.0 - age / 30.0 / 24 ELSE greatest(0, 0.5 - (age / 30.0 - 12) / 120) END + 0.24 * least(1, greatest(0, (amt / 2000 - 18) / 100)) + 0.16 * 0.52)), 6) AS churn FROM o) SELECT o_custkey, fraud::DOUBLE AS fraud, churn::DOUBLE AS churn, round(0.55 * fraud + 0.30 * churn, 5)::DOUBLE AS combined, CASE WHEN fraud >= 0.5 THEN 'block' WHEN 0.55 * fraud + 0.30 * churn >= 0.7 THEN 'review' WHEN churn >= 0.5 THEN 'intervene' ELSE 'ok' END AS action FROM f",
    "entity_resolution": """WITH v AS (SELECT s_suppkey AS id, s_acctbal AS bal, s_nationkey AS nk, list_distinct(list_transform(range(1, length(s_name) - 1), lambda i: lower(s_name)[i : i + 2])) AS g FROM supplier),
        p AS (SELECT a.id AS id_a, b.id AS id_b, len(list_intersect(a.g, b.g)) / len(list_distinct(list_concat(a.g, b.g))) AS t, abs(a.bal - b.bal) / greatest(abs(a.bal), abs(b.bal), 1e-12) AS gap FROM v a JOIN v b ON a.nk = b.nk AND a.id < b.id),
        s AS (SELECT id_a, id_b, round((2 * t + CASE WHEN gap <= 0.1 THEN 1 ELSE greatest(0, 1 - (gap - 0.1) / 0.4) END) / 3, 6) AS score FROM p) SELECT * FROM s WHERE score >= 0.55""",
}
