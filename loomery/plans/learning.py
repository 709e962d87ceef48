"""Queries of text classification, synthetic tables, contributions, and geo cells."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomery.operators import geo, synthetic, text_classifier, timeseries
from loomery.session import table


def _scored(s, d):
    labelled = table(s, d, "documents").join(table(s, d, "labels"), "doc_id").select("doc_id", "text", "quality", text_classifier.held_out("doc_id").alias("held_out"))
    model = text_classifier.fit_text_classifier(labelled.filter("NOT held_out"), "text", "quality", corpus=table(s, d, "documents"), dims=1 << 14, pairs=False, stop_words=False, steps=60)
    if model is None:
        return labelled.withColumns({"category": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "probabilities": F.lit(None).cast("map<string,double>")})
    return model.classify(labelled)


def text_categories(s, d):
    """Every labelled document with its predicted quality; one in five was not learned from."""
    return _scored(s, d).select("doc_id", "held_out", "quality", "category", F.round("confidence", 4).alias("confidence"))


def text_quality_auc(s, d):
    """How well the model ranks the documents that it did not learn from."""
    out = _scored(s, d).filter("held_out").withColumn("p", F.col("probabilities")["1"])
    return text_classifier.ranking_quality(out, "p", "quality").withColumns({"auc": F.round("auc", 3), "accuracy": F.round("accuracy", 3)})


MADE = (["l_quantity", "l_extendedprice", "l_discount", "l_tax"], ["l_returnflag", "l_linestatus"])


def synthetic_lineitem(s, d):
    """What lineitem and as many synthetic rows say of means, deviations, correlations and shares."""
    real = table(s, d, "lineitem")
    model = synthetic.fit_copula(real, *MADE)
    made = synthetic.generate(s, model, real.count())
    return synthetic.compare(real, made, *MADE).withColumns({"real": F.round("real", 3), "made": F.round("made", 3)})


def anomaly_contributions(s, d):
    """Which of price, size and key makes a part stand out."""
    out = timeseries.isolation_contributions(table(s, d, "part"), "p_partkey", ["p_size", "p_retailprice"], n_trees=50)
    return out.withColumns({"score": F.round("score", 6), "contribution": F.round("contribution", 6)})


def geo_market(s, d):
    """Customers near their nation's centre: balances by cell and around it."""
    c = table(s, d, "customer")
    lat = F.col("c_nationkey") * 6.25 - 75 + F.col("c_custkey") * 37 % 1000 / 4000.0
    lng = F.col("c_nationkey") * 13.5 - 160 + F.col("c_custkey") * 91 % 1000 / 4000.0
    rows = c.select("c_custkey", "c_acctbal", lat.alias("lat"), lng.alias("lng"))
    out = geo.market_features(rows, "lat", "lng", "c_acctbal")
    return out.select("c_custkey", "cell_district", "cell_local", F.round("median_price", 3).alias("median_price"), "n_prices", "price_vs_district", F.round("ring_mean", 6).alias("ring_mean"), "ring_n")


QUERIES = {
    "text_categories": text_categories, "text_quality_auc": text_quality_auc, "synthetic_lineitem": synthetic_lineitem, "anomaly_contributions": anomaly_contributions, "geo_market": geo_market,
}

SQL = {
    "geo_market": """WITH c AS (SELECT c_custkey, c_acctbal, c_nationkey * CAST(6.25 AS DOUBLE) - 75 + c_custkey * 37 % 1000 / CAST(4000 AS DOUBLE) AS lat, c_nationkey * CAST(13.5 AS DOUBLE) - 160 + c_custkey * 91 % 1000 / CAST(4000 AS DOUBLE) AS lng FROM customer),
g AS (SELECT *, CAST(trunc(lat / 0.05::DOUBLE) AS BIGINT) AS i7, CAST(trunc(lng / 0.05::DOUBLE) AS BIGINT) AS j7, CAST(trunc(lat / 0.025::DOUBLE) AS BIGINT) AS i8, CAST(trunc(lng / 0.025::DOUBLE) AS BIGINT) AS j8 FROM c),
m AS (SELECT i7, j7, median(c_acctbal) AS med, count(*) AS n FROM g GROUP BY 1, 2),
r AS (SELECT a.c_custkey, sum(CAST(b.c_acctbal AS DECIMAL(18, 6))) AS t, count(*) AS n FROM g a JOIN g b ON abs(a.i8 - b.i8) <= 1 AND abs(a.j8 - b.j8) <= 1 GROUP BY 1)
SELECT c_custkey, 'r7:' || i7 || ':' || j7 AS cell_district, 'r8:' || i8 || ':' || j8 AS cell_local, round(med, 3) AS median_price, m.n AS n_prices, round(c_acctbal / nullif(med, 0), 4) AS price_vs_district,
  round(CAST(t AS DOUBLE) / r.n, 6) AS ring_mean, r.n AS ring_n FROM g JOIN m USING (i7, j7) JOIN r USING (c_custkey)""",
}
