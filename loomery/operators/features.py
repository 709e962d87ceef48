"""Feature tables, splits, lookups, geography."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def item_features(df: DataFrame, item: str, value: str, prior: float = 3.0, weight: float = 10.0) -> DataFrame:
    """Per item: mean, non-null count, smoothed mean and popularity rank (of equal counts the smaller id first).

    The rank is over the item table, one row per item, not over the interactions.
    """
    agg = df.groupBy(F.col(item).alias("item")).agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"))
    smoothed = (F.coalesce("avg_value", F.lit(0.0)) * F.col("n") + prior * weight) / (F.col("n") + weight)
    return agg.withColumns({"score": smoothed, "popularity_rank": F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "item"))})


def user_features(df: DataFrame, user: str, value: str, ts: str, category: str, as_of: Column) -> DataFrame:
    """Per user: mean, count, last time, whole days since then, most frequent category (of equals the smaller)."""
    base = df.groupBy(F.col(user).alias("user")).agg(F.avg(value).alias("avg_value"), F.count(value).alias("n"), F.max(ts).alias("last_ts"))
    counts = df.groupBy(F.col(user).alias("user"), F.col(category).alias("c")).agg(F.count(F.lit(1)).alias("k"))
    top = counts.groupBy("user").agg(F.min_by("c", F.struct(-F.col("k"), F.col("c"))).alias("favorite"))
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp("last_ts")) / 86400).cast("long")
    return base.join(top, "user", "left").withColumn("recency_days", days)


def temporal_split(df: DataFrame, user: str, order: list[str], share: float = 0.8) -> DataFrame:
    """Add ``split``: the first ``int(share * n)`` rows of each user by time are train, the rest test."""
    w = Window.partitionBy(user)
    rank = F.row_number().over(w.orderBy(*order))
    return df.withColumn("split", F.when(rank <= F.floor(share * F.count(F.lit(1)).over(w)), "train").otherwise("test"))


def online_lookup(entities: DataFrame, features: DataFrame, key: str, names: list[str]) -> DataFrame:
    """Features of each asked entity, and the names of those that are missing."""
    found = entities.join(features.select(key, *names), key, "left")
    missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names]))
    return found.withColumn("missing", F.array_join(missing, ","))


def median_enrich(df: DataFrame, group: str, value: str) -> DataFrame:
    """Add the group's median and count and the ratio to the median; groups are aggregated, then joined back."""
    stats = df.groupBy(group).agg(F.median(value).alias("group_median"), F.count(value).alias("group_n"))
    return df.join(stats, group).withColumn("ratio", F.round(F.col(value) / F.col("group_median"), 4))


def label_encode(df: DataFrame, column: str) -> DataFrame:
    """Add ``code``: the rank of the value among the distinct ones, from 0; null stays null."""
    codes = df.select(column).na.drop().distinct().withColumn("code", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(column)) - 1)
    return df.join(codes, column, "left")


def tenure_features(tenure: Column, monthly: Column, total: Column, flags: list[Column]) -> dict[str, Column]:
    services = F.lit(0)
    for f in flags:
        services = services + f.cast("int")
    return {
        "avg_monthly": total / (tenure + 1), "expected_total": monthly * tenure, "n_services": services,
        "tenure_group": F.when(tenure <= 12, "new").when(tenure <= 36, "mid").otherwise("long"),
    }


def grid_cell(lat: Column, lng: Column, resolution: int) -> Column:
    """A square cell whose side halves with each resolution: .05 degrees at 7; coordinates are cut toward 0."""
    step = 0.05 / 2 ** (resolution - 7)
    cut = lambda x: F.format_number((x / step).cast("long") * step, 4)
    return F.concat(F.lit(f"mock_r{resolution}_"), cut(lat), F.lit("_"), cut(lng))


def feature_ref(ref: Column) -> tuple[Column, Column]:
    """View and feature of a reference ``view:feature``."""
    parts = F.split(ref, ":", 2)
    return F.get(parts, 0), F.get(parts, 1)


# -- data sets ---------------------------------------------------------------------------------------------------------
def property_features(df: DataFrame, built: str, price: str, area: str, garage: Column, year: int) -> DataFrame:
    """Add ``age`` in years, ``unit_price`` (rounded price by area) and ``has_garage`` (yes or no)."""
    return df.withColumns({"age": F.lit(year) - F.col(built), "unit_price": F.round(F.try_divide(F.col(price), F.col(area))).cast("long"), "has_garage": F.when(garage, "yes").otherwise("no")})


def labelled_split(df: DataFrame, key: str, label: str, positive: object = 1, unknown: object = 0) -> DataFrame:
    """Rows with a known label, as 1 (``positive``) or 0."""
    return df.filter(F.col(label) != unknown).select(key, F.when(F.col(label) == positive, 1).otherwise(0).alias("label"))


def class_balance(df: DataFrame, label: str, split: str) -> DataFrame:
    """Rows by class and by split: ``kind``, ``value``, ``n``; with the ratio of the largest to the smallest class."""
    kinds = [df.groupBy(F.lit(k).alias("kind"), F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")) for k, c in (("class", label), ("split", split))]
    ratio = kinds[0].agg(F.round(F.max("n") / F.min("n"), 3).alias("imbalance"))
    return kinds[0].unionByName(kinds[1]).crossJoin(F.broadcast(ratio))  # one row


def interaction_stats(df: DataFrame, user: str, item: str, rating: str) -> DataFrame:
    """Users, items, ratings, share of empty cells and mean rating."""
    out = df.agg(F.count_distinct(user).alias("n_users"), F.count_distinct(item).alias("n_items"), F.count(F.lit(1)).alias("n_ratings"), F.avg(rating).alias("mean_rating"))
    return out.withColumn("sparsity", 1 - F.col("n_ratings") / (F.col("n_users") * F.col("n_items").cast("double")))


def rating_histogram(df: DataFrame, rating: str) -> DataFrame:
    """Ratings by value."""
    return df.groupBy(rating).agg(F.count(F.lit(1)).alias("n"))


def top_tags(df: DataFrame, tags: str, sep: str = "|", k: int = 10) -> DataFrame:
    """The most frequent parts of a separated column, of equal counts the first by name."""
    return df.select(F.explode(F.split(tags, F.lit("\\Q" + sep + "\\E"))).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def cube_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows by every combination of columns, nulls for the ones left out."""
    return df.cube(*columns).agg(F.count(F.lit(1)).alias("n"))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """A projection that says which columns are missing, instead of the first."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*columns)
