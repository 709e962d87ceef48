"""Readers, writers and the catalogue. Spark reads lazily; explicit schemas avoid a pass over the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str, schema: str | None = None, sep: str = ",", header: bool = True, encoding: str = "UTF-8") -> DataFrame:
    """A CSV file or folder. Without a schema types are inferred, which reads the files once more."""
    reader = spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def query(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(sql)


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def load_csv(spark: SparkSession, name: str, path: str) -> DataFrame:
    """A CSV file as a named view."""
    df = read_csv(spark, path)
    register(df, name)
    return df


def churn_customers(spark: SparkSession, path: str) -> DataFrame:
    """Customer rows: blank charges are 0, the label is 1 or 0."""
    raw = read_csv(spark, path).withColumn("TotalCharges", F.trim(F.col("TotalCharges").cast("string")))
    return raw.withColumns({"TotalCharges": F.coalesce(F.nullif("TotalCharges", F.lit("")).cast("double"), F.lit(0.0)), "Churn": F.when(F.col("Churn") == "Yes", 1).otherwise(0)})


def text_files(spark: SparkSession, folder: str) -> DataFrame:
    """One row per .txt or .md file of a folder: ``source``, ``text``."""
    found = spark.read.option("wholetext", True).option("pathGlobFilter", "*.{txt,md}").text(folder)
    return found.select(F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1).alias("source"), F.col("value").alias("text"))


def conll_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a CoNLL file in order: ``line_no``, ``line``."""
    whole = spark.read.option("wholetext", True).text(path)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))


def labelled_paths(spark: SparkSession, folder: str, splits: tuple = ("train", "val", "test")) -> DataFrame:
    """Lines ``path label`` of one file per split."""
    out = None
    for split in splits:
        parts = F.split("value", " ")
        one = spark.read.text(f"{folder}/{split}.txt").filter(F.trim("value") != "").select(F.get(parts, 0).alias("path"), F.get(parts, 1).cast("int").alias("label"), F.lit(split).alias("split"))
        out = one if out is None else out.unionByName(one)
    return out


def transaction_graph(spark: SparkSession, features: str, edges: str, classes: str) -> tuple[DataFrame, DataFrame]:
    """Nodes with a class (0 if unknown) and the edges between known nodes."""
    nodes = spark.read.csv(features, inferSchema=True).withColumnRenamed("_c0", "id")
    known = spark.read.option("header", True).csv(classes)
    c = known.select(F.col(known.columns[0]).cast("long").alias("id"), F.coalesce(F.col(known.columns[1]).try_cast("int"), F.lit(0)).alias("label"))
    raw = spark.read.option("header", True).csv(edges)
    e = raw.select(F.col(raw.columns[0]).cast("long").alias("src"), F.col(raw.columns[1]).cast("long").alias("dst"))
    ids = nodes.select("id")
    e = e.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes.join(c, "id", "left").fillna(0, ["label"]), e.select("src", "dst")


def movie_ratings(spark: SparkSession, ratings: str, movies: str) -> tuple[DataFrame, DataFrame]:
    """Ratings with ISO times, products with their first genre and a price tier by id."""
    r = read_csv(spark, ratings, "userId int, movieId int, rating double, timestamp long")
    m = read_csv(spark, movies, "movieId int, title string, genres string")
    tier = F.when(F.col("movieId") % 3 == 0, "budget").when(F.col("movieId") % 3 == 1, "mid").otherwise("premium")
    genre = F.lower(F.get(F.split("genres", r"\|"), 0))
    return (
        r.select(F.col("userId").alias("user_id"), F.col("movieId").alias("product_id"), "rating", F.date_format(F.timestamp_seconds("timestamp"), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp")),
        m.select(F.col("movieId").alias("product_id"), F.when((genre == "") | genre.startswith("(no"), "unknown").otherwise(genre).alias("category"), tier.alias("price_tier")),
    )


def save_features(df: DataFrame, folder: str, name: str) -> str:
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return f"{folder}/{name}.parquet"


def kafka_metrics(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The metric messages of a topic as a stream (needs Spark's Kafka package on the class path)."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest").load()
    return raw.select(F.from_json(F.col("value").cast("string"), METRICS).alias("m")).select("m.*")


METRICS = "timestamp double, cpu double, latency double, requests double, is_anomaly int"


def to_kafka(df: DataFrame, servers: str, topic: str, checkpoint: str):
    """Write rows of a stream as JSON messages."""
    out = df.select(F.to_json(F.struct("*")).alias("value")).writeStream.format("kafka")
    return out.option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


# -- generated sources ---------------------------------------------------------------------------------------------
def metric_series(spark: SparkSession, n: int = 2000, anomaly_rate: float = 0.03, seed: int = 42) -> DataFrame:
    """Three seasonal metrics with injected spikes and their labels."""
    i = F.col("id")
    hit = F.rand(seed) < anomaly_rate
    wave = F.sin(2 * 3.141592653589793 * i / 288)
    return spark.range(n).withColumn("is_anomaly", hit.cast("int")).select(
        i.alias("t"), F.least(F.lit(100.0), F.greatest(F.lit(0.0), 50 + 20 * wave + 3 * F.randn(seed + 1) + 40 * F.col("is_anomaly"))).alias("cpu"),
        F.greatest(F.lit(1.0), 100 + 30 * wave + 5 * F.randn(seed + 2) + 300 * F.col("is_anomaly")).alias("latency"), F.greatest(F.lit(0.0), 1000 + 400 * wave + 20 * F.randn(seed + 3)).alias("requests"), "is_anomaly",
    )


def interactions(spark: SparkSession, n: int = 10_000, users: int = 500, products: int = 200, seed: int = 42) -> DataFrame:
    """Ratings of products with a power-law popularity."""
    return spark.range(n).select(
        F.floor(F.rand(seed) * users).cast("int").alias("user_id"), F.floor(F.pow(F.rand(seed + 1), F.lit(2.5)) * products).cast("int").alias("product_id"),
        (F.floor(F.rand(seed + 2) * 5) + 1).cast("int").alias("rating"), F.timestamp_seconds(F.lit(1_767_225_600) + F.floor(F.rand(seed + 3) * 7_000_000)).alias("timestamp"),
    )


def transactions(spark: SparkSession, n: int, mean: float = 150.0, std: float = 50.0, null_fraction: float = 0.0, seed: int = 1) -> DataFrame:
    """Payment rows; amounts are null for a fraction of them."""
    amount = F.greatest(F.lit(0.0), F.round(mean + std * F.randn(seed), 2))
    return spark.range(n).select(
        F.col("id").alias("transaction_id"), (F.floor(F.rand(seed + 1) * 8999) + 1000).cast("int").alias("customer_id"), F.when(F.rand(seed + 2) >= null_fraction, amount).alias("amount"),
        (F.floor(F.rand(seed + 3) * 57) + 18).cast("int").alias("customer_age"), F.concat(F.lit("c"), F.floor(F.rand(seed + 4) * 8).cast("string")).alias("category"),
    )
