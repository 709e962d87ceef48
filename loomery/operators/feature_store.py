"""A feature store: a registry of definitions, point-in-time joins for training rows, and an online store with versions.

- *As-of join.* Features are a history with event times; a training row takes the latest features of its key that were
  known at its own time. Rows and history are merged by key and time and the latest features carried forward. A key is cut
  into time slices: slices are summed up by their latest features, these few are carried over the key's slices, and rows
  look back inside their slice only. So a key with a third of all rows is spread over as many tasks as it has slices.
- *Online store.* The latest features of each key, in buckets of keys as Parquet files. An upsert reads and rewrites the
  buckets that its keys fall into, and then puts down a new manifest that names each bucket's files: readers see all of an
  upsert or nothing. Rows are merged by event time, so replays, late rows and repeated rows change nothing; a batch that is
  named in a manifest is not applied again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Types that a definition may name, and Spark's types that go with them.
FEATURE_TYPES = {"int": {"tinyint", "smallint", "int", "bigint"}, "float": {"float", "double"}, "str": {"string"}, "bool": {"boolean"}, "time": {"date", "timestamp"}, "vector": {"array<float>", "array<double>"}}


# -- files through Spark's file systems --------------------------------------------------------------------------------
def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.option("wholetext", True).text(path).first()[0])


def _put(spark: SparkSession, path: str, what: dict) -> bool:
    """Write a small file under a new name and rename it: all of it or nothing. False if the name was taken."""
    fs, final = _file(spark, path)
    _, draft = _file(spark, f"{path}.{uuid.uuid4().hex}.draft")
    out = fs.create(draft)
    out.write(bytearray(json.dumps(what, sort_keys=True).encode()))
    out.close()
    if fs.exists(final) or not fs.rename(draft, final):
        fs.delete(draft, False)
        return False
    return True


# -- definitions -----------------------------------------------------------------------------------------------------
class FeatureRegistry:
    """Definitions of features: name, type, entity, description. A name is registered once; each definition is a small file."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def register(self, name: str, dtype: str, entity: str = "user", description: str = "") -> None:
        """Add a definition. ValueError for a name that is taken or a type that is not in ``FEATURE_TYPES``."""
        if dtype not in FEATURE_TYPES:
            raise ValueError(f"{dtype} is none of {sorted(FEATURE_TYPES)}")
        if not name or "/" in name or name.startswith((".", "_")):
            raise ValueError(f"not a name: {name!r}")
        if not _put(self.spark, f"{self.path}/{name}.json", {"name": name, "dtype": dtype, "entity": entity, "description": description}):
            raise ValueError(f"feature {name} is registered")

    def features(self, entity: str | None = None) -> list[dict]:
        """All definitions, or those of an entity, by name."""
        fs, where = _file(self.spark, self.path)
        found = [str(x.getPath()) for x in fs.listStatus(where)] if fs.exists(where) else []
        all_of = [_read(self.spark, x) for x in sorted(found) if x.endswith(".json")]
        return [x for x in all_of if entity is None or x["entity"] == entity]

    def checked(self, df: DataFrame, names: list[str], entity: str | None = None) -> DataFrame:
        """``df``, if all of ``names`` are registered (KeyError) and its columns have their types (TypeError)."""
        known = {x["name"]: x for x in self.features(entity)}
        for n in names:
            if n not in known:
                raise KeyError(f"feature {n} is not registered")
            if n in df.columns and df.schema[n].dataType.simpleString() not in FEATURE_TYPES[known[n]["dtype"]]:
                raise TypeError(f"feature {n} is {df.schema[n].dataType.simpleString()}, registered as {known[n]['dtype']}")
        return df


# -- point in time ---------------------------------------------------------------------------------------------------
def as_of_join(
    rows: DataFrame, history: DataFrame, key: str, at: str, known: str, features: list[str], created: str | None = None, ttl: str | None = None, width: str = "7 days", age: str | None = None
) -> DataFrame:
    """``rows`` with the features of the latest ``history`` row of the same ``key`` whose time ``known`` is ``at`` or before.

    Of several with one time the one with the greatest ``created`` counts (then the greatest by features). With ``ttl``,
    features older than that at the row's time are null. ``age`` names a column for their age in seconds. Rows without
    history keep nulls, as do rows with a null key or time; every row comes out once, repeated rows too. Features replace
    columns of their names. ``width`` is the length of a time slice: a task's share of a key.
    """
    own = [c for c in rows.columns if c not in features and c != age]
    slice_of = lambda t: F.window(t, width)["start"]
    value = F.struct(F.col(known).cast("timestamp").alias("t"), (F.col(created) if created else F.lit(None).cast("timestamp")).alias("c"), *[F.col(x).alias(f"f{i}") for i, x in enumerate(features)])
    past = history.filter(F.col(key).isNotNull() & F.col(known).isNotNull()).select(F.col(key).alias("k"), F.col(known).cast("timestamp").alias("t"), value.alias("v"))
    past = past.groupBy("k", "t").agg(F.max("v").alias("v")).withColumn("s", slice_of(F.col("t")))
    asked = rows.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.col(key).alias("k"), F.col(at).cast("timestamp").alias("t"))
    usable = F.col("k").isNotNull() & F.col("t").isNotNull()
    merged = past.select("k", "s", "t", "v", F.lit(None).cast(asked.schema["row"].dataType).alias("row"), F.lit(0).alias("kind")).unionByName(
        asked.filter(usable).select("k", slice_of(F.col("t")).alias("s"), "t", F.lit(None).cast(past.schema["v"].dataType).alias("v"), "row", F.lit(1).alias("kind"))
    )
    # the latest features of each slice of a key, carried over its slices: one row a slice
    slices = merged.groupBy("k", "s").agg(F.max("v").alias("last"))
    before = Window.partitionBy("k").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("k", "s", F.last("last", ignorenulls=True).over(before).alias("carried"))
    inside = Window.partitionBy("k", "s").orderBy("t", "kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = merged.withColumn("v", F.last("v", ignorenulls=True).over(inside)).filter("kind = 1")
    found = seen.join(carried, ["k", "s"]).select("row", "t", F.coalesce("v", "carried").alias("v"))
    found = found.unionByName(asked.filter(~F.coalesce(usable, F.lit(False))).select("row", "t", F.lit(None).cast(past.schema["v"].dataType).alias("v")))
    fresh = F.lit(True) if ttl is None else F.col("v.t") + F.expr(f"INTERVAL {ttl}") >= F.col("t")
    out = [F.when(fresh, F.col(f"v.f{i}")).alias(x) for i, x in enumerate(features)]
    if age:
        out.append(F.when(fresh, (F.unix_micros("t") - F.unix_micros("v.t")) / 1e6).alias(age))
    return found.select("row.*", *out)


# -- online ----------------------------------------------------------------------------------------------------------
def latest(rows: DataFrame, key: str, ts: str, features: list[str]) -> DataFrame:
    """Per key the features as of its greatest time; a feature that is null there keeps the last value that is not. Of equal times the greatest value counts."""
    newest = [F.max(F.when(F.col(x).isNotNull(), F.struct(F.col(ts).alias("t"), F.col(x).alias("v")))).alias(x) for x in features]
    return rows.filter(F.col(key).isNotNull() & F.col(ts).isNotNull()).groupBy(key).agg(F.max(ts).alias(ts), *newest)


class OnlineStore:
    """The latest features by key. ``key`` is not null in it; ``features`` may be added to over time by opening it with more.

    Files: ``data/<upsert>/bucket=<b>`` and ``manifest/<version>.json``; nothing is overwritten, so a version once read
    stays readable, and executors may be lost at any time. Writers that meet try again on top of the other's version.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, ts: str, features: dict[str, str], key_type: str = "bigint", buckets: int = 64):
        self.spark, self.path, self.key, self.ts, self.features, self.buckets = spark, path.rstrip("/"), key, ts, features, buckets
        held = ", ".join(f"`{n}` struct<t: timestamp, v: {t}>" for n, t in features.items())
        self.schema = f"`{key}` {key_type}, `{ts}` timestamp, {held}, bucket int"

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> list[int]:
        fs, where = _file(self.spark, f"{self.path}/manifest")
        names = [x.getPath().getName() for x in fs.listStatus(where)] if fs.exists(where) else []
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n.count(".") == 1)

    def manifest(self, version: int | None = None) -> dict:
        """What a version (the last by default) is made of: ``files`` by bucket, and the ``batches`` applied to it."""
        known = self.versions()
        if version is None and not known:
            return {"version": 0, "files": {}, "batches": [], "buckets": self.buckets}
        found = _read(self.spark, f"{self.path}/manifest/{known[-1] if version is None else version}.json")
        if found["buckets"] != self.buckets:
            raise ValueError(f"the store has {found['buckets']} buckets")
        return found

    def _rows(self, manifest: dict, some: set[int] | None = None) -> DataFrame:
        paths = [p for b, p in manifest["files"].items() if some is None or int(b) in some]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema.rsplit(", bucket", 1)[0]).parquet(*paths).withColumn("bucket", self._bucket())

    def upsert(self, rows: DataFrame, batch: str | int | None = None) -> int:
        """Merge ``rows`` (key, time, some of the features) and return the version. ``batch`` names the rows: the same name again does nothing.

        Each feature of a key is that of the greatest time at which it is not null. Rows with a null key or time are
        left out. No rows: no new version.
        """
        given = {n: t for n, t in self.features.items() if n in rows.columns}
        missing = [F.lit(None).cast(f"struct<t: timestamp, v: {t}>").alias(n) for n, t in self.features.items() if n not in given]
        named = rows.select(self.key, F.col(self.ts).cast("timestamp").alias(self.ts), *[F.col(n).cast(t).alias(n) for n, t in given.items()])
        new = latest(named, self.key, self.ts, list(given)).select("*", *missing).select(self.key, self.ts, *self.features).withColumn("bucket", self._bucket()).persist()
        try:
            touched = {r["bucket"] for r in new.select("bucket").distinct().collect()}  # at most one row a bucket
            while True:
                base = self.manifest()
                if not touched or (batch is not None and str(batch) in base["batches"]):
                    return base["version"]
                both = self._rows(base, touched).unionByName(new)
                merged = both.groupBy(self.key).agg(F.max(self.ts).alias(self.ts), *[F.max(n).alias(n) for n in self.features]).withColumn("bucket", self._bucket())
                place = f"{self.path}/data/{uuid.uuid4().hex}"
                merged.repartition("bucket").write.partitionBy("bucket").parquet(place)
                files = base["files"] | {str(b): f"{place}/bucket={b}" for b in touched}
                version = base["version"] + 1
                batches = [*base["batches"], *([str(batch)] if batch is not None else [])][-1000:]  # a replay comes soon after
                if _put(self.spark, f"{self.path}/manifest/{version}.json", {"version": version, "files": files, "batches": batches, "buckets": self.buckets}):
                    return version
        finally:
            new.unpersist()

    def read(self, version: int | None = None) -> DataFrame:
        """All keys with their last time and features."""
        return self._rows(self.manifest(version)).select(self.key, self.ts, *[F.col(n)["v"].alias(n) for n in self.features])

    def lookup(self, entities: DataFrame, names: list[str] | None = None, ttl: str | None = None, as_of: Column | None = None) -> DataFrame:
        """``entities`` with features, and ``missing``: the names of those without a value, or older than ``ttl`` at ``as_of``. Only buckets asked for are read."""
        names = names or list(self.features)
        asked = {r["b"] for r in entities.filter(F.col(self.key).isNotNull()).select(self._bucket().alias("b")).distinct().collect()}
        stored = self._rows(self.manifest(), asked)

        def fresh(n: str) -> Column:
            return F.col(n)["v"] if ttl is None else F.when(F.col(n)["t"] + F.expr(f"INTERVAL {ttl}") >= (as_of if as_of is not None else F.current_timestamp()), F.col(n)["v"])

        found = entities.drop(*names, "missing").join(stored.select(self.key, *[fresh(n).alias(n) for n in names]), self.key, "left")
        return found.withColumn("missing", F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in names])))

    def follow(self, stream: DataFrame, checkpoint: str):
        """Keep the store up to date with a stream; started, to be awaited or stopped by the caller. A replayed micro-batch changes nothing."""
        name = f"{checkpoint}#"
        return stream.writeStream.foreachBatch(lambda rows, number: self.upsert(rows, f"{name}{number}") and None).option("checkpointLocation", checkpoint).start()
