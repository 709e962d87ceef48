"""Session defaults and the few helpers that every module needs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 8, app: str = "loomery") -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``. Only a local session may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomery-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def tasks_for(rows: int, per_task: int = 200_000) -> int:
    """How many tasks ``rows`` rows need."""
    return max(1, -(-rows // per_task))


def stage_table(df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Cuts the lineage, and survives the loss of any executor: later reads go to the shared store and not to the
    shuffle files of the executors that made the rows. With ``tasks``, no more tasks than these make the last step: for
    tables known to be smaller than the session's shuffle partitions are made for.
    """
    spark = df.sparkSession
    df = df if tasks is None else df.coalesce(tasks)
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Delete the files of staged tables that nothing will read any more."""
    for df in tables:
        jvm, path = df.sparkSession._jvm, df.__dict__.pop("_staged", None)
        if path:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)
