"""Lineage events as a table, and reports of service levels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.quality_control import hops, lineage_edges

EVENTS = "event_id string, event_type string, job string, run_id string, inputs array<string>, outputs array<string>, event_time timestamp"


def record(events: DataFrame, new: DataFrame) -> DataFrame:
    """The events with new ones appended; states in upper case, missing inputs and outputs empty."""
    none = F.array().cast("array<string>")
    return events.unionByName(new.withColumns({"event_type": F.upper("event_type"), "inputs": F.coalesce("inputs", none), "outputs": F.coalesce("outputs", none)}).select(*events.columns))


def get_events(events: DataFrame, job: str | None = None, event_type: str | None = None, limit: int = 100) -> DataFrame:
    """The last ``limit`` events, of a job or a state if given."""
    out = events
    if job is not None:
        out = out.filter(F.col("job") == job)
    if event_type is not None:
        out = out.filter(F.col("event_type") == event_type)
    return out.orderBy(F.desc("event_time"), F.desc("event_id")).limit(limit)


def run_history(events: DataFrame, run_id: str) -> DataFrame:
    """All events of a run."""
    return events.filter(F.col("run_id") == run_id)


def summary(events: DataFrame) -> DataFrame:
    """Numbers of nodes, edges and events, and of events by state: ``what``, ``n``. Only started and completed jobs are in the graph."""
    edges = lineage_edges(events)
    live = events.filter(F.col("event_type").isin("START", "COMPLETE")).select(F.explode(F.concat(F.array("job"), "inputs", "outputs")).alias("id")).distinct()
    parts = [live.agg(F.lit("nodes").alias("what"), F.count(F.lit(1)).alias("n")), edges.agg(F.lit("edges").alias("what"), F.count(F.lit(1)).alias("n")), events.agg(F.lit("events").alias("what"), F.count(F.lit(1)).alias("n"))]
    out = events.groupBy(F.col("event_type").alias("what")).agg(F.count(F.lit(1)).alias("n"))
    for p in parts:
        out = out.unionByName(p)
    return out


def dataset_lineage(edges: DataFrame, dataset: str, max_hops: int = 10) -> tuple[DataFrame, DataFrame]:
    """What a data set comes from and goes to: nodes (``id``, ``hops``, negative upstream) and the edges among them."""
    start = edges.sparkSession.createDataFrame([(dataset,)], "id string")
    down = hops(edges, start, max_hops)
    up = hops(edges, start, max_hops, reverse=True).filter("hops > 0").withColumn("hops", -F.col("hops"))
    nodes = down.unionByName(up).groupBy("id").agg(F.min_by("hops", F.abs("hops")).alias("hops"))
    inside = edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")
    return nodes, inside


# -- service levels ----------------------------------------------------------------------------------------------------
def service_status(statuses: DataFrame, service: str, kind: str | None = None) -> DataFrame:
    """The status rows of a service, of one indicator if given."""
    out = statuses.filter(F.col("service") == service)
    return out if kind is None else out.filter(F.col("sli_type") == kind)


def recent_observations(df: DataFrame, service: str, ts: str, key: str, name: str | None = None, limit: int = 50) -> DataFrame:
    """The last ``limit`` observations, of one service if given."""
    out = df if name is None else df.filter(F.col(service) == name)
    return out.orderBy(F.desc(ts), F.desc(key)).limit(limit)


def compliance_report(statuses: DataFrame) -> DataFrame:
    """One row of statuses (``compliant``, ``alert``): services, compliant ones, and alerts by weight (fast pages are critical, slow ones high)."""
    return statuses.agg(
        F.count(F.lit(1)).alias("total_services"), F.count_if("compliant").alias("compliant_services"), F.count_if(~F.col("compliant")).alias("non_compliant_services"),
        F.count_if(F.col("alert") == "page_fast").alias("critical_alerts"), F.count_if(F.col("alert") == "page_slow").alias("high_alerts"),
    )
