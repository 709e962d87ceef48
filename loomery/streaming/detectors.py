"""Detectors on streams: the same recurrences as in batch, one state per key, late rows dropped by watermark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed_counts(stream: DataFrame, ts: str, key: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and means in event-time windows; rows later than the watermark are dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(F.col("w.start").alias("start"), key, "n", "mean")


def sessions(stream: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of each key, closed by a gap."""
    return stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def cusum_stream(stream: DataFrame, key: str, order: str, value: str, mean: float, std: float, k: float = 0.5, h: float = 5.0) -> DataFrame:
    """Two-sided CUSUM per key. Rows of a micro-batch are taken in order; state carries on between batches."""
    kind, when = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hi, lo = state.get if state.exists else (0.0, 0.0)
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value]):
            z = (v - mean) / std
            hi, lo, alarm = max(0.0, hi + z - k), max(0.0, lo - z - k), 0
            if hi > h:
                hi, alarm = 0.0, 1
            if lo > h:
                lo, alarm = 0.0, alarm or -1
            out.append((group[0], o, hi, lo, alarm))
        state.update((hi, lo))
        yield pd.DataFrame(out, columns=[key, order, "hi", "lo", "alarm"])

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(
        run, f"`{key}` {kind}, `{order}` {when}, hi double, lo double, alarm int", "hi double, lo double", "append", GroupStateTimeout.NoTimeout
    )


def last_n_zscore(stream: DataFrame, key: str, order: str, value: str, n: int = 50) -> DataFrame:
    """Distance of each value from the mean of the ``n`` before it, in their population deviations; 0 until there are ``n``."""
    kind, when = stream.schema[key].dataType.simpleString(), stream.schema[order].dataType.simpleString()

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(order)
        out = []
        for o, v in zip(rows[order], rows[value]):
            score = 0.0
            if len(held) >= n:
                past = pd.Series(held[-n:])
                std = past.std(ddof=0)
                score = abs(v - past.mean()) / std if std else 0.0
            out.append((group[0], o, float(score)))
            held = [*held[-(n - 1) :], float(v)]
        state.update((held,))
        yield pd.DataFrame(out, columns=[key, order, "score"])

    return stream.select(key, order, value).groupBy(key).applyInPandasWithState(run, f"`{key}` {kind}, `{order}` {when}, score double", "held array<double>", "append", GroupStateTimeout.NoTimeout)


def publish_gate(stream: DataFrame, reference: DataFrame, value: str, out: str, checkpoint: str, limit: float = 0.2):
    """Write-audit-publish per micro-batch: a batch whose PSI against the reference is below the limit is appended, else quarantined."""
    from loomery.operators.drift import audit_gate

    def audit(batch: DataFrame, number: int) -> None:
        ok = audit_gate(batch, reference, value, limit).first()
        target = "published" if ok is None or ok["published"] else "quarantine"
        batch.write.mode("overwrite").parquet(f"{out}/{target}/batch={number}")

    return stream.writeStream.foreachBatch(audit).option("checkpointLocation", checkpoint).start()
