"""Sharding by proportional stratified interleaving (operator 3).

Rows are put into a seeded random order within each source. The row of rank ``r`` (from 0) among the ``n`` of its
source stands at ``(r + 0.5) / n``; all rows are sorted by that fraction and the sequence is cut into equal parts. Each
part then holds, of every source, its share of the whole to within one or two rows: every shard matches the mixture.

Only keys, sizes and checksums are shuffled, never texts. Both rankings run over buckets
(:func:`loomery.operators.ranking.running_offsets`), so a source with a third of the rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.llm.common import source_key, whole
from loomery.operators.ranking import hash_bucket, running_offsets
from loomery.session import stage_table

#: Buckets of the fractions. Their sums are the only rows that meet in one task.
FRACTION_BUCKETS = 8192


def interleave(docs: DataFrame, n_shards: int, seed: int = 17, source: str = "source", key: str = "doc_id") -> DataFrame:
    """Return ``docs`` with ``shard`` (int) and ``slot`` (long, gapless from 0 within its shard).

    Law ``rows``: shard sizes differ by one row at most, and slots follow the interleaved order. The order depends on
    ``seed``, ``key`` and ``_tie`` (a checksum of the row, if the caller gives one); rows that are equal in all of them
    are interchangeable. Null sources form a source of their own. No rows: no rows. Other columns are kept.
    """
    ties = [F.col("_tie")] if "_tie" in docs.columns else []
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), *[x.cast("string") for x in ties]))
    rows = docs.withColumns({"_src": source_key(source), "_mix": digest}).withColumn("_cell", hash_bucket(F.col("_mix")))
    ranked = running_offsets(rows, ["_src"], "_cell", [F.col("_mix"), F.col(key), *ties], start="_rank", total="_n")
    # (rank + 0.5) / n as a double is exact enough to order ranks of one source; equal fractions go by source.
    fraction = (F.col("_rank") + F.lit(0.5)) / F.col("_n")
    placed = ranked.withColumn("_at", fraction).withColumn("_part", F.floor(F.col("_at") * FRACTION_BUCKETS).cast("int")).withColumn("_all", F.lit(0))
    placed = running_offsets(placed, ["_all"], "_part", [F.col("_at"), F.col("_src"), F.col("_rank")], start="_pos", total="_rows")
    shard = F.floor(F.col("_pos") * n_shards / F.col("_rows")) if n_shards == 1 else F.expr(f"(_pos * {n_shards}L) div _rows")
    first = F.expr(f"(shard * _rows + {n_shards - 1}L) div {n_shards}L")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("_pos") - first).cast("long"))
        .drop("_src", "_mix", "_cell", "_rank", "_n", "_at", "_part", "_all", "_pos", "_rows")
    )


def op3_sharding(docs: DataFrame) -> DataFrame:
    """The contract of operator 3 over ``documents``: 24 shards, law ``rows``.

    Texts of any length give a size and a checksum; only these are written and shuffled. Rows without id are numbered, so
    that any number of equal ones is spread over the cells of the order.
    """
    rows = docs.select("doc_id", "source", (F.octet_length(whole("text")) + 8).cast("long").alias("size"), F.crc32(whole("text")).alias("text_crc32"))
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    rows = stage_table(rows.withColumn("_tie", F.concat_ws(":", F.col("text_crc32").cast("string"), number.cast("string"))), "shard-keys")
    return interleave(rows, 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
