"""Mixing sources to target weights by a low-discrepancy schedule (operator 6).

The documents of a source, in a seeded random order, form one long stream of tokens, cut into blocks of equally many;
a small source has smaller blocks. Slot ``i`` of the mix goes to the source whose interval of cumulative weights (target
tokens over block length) holds the ``i``-th van der Corput point; the slots of a source, ranked, take its blocks in turn,
and start again after the last. Any stretch of the mix
then holds the sources in proportion, and each source's share of tokens is off by a few blocks at most.

The points, the ranks and the running offsets are all computed in parallel: no group goes to one task. Only the table
of sources (one row each) is ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import source_key, words
from loomery.operators.ranking import hash_bucket, running_offsets
from loomery.session import stage_table

#: Cells of [0, 1) by which slots find their source.
CELLS = 4096


def _reversed(x: Column, bits: int = 32) -> Column:
    """The low ``bits`` of a number, in reverse."""
    x = x.bitwiseAND(F.lit((1 << bits) - 1))
    width = bits
    while width > 1:
        half = width // 2
        mask = sum(((1 << half) - 1) << at for at in range(0, bits, width))
        x = F.shiftleft(x.bitwiseAND(F.lit(mask)), half).bitwiseOR(F.shiftright(x, half).bitwiseAND(F.lit(mask)))
        width = half
    return x


def van_der_corput(i: Column) -> Column:
    """The ``i``-th point in base 2: the bits of ``i`` behind the point, in reverse. Different up to 2 ** 52, as far as doubles go."""
    return _reversed(i) / F.lit(2.0**32) + _reversed(F.shiftright(i, 32)) / F.lit(2.0**64)


def source_targets(sizes: DataFrame, max_epochs: int = 3) -> DataFrame:
    """Targets of sources: weights 1, 2, 3, repeating, by key; shares of the whole, each at most ``max_epochs`` sizes.

    ``sizes`` has ``src`` and ``source_size``. What a source cannot take is shared among the others by weight, until
    none is above its limit: that is ``least(limit, weight * level)`` for one level, found by ordering the sources by
    ``limit / weight``. Adds ``target``. Sources without words get nothing.
    """
    everything = Window.partitionBy(F.lit(0))
    by_key = Window.partitionBy(F.lit(0)).orderBy("src")
    limited = sizes.withColumn("weight", ((F.row_number().over(by_key) - 1) % 3 + 1).cast("double")).withColumns(
        {"limit": F.col("source_size") * F.lit(float(max_epochs)), "_t": F.sum("source_size").over(everything).cast("double")}
    )
    by_ratio = Window.partitionBy(F.lit(0)).orderBy("_ratio", "src")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    levels = limited.withColumn("_ratio", F.col("limit") / F.col("weight")).withColumn(
        "_level",
        (F.col("_t") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))),
    )
    # the first source, in that order, whose limit is not below the level reached: from it on nobody is limited
    level = F.min(F.when(F.col("_level") <= F.col("_ratio"), F.struct("_ratio", "src", "_level"))).over(everything)["_level"]
    shared = levels.withColumn("target", F.least(F.col("limit"), F.col("weight") * level))
    return shared.select("src", "source_size", "target")


def schedule(targets: DataFrame, max_block: int, least_blocks: int) -> DataFrame:
    """Add ``block``, the tokens of a block of each source (its size over ``least_blocks``, 1 to ``max_block``), ``lo`` and ``hi``, its part
    of [0, 1), and ``n_slots``, the slots of the whole mix: as many as the targets have blocks."""
    everything = Window.partitionBy(F.lit(0))  # one row a source
    by_key = everything.orderBy("src")
    cut = targets.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(max_block), F.floor(F.col("source_size") / least_blocks))).cast("long"))
    weighed = cut.withColumn("_w", F.col("target") / F.col("block"))
    upto, whole = F.sum("_w").over(by_key.rowsBetween(Window.unboundedPreceding, 0)), F.sum("_w").over(everything)
    out = weighed.withColumns({"hi": F.when(whole > 0, upto / whole).otherwise(0.0), "n_slots": F.ceil(whole)})
    return out.withColumn("lo", F.coalesce(F.lag("hi").over(by_key), F.lit(0.0))).drop("_w")


def mix(docs: DataFrame, seed: int = 29, max_block: int = 512, least_blocks: int = 4096, max_epochs: int = 3, key: str = "doc_id") -> DataFrame:
    """Mix ``docs`` (columns ``key``, ``source``, ``size``): one row each with ``source_size``, ``target``, ``taken``.

    ``taken`` counts tokens, repeats included. A source's blocks have ``source_size / least_blocks`` tokens, 1 to
    ``max_block``. The random order is that of a digest of seed, key and, if the caller gives one, ``_tie``, which tells
    rows apart whose keys are null or repeat. A document's last block may be cut; no document is taken more than ``max_epochs`` times. Documents without tokens and
    repeated rows keep a row each (``taken`` 0 for the former). Null sources form a source of their own, the last.
    ``docs`` is read twice: give it staged or cheap.
    """
    ties = [F.col("_tie").cast("string")] if "_tie" in docs.columns else []
    rows = docs.select(
        key, source_key("source").alias("src"), F.col("size").cast("long").alias("size"),
        F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(key).cast("string"), F.lit("null")), *ties)).alias("_mix"),
    ).withColumn("_cell", hash_bucket(F.col("_mix")))
    targets = source_targets(rows.groupBy("src").agg(F.sum("size").alias("source_size")), max_epochs)
    targets = stage_table(schedule(targets, max_block, least_blocks), "mix-targets")

    # Slot, point, cell, then the source of the cell that holds the point.
    n_slots = targets.agg(F.max("n_slots").alias("n")).first()["n"] or 0
    slots = docs.sparkSession.range(n_slots).withColumn("_u", van_der_corput(F.col("id"))).withColumn("_slot_cell", F.floor(F.col("_u") * CELLS))
    spans = targets.filter("hi > lo").select(
        "src", "lo", "hi", "source_size", "block",
        F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("_slot_cell"),
    )
    held = slots.join(spans, "_slot_cell").filter("_u >= lo AND _u < hi").withColumn("_run", F.expr("id div 65536"))
    held = running_offsets(held, ["src"], "_run", [F.col("id")], start="_rank", total="_of_source")
    n_blocks = F.expr("(source_size + block - 1) div block")
    uses = (
        held.withColumn("_n_blocks", n_blocks)
        .filter(F.expr(f"_rank < {max_epochs} * _n_blocks"))
        .groupBy("src", F.expr("_rank % _n_blocks").alias("at"))
        .agg(F.count(F.lit(1)).alias("uses"))
    )

    some = rows.filter("size > 0")
    laid = running_offsets(some, ["src"], "_cell", [F.col("_mix"), F.col(key), F.col("size")], F.col("size"), start="_start", total="_sum").join(
        F.broadcast(targets) if targets.count() <= 10_000 else targets, "src"
    )
    parts = laid.withColumn("at", F.explode(F.expr("sequence(_start div block, (_start + size - 1) div block)")))
    overlap = F.least(F.expr("_start + size"), F.expr("(at + 1) * block")) - F.greatest(F.col("_start"), F.expr("at * block"))
    taken = (
        parts.join(uses, ["src", "at"], "left")
        .groupBy("src", "_start", key, "size", "source_size", "target")
        .agg(F.sum(overlap * F.coalesce(F.col("uses"), F.lit(0))).alias("taken"))
        .select(key, "size", "source_size", "target", F.col("taken").cast("long"))
    )
    none = rows.filter("size = 0").join(targets, "src").select(key, "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    return taken.unionByName(none)


def op6_mixing(docs: DataFrame) -> DataFrame:
    """The contract of operator 6 over ``documents``; the size of a text is its number of words."""
    sized = docs.select("doc_id", "source", F.size(words("text")).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit(""))).alias("_tie"))
    return mix(stage_table(sized, "mix-sizes"))
