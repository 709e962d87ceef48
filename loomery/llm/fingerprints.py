"""Document fingerprints from closed syncmers (operator 1), in DataFrame functions only.

A text is a row of words; an s-mer is ``S`` of them, a k-mer ``K``. A k-mer is a closed syncmer if the least of the
hashes of its s-mers is that of its first or its last. Whether it is one depends on its own words alone, so the same
passage gives the same anchors in every document, whatever stands around it. The fingerprint is the sketch of the
``SKETCH`` least anchor hashes; the likeness of two is the estimate of the Jaccard index of their anchors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import whole, words
from loomery.session import stage_table

K, S = 5, 2
SKETCH = 128
#: Neighbouring ids are dealt into spans of equal width, and each span into blocks of about so many rows, and so many
#: blocks at most (the tables of spans and blocks are broadcast).
SPANS, BLOCK_ROWS, MAX_BLOCKS = 4096, 512, 100_000


def _word_hashes(word_array: Column) -> Column:
    return F.transform(word_array, lambda w: F.xxhash64(w))


def _smer_hashes(hashes: Column) -> Column:
    return F.transform(F.slice(hashes, 1, F.greatest(F.size(hashes) - (S - 1), F.lit(0))), lambda h, i: F.xxhash64(h, *[F.get(hashes, i + j) for j in range(1, S)]))


def _closed(sm: Column, x: Column, i: Column) -> tuple[Column, list[Column]]:
    inside = [x, *[F.get(sm, i + j) for j in range(1, K - S + 1)]]
    return F.least(*inside).isin(x, inside[-1]) & inside[-1].isNotNull(), inside


def anchors(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add ``anchors``: structs of ``pos`` (the word at which a closed syncmer starts, from 0) and ``hash``, in order.

    For positional matching of passages between documents. Texts with words but without a closed syncmer (under
    ``K`` words, and some of ``K`` or ``K + 1``) have one anchor, of all their words; texts without words (null, empty)
    have none.
    """
    step = docs.withColumn("_w", words(text)).withColumn("_h", _word_hashes(F.col("_w"))).withColumn("_sm", _smer_hashes(F.col("_h")))

    def place(x, i):
        chosen, inside = _closed(F.col("_sm"), x, i)
        return F.when(chosen, F.struct(i.alias("pos"), F.xxhash64(*inside).alias("hash")))

    found = F.filter(F.transform("_sm", place), lambda a: a.isNotNull())
    short = F.array(F.struct(F.lit(0).alias("pos"), F.xxhash64("_h").alias("hash")))
    return step.withColumn("_found", found).withColumn(
        "anchors", F.when((F.size("_found") == 0) & (F.size("_w") > 0), short).otherwise(F.col("_found"))
    ).drop("_w", "_h", "_sm", "_found")


def with_sketch(docs: DataFrame, text: str = "text", out: str = "sketch") -> DataFrame:
    """Add the sketch of a text: the least ``SKETCH`` distinct anchor hashes (32 bits each), ascending; empty without words."""
    step = docs.withColumn("_h", _word_hashes(words(text))).withColumn("_sm", _smer_hashes(F.col("_h")))

    def low(h: Column) -> Column:
        return h.bitwiseAND(F.lit(0xFFFFFFFF))

    def pick(x, i):
        chosen, inside = _closed(F.col("_sm"), x, i)
        return F.when(chosen, low(F.xxhash64(*inside)))

    found = F.sort_array(F.array_distinct(F.array_compact(F.transform("_sm", pick))))
    short = F.array(low(F.xxhash64("_h")))
    # a text with words has an anchor: that of all its words where no syncmer is closed
    return step.withColumn("_found", F.slice(found, 1, SKETCH)).withColumn(
        out, F.when((F.size("_found") == 0) & (F.size("_h") > 0), short).otherwise(F.col("_found"))
    ).drop("_h", "_sm", "_found")


def fingerprint(sketch: Column) -> Column:
    """A sketch as text: eight hex digits a hash; empty for a text without words."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.lower(F.hex(h)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard index of two sketches, 0 to 1; two empty ones are equal."""
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(F.array_intersect(a, b), union))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def _image(key: Column, kind: str) -> Column:
    """A whole number that doesn't fall where the key grows: the number itself, or the first bytes of a text."""
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(key, "utf-8"), 1, 7)), 14, "0"), 16, 10).cast("decimal(38,0)")
    return F.floor(key.cast("double") * 1024).cast("decimal(38,0)") if kind in ("double", "float") else F.floor(key.cast("decimal(38,6)")).cast("decimal(38,0)")


def key_blocks(docs: DataFrame, key: str, tie: str) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``_block``, a number that grows with ``key`` (nulls first) and, within equal keys, falls with ``tie``; and the blocks.

    Spans of equal width are counted, and each is cut into as many blocks as its rows need, by the range of its own keys.
    An id that fills more than a block by itself, or null, is cut further by ``tie``, an unsigned 32-bit checksum. So ids
    that lie far from the others, null ids and repeated ids make no large block. The blocks come as ``_block``, ``_first``
    (its greatest key and least tie) and ``_to``, the block before it in descending order.
    """
    image = _image(F.col(key), docs.schema[key].dataType.typeName())
    ids = docs.select(key, tie, image.alias("_at"))
    seen = ids.agg(F.min("_at").alias("lo"), F.max("_at").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, width = int(seen["lo"] or 0), (int(seen["hi"] or 0) - int(seen["lo"] or 0)) // SPANS + 1
    rows_each = max(BLOCK_ROWS, -(-seen["n"] // (MAX_BLOCKS - 2 * SPANS)))
    span = F.coalesce(F.floor((F.col("_at") - F.lit(lo).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")).cast("long"), F.lit(-1).cast("long"))
    need = lambda n: F.ceil(n / rows_each).cast("long")
    known = ids.withColumn("_span", span).groupBy("_span").agg(F.min("_at").alias("_lo"), F.max("_at").alias("_hi"), need(F.count(F.lit(1))).alias("_parts"))
    known = stage_table(known, "spans")

    def parted(df: DataFrame) -> DataFrame:
        both = df.withColumn("_at", image).withColumn("_span", span).join(F.broadcast(known), "_span")  # SPANS rows and one
        by_key = F.floor((F.col("_at") - F.col("_lo")).cast("double") / (F.col("_hi") - F.col("_lo") + 1).cast("double") * F.col("_parts"))
        part = F.greatest(F.lit(0), F.least(F.coalesce(by_key, F.lit(0)), F.col("_parts") - 1))
        return both.withColumn("_part", ((F.col("_span") + 1) * F.lit(1 << 17) + part).cast("long")).drop("_at", "_span", "_lo", "_hi", "_parts")

    # keys that fill more than a block, null among them: MAX_BLOCKS at most
    hot = docs.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > rows_each)
    hot = parted(hot).groupBy("_part").agg(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), need(F.col("_n")).alias("parts")))).alias("_hot"))
    hot = stage_table(hot, "hot-keys")

    def placed(df: DataFrame) -> DataFrame:
        both = parted(df).join(F.broadcast(hot), "_part", "left")
        own = F.filter("_hot", lambda h: h["k"].eqNullSafe(F.col(key)))
        below = F.size(F.filter("_hot", lambda h: h["k"] < F.col(key)))
        cut = F.try_element_at(own, F.lit(1))["parts"]
        by_tie = F.greatest(F.lit(0), cut - 1 - F.floor(F.col(tie) * cut / float(1 << 32)))
        inner = F.coalesce((2 * below + F.least(F.size(own), F.lit(1))) * F.lit(1 << 17), F.lit(0)) + F.coalesce(by_tie, F.lit(0))
        return both.withColumn("_block", (F.col("_part") * F.lit(1 << 33) + F.when(F.col("_hot").isNull(), 0).otherwise(inner)).cast("long")).drop("_part", "_hot")

    first = F.struct(F.col(key).isNotNull().alias("k"), F.col(key).alias("v"), (-F.col(tie)).alias("t"))
    blocks = placed(docs.select(key, tie)).groupBy("_block").agg(F.max(first).alias("_first"))
    every = Window.partitionBy(F.lit(0))  # some times MAX_BLOCKS rows at most
    up = every.orderBy("_block")
    edges = blocks.select("_block", "_first", F.coalesce(F.lead("_block").over(up), F.min("_block").over(every)).alias("_to"))
    return placed(docs), stage_table(edges, "blocks")


def with_next(docs: DataFrame, columns: list[str], key: str = "doc_id", tie: str = "_tie") -> DataFrame:
    """Add ``next_<column>`` of the next row by descending ``key`` (nulls last, then ``tie``); after the last, the first.

    Rows are dealt into blocks of neighbouring keys; a copy of the first row of a block goes along to the block before
    it. So one shuffle does, no task sees more than a few blocks, and the only tables that are ordered as a whole, and
    broadcast, are those of spans and blocks. Rows equal in key and tie are interchangeable. ``key`` is a number or a text.
    """
    rows, edges = key_blocks(docs, key, tie)
    head = rows.join(F.broadcast(edges), "_block").filter(F.col(key).eqNullSafe(F.col("_first.v")) & (F.col(tie) == -F.col("_first.t")))
    # of rows equal in both, one goes along
    heads = head.withColumn("_block", F.col("_to")).drop("_first", "_to").dropDuplicates(["_block", key, tie])
    both = rows.withColumn("_copy", F.lit(0)).unionByName(heads.withColumn("_copy", F.lit(1)))
    window = Window.partitionBy("_block").orderBy("_copy", F.col(key).desc_nulls_last(), F.col(tie))
    return both.withColumns({f"next_{c}": F.lead(c).over(window) for c in columns}).filter("_copy = 0").drop("_block", "_copy")


def op1_fingerprints(docs: DataFrame) -> DataFrame:
    """The contract of operator 1 over ``documents``: each text against its edited text and the next document's.

    Null text counts as empty, with an empty fingerprint. Of documents with one id the least checksum comes first; null
    ids come last. A single document follows itself. Texts of any length are taken whole; no rows: no rows.
    """
    base = with_sketch(docs.select("doc_id", whole("text").alias("text"))).withColumn("_tie", F.crc32("text"))
    paired = with_next(base, ["text", "sketch"])
    n = F.char_length("text")
    edited = paired.select(
        "doc_id", n.cast("long").alias("n_chars"), "sketch", "next_sketch",
        F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.substring("next_text", F.lit(1), F.floor(n / 3).cast("int"))).alias("edited"),
    )
    both = with_sketch(edited, "edited", "edited_sketch")
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sketch")).alias("fingerprint"), fingerprint(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
    )
