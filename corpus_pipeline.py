"""A corpus pipeline of the operators in ``loomery.llm``; each stage is written and read again before the next.

Language ID drops documents without text in a known language; line dedup takes lines of ten documents or more out of
all but the first of them; the Jaccard join leaves one document of each group of near duplicates; mixing repeats and
drops documents so that sources come near their target weights; encoding turns texts into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomery.llm import jaccard, language, lines, mixing, pieces
from loomery.llm.common import small_batches, words
from loomery.llm.queries import vocabulary
from loomery.session import stage_table, table

#: Ids of rejected duplicates up to this number are broadcast; more are joined by a shuffle.
MAX_IDS = 2_000_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose text is null, has no letter, or is in no learned language.

    That is, scored below the model's floor, which comes from the scores of the documents learned from. Without any
    labelled document, those with a letter stay. Null and repeated ids are rows like others; no rows: no rows.
    """
    small_batches(spark)
    model = language.fit(docs.filter(~language.held_out()).select("doc_id", "text", "lang"))
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    return language.predict(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= model.floor)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take lines of ten documents (rows) or more out of all but the first of them; drop documents left without a word.

    First is the least id, null last, then the least hash of the text. Null and repeated ids are rows like others.
    """
    small_batches(spark)
    index = lines.build(docs.select("text"), min_docs=10, min_chars=1)
    stripped = lines.strip_lines(docs, index, keep_first=True)
    return stripped.filter(F.col("text").rlike(r"[^\x20\x09-\x0D]")).withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one row of each component of texts with a Jaccard index of 0.8 or more over 5-word shingles.

    It is that of the least id, null last, then of the least text digest, source and language. Rows are told apart by a
    number of their own, fixed by writing it, so null and repeated ids are judged like others.
    """
    small_batches(spark)
    rows = stage_table(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    components = stage_table(jaccard.link_components(rows, percent=80, k=5, key="_row").select("_row", "component_id"), "row-components")
    grouped = components.join(components.filter("_row <> component_id").select("component_id").distinct(), "component_id")
    names = rows.select("_row", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.md5("text").alias("text"), "source", "lang", "_row").alias("name"))
    named = stage_table(grouped.join(names, "_row"), "row-names")
    kept = named.groupBy("component_id").agg(F.min("name")["_row"].alias("_row"))
    gone = stage_table(named.select("_row").join(kept.select("_row"), "_row", "left_anti"), "duplicates")
    return rows.join(F.broadcast(gone) if gone.count() <= MAX_IDS else gone, "_row", "left_anti").select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that sources come near their targets: as often as the mix takes their words, rounded.

    Rows go by a digest of all their columns, null or not. Equal rows share one and are mixed each for itself; as they
    can't be told apart, the sum of their times is dealt out among them.
    """
    keyed = docs.withColumn("_key", F.md5(F.to_json(F.struct(*[c for c in docs.columns if c != "text"], F.md5("text").alias("text")))))
    sized = stage_table(keyed.select("_key", "source", F.size(words("text")).cast("long").alias("size")), "mix-sizes")
    taken = mixing.mix(sized, key="_key").filter("size > 0")
    times = taken.groupBy("_key").agg(F.count(F.lit(1)).alias("_rows"), F.sum(F.floor(F.col("taken") / F.col("size") + 0.5)).alias("_sum")).filter("_sum > 0")
    ranked = keyed.join(times, "_key").withColumn("_at", F.row_number().over(Window.partitionBy("_key").orderBy("_key")))
    shared = ranked.withColumn("_times", F.expr("cast(_sum div _rows + if(_at <= _sum % _rows, 1, 0) AS int)")).filter("_times > 0")
    return shared.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number, and whether they decode to the same text. One row for each row."""
    small_batches(spark)
    return pieces.encode_rows(docs.select("doc_id", "lang", "source", "text"), vocabulary("piece_bpe_32k.model"))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: The language network and the piece encoder have no form in SQL; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stage_table(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
