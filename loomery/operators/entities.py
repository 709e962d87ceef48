"""Entities by rule, conformal sets of their types, labelling pools and scores of spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.text import decode_bio, uncertainty

# Patterns of entity types, and of entities in chunks.
PATTERNS = {
    "PER": r"\b[А-ЯЁ][а-яё]+\s+[А-ЯЁ][а-яё]+(?:\s+[А-ЯЁ][а-яё]+)?\b",
    "ORG": r"\b(?:ОАО|ЗАО|ООО|ПАО|АО|ИП)\s+[«\"]?[А-ЯЁA-Z][а-яёa-zA-Z\s]+[»\"]?|\b(?:Газпром[а-яё]*|Яндекс[а-яё]*|Сбербанк[а-яё]*|Tesla|Google|Apple|Microsoft|Amazon)\b",
    "LOC": r"\b(?:Москв[а-яё]*|Санкт-Петербург[а-яё]*|Казан[а-яё]*|Новосибирск[а-яё]*|Екатеринбург[а-яё]*|Росси[а-яё]*|США|Кита[а-яё]*|Германи[а-яё]*|Франци[а-яё]*)\b",
}
CHUNK_PATTERNS = {
    "DATE": r"\b(?:January|February|March|April|May|June|July|August|September|October|November|December)(?:\s+\d{1,2},?)?\s+\d{4}\b|\b\d{4}-\d{2}-\d{2}\b|\bQ[1-4]\s+\d{4}\b",
    "ORG": r"\b(?:[A-Z][a-zA-Z&]+\s+){1,4}(?:Inc\.|Corp\.|LLC|Ltd\.|GmbH|Company|Organization|Association|Institute|University|Department|Group|Systems|Technologies|Services|Platform|Labs)(?=[^A-Za-z]|$)",
    "CONCEPT": r"\"[A-Za-z][^\"]{2,60}\"|\b[A-Z]{2,10}\b",
    "PERSON": r"\b(?:Mr\.|Mrs\.|Ms\.|Dr\.|Prof\.)\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*\b",
}


def _matches(text: Column, patterns: dict[str, str]) -> Column:
    """All matches of all patterns: structs of ``kind`` and ``text``, by pattern, then in order."""
    def named(kind: str):
        return lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("text"))

    return F.flatten(F.array(*[F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), named(k)) for k, p in patterns.items()]))


def rule_entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """People, organisations and places of Russian texts: ``kind``, ``text``, ``start``; of overlapping ones the first stays.

    Equal matches of a text are told apart by their order, so each has its own place.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.select(key, t.alias("_t"), F.explode(_matches(t, PATTERNS)).alias("m")).select(key, "_t", "m.kind", "m.text")
    same = Window.partitionBy(key, "kind", "text")
    numbered = found.withColumn("_n", F.row_number().over(same.orderBy(F.lit(0))))
    # the n-th match of a string starts where what lies before its n-th occurrence ends
    head = F.expr("substring_index(_t, text, cast(_n AS int))")
    placed = numbered.select(key, "kind", "text", F.length(head).alias("start")).withColumn("end", F.col("start") + F.length("text"))
    return _without_overlaps(placed, key)


def _without_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """Spans of each key in order of their start, without those that begin before the end of one kept."""
    order = F.sort_array(F.collect_list(F.struct("start", F.col("kind").alias("kind"), "text", "end")))
    kind = "struct<last:int,kept:array<struct<start:int,kind:string,text:string,end:int>>>"
    # the spans of one text: a short list
    keep = F.aggregate(
        order, F.struct(F.lit(-1), F.array()).cast(kind),
        lambda a, x: F.when(x["start"] >= a["last"], F.struct(x["end"].alias("last"), F.concat(a["kept"], F.array(x)).alias("kept"))).otherwise(a).cast(kind),
    )
    return spans.groupBy(key).agg(keep["kept"].alias("kept")).select(key, F.explode("kept").alias("s")).select(key, "s.kind", "s.text", "s.start")


def chunk_entities(df: DataFrame, key: str, text: str) -> DataFrame:
    """Dates, organisations, concepts and people of texts, once per text and kind: ``kind``, ``text`` and ``entity``, its lower case."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = df.select(key, F.explode(_matches(t, CHUNK_PATTERNS)).alias("m"))
    bare = F.trim(F.regexp_replace("m.text", '^"|"$', ""))
    return found.select(key, F.col("m.kind").alias("kind"), bare.alias("text"), F.lower(bare).alias("entity")).filter(F.length("text") >= 2).dropDuplicates([key, "kind", "entity"])


# -- conformal sets ----------------------------------------------------------------------------------------------------
def pattern_score(text: Column, label: str) -> Column:
    """1 if the whole text is a match of a type's pattern, .6 if a part is, else 0."""
    bare, p = F.trim(text), PATTERNS[label]
    return F.when(bare.rlike(f"^(?:{p})$"), 1.0).when(bare.rlike(p), 0.6).otherwise(0.0)


def nonconformity(text: Column) -> Column:
    """A map from type to 1 less its share of the pattern scores; 2/3 for all if nothing matches."""
    scores = {k: pattern_score(text, k) for k in PATTERNS}
    total = sum(scores.values(), F.lit(0.0))
    return F.create_map(*[x for k, v in scores.items() for x in (F.lit(k), F.when(total == 0, 1.0 - 1.0 / len(PATTERNS)).otherwise(1.0 - v / total))])


def prediction_sets(df: DataFrame, text: str, label: str, q_hat: float) -> DataFrame:
    """Add ``score`` (of the entity's own type), ``prediction_set`` (types scored ``q_hat`` or less; else its own) and ``is_certain``."""
    scores = nonconformity(F.col(text))
    chosen = F.map_keys(F.map_filter("_s", lambda k, v: v <= q_hat))
    out = df.withColumn("_s", scores).withColumn("prediction_set", F.when(F.size(chosen) == 0, F.array(F.col(label))).otherwise(chosen))
    return out.withColumns({"score": F.round(F.try_element_at("_s", F.col(label)), 4), "is_certain": F.size("prediction_set") == 1}).drop("_s")


def labelling_batch(df: DataFrame, key: str, scores: str, labelled: DataFrame | None = None, n: int = 10, strategy: str = "least_confidence") -> DataFrame:
    """The ``n`` most uncertain unlabelled texts by their array of nonconformity scores: ``uncertainty``, ties by key."""
    pool = df if labelled is None else df.join(labelled.select(key), key, "left_anti")
    found = F.when(F.size(scores) <= 0, 0.0).otherwise(uncertainty(F.col(scores), strategy))
    return pool.select(key, F.round(F.coalesce(found, F.lit(0.0)), 6).alias("uncertainty")).orderBy(F.desc("uncertainty"), key).limit(n)


def span_scores(true: DataFrame, pred: DataFrame, sentence: str, position: str, token: str, tag: str) -> DataFrame:
    """Precision, recall and F1 of predicted BIO spans, by kind and over all (null kind), and the number of true spans."""
    def spans(df: DataFrame, side: str) -> DataFrame:
        ends = decode_bio(df, sentence, position, token, tag)
        return ends.select(sentence, "kind", "start", F.size(F.split("text", " ")).alias("size"), F.lit(1).alias(side))

    both = spans(true, "t").join(spans(pred, "p"), [sentence, "kind", "start", "size"], "full_outer").fillna(0, ["t", "p"])
    out = both.rollup("kind").agg(F.sum("t").alias("support"), F.sum("p").alias("predicted"), F.sum(F.col("t") * F.col("p")).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "predicted"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "support"), F.lit(0.0))
    return out.select("kind", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"), "support")


def tag_counts(df: DataFrame, sentence: str, tag: str) -> DataFrame:
    """Size of a tagged set: sentences, tokens, and entities (B- tags) by kind; kind is null for the whole."""
    kind = F.when(F.col(tag).startswith("B-"), F.col(tag).substr(F.lit(3), F.length(tag)))
    whole = df.agg(F.count_distinct(sentence).alias("n_sentences"), F.count(F.lit(1)).alias("n_tokens"), F.count(kind).alias("n_entities"))
    each = df.filter(kind.isNotNull()).groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n_entities"))
    return whole.select(F.lit(None).cast("string").alias("kind"), "*").unionByName(each, allowMissingColumns=True)


def knowledge_stats(df: DataFrame, entity: str, kind: str) -> DataFrame:
    """Entities by type, and of all (null type)."""
    return df.rollup(kind).agg(F.count_distinct(entity).alias("n_entities"))


def exact_lookup(mentions: DataFrame, mention: str, aliases: DataFrame, alias: str, entity: str) -> DataFrame:
    """The entity whose alias a mention is, white space and case aside; the least of several; null if none."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))
    known = aliases.select(norm(alias).alias("_n"), F.col(entity).alias("_e")).groupBy("_n").agg(F.min("_e").alias(entity))
    return mentions.withColumn("_n", norm(mention)).join(known, "_n", "left").drop("_n")
