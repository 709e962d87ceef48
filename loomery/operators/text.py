"""Text retrieval: tokens, chunks, BM25, fusion, reranking, metrics, lexical judgements, memory, entities."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.operators.recsys import top_k

# Words that carry no content in lexical judgements, and the signs that are taken out of a text first.
STOP_WORDS = (
    "a an the is are was were be been being have has had do does did will would could should may might shall can need dare ought to of in on at by for with from into through during before after above below "
    "and or but if because as until while that this it its not no nor so yet both either neither just than then when where who which how what "
    "и в на с по из за к о от до у под над при без для или но а не это что как то все он она они мы вы я его её их нас вас ему ей им же ли уже ещё даже тоже также себя"
).split()
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»—–„“”"
# Words that point back to an earlier turn.
REFERENCE_WORDS = "it this that they them their these those such same above mentioned described said previous aforementioned".split()


def tokens(text: Column) -> Column:
    """Lower-cased Unicode words."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(?U)(\w+)"), F.lit(1))


def content_tokens(text: Column) -> Column:
    """Distinct words without stop words: lower case, punctuation taken out, split at white space."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    words = F.filter(F.split(bare, r"(?U)\s+"), lambda w: w != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def judged_sentences(text: Column) -> Column:
    """Sentences of over five characters, cut after . ! or ? and white space."""
    parts = F.split(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")), lambda s: F.length(s) > 5)


def sentences(text: Column) -> Column:
    """Sentences: paragraphs at blank lines, cut after . ! or ? and white space; empty ones dropped."""
    parts = F.transform(F.split(text, r"\n\s*\n"), lambda p: F.split(F.trim(p), r"(?<=[.!?])\s+"))
    return F.filter(F.flatten(parts), lambda s: F.trim(s) != "")


def merge_chunks(parts: Column, most: int = 1200, sep: str = "\n\n") -> Column:
    """Greedy merge of texts up to ``most`` characters; a longer one stays alone."""
    def step(acc, x):
        last = F.element_at(acc, -1)
        fits = (F.size(acc) > 0) & (F.length(F.try_element_at(acc, F.lit(-1))) + len(sep) + F.length(x) <= most)
        del last
        return F.when(fits, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.try_element_at(acc, F.lit(-1)), F.lit(sep), x)))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def paragraph_chunks(df: DataFrame, key: str, text: str, most: int = 1200) -> DataFrame:
    """Paragraphs merged up to ``most`` characters, one row per chunk."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    return df.select(key, F.posexplode(merge_chunks(parts, most)).alias("chunk_index", "chunk"))


def fixed_chunks(df: DataFrame, key: str, text: str, size: int = 512, overlap: int = 64) -> DataFrame:
    """Chunks of ``size`` characters at most, cut at paragraphs, else lines, sentences, words, characters: one row per chunk.

    Parts that fit are put together again, and a chunk begins with the last parts of the one before, ``overlap``
    characters of them at most. White space at both ends of a chunk is taken off; empty chunks are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch[key], batch[text]):
                found = split_text(t or "", SEPARATORS, size, overlap)
                if found:
                    yield pd.DataFrame({key: [k] * len(found), "chunk_index": range(len(found)), "chunk": found})

    return df.select(key, text).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, chunk_index int, chunk string")


# Where texts are cut, the best first.
SEPARATORS = ["\n\n", "\n", ". ", " ", ""]


def split_text(text: str, separators: list[str], size: int, overlap: int) -> list[str]:
    """The chunks of a text. A separator stays at the start of the part that follows it."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    sep, rest = separators[at], separators[at + 1 :]
    if sep:
        first, *others = text.split(sep)
        parts = ([first] if first else []) + [sep + x for x in others]
    else:
        parts = list(text)
    out, small = [], []
    for part in parts:
        if len(part) < size:
            small.append(part)
            continue
        out += _put_together(small, size, overlap)
        small = []
        out += split_text(part, rest, size, overlap) if rest else [part]
    return out + _put_together(small, size, overlap)


def _put_together(parts: list[str], size: int, overlap: int) -> list[str]:
    out, held, total = [], deque(), 0
    for part in parts:
        if held and total + len(part) > size:
            out.append("".join(held).strip())
            while held and (total > overlap or total + len(part) > size):
                total -= len(held.popleft())
        held.append(part)
        total += len(part)
    out.append("".join(held).strip())
    return [x for x in out if x]


def topic_chunks(df: DataFrame, key: str, text: str, least: float = 0.3, most: int = 1200) -> DataFrame:
    """Sentences joined until the term vectors of two neighbours differ (cosine below ``least``) or a chunk is full.

    Sentences and tokens are Spark's; a text's chunks are made where its row is, so that nothing moves between tasks.
    """
    parts = df.select(F.col(key).alias("key"), sentences(F.col(text)).alias("s")).filter(F.size("s") > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, index, chunks = [], [], []
            for i in range(batch.num_rows):
                found = _joined(batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), least, most)
                row += [i] * len(found)
                index += range(len(found))
                chunks += found
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(index, pa.int32()), pa.array(chunks, pa.string())], names=["key", "chunk_index", "chunk"])

    out = parts.withColumn("t", F.transform("s", tokens)).mapInArrow(run, f"key {df.schema[key].dataType.simpleString()}, chunk_index int, chunk string")
    return out.withColumnRenamed("key", key)


def _joined(parts: list[str], terms: list[list[str]], least: float, most: int) -> list[str]:
    """The chunks of a text's sentences. A run of likes is cut where its length passes a multiple of ``most``."""
    out, before, n0, size, at = [], Counter(), 0.0, 0, -1
    for sentence, words in zip(parts, terms):
        w = Counter(words)
        n = math.sqrt(sum(c * c for c in w.values()))
        d = sum(c * before[t] for t, c in w.items() if t in before)
        if (d / (n * n0) if d else 0.0) < least:
            size, at = 0, -1
        size += len(sentence) + 1
        if at != size // most or not out:
            out.append([])
            at = size // most
        out[-1].append(sentence)
        before, n0 = w, n
    return [" ".join(x) for x in out]


def bm25(docs: DataFrame, doc: str, text: str, queries: DataFrame, query: str, query_text: str, k: int = 10, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """The ``k`` best documents of each query by BM25 (plain idf, floored at 0), scores above 0; ties by document id.

    Only postings of query terms are scored: the terms of the queries are joined to the documents' tokens.
    """
    toks = docs.select(F.col(doc).alias("doc"), tokens(F.coalesce(F.col(text), F.lit(""))).alias("_t"))
    q = queries.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(F.col(query_text)))).alias("term"))
    stats = F.broadcast(toks.agg(F.count(F.lit(1)).alias("n_docs"), F.avg(F.size("_t")).alias("avg_len")))
    postings = toks.select("doc", F.size("_t").alias("len"), F.explode("_t").alias("term")).join(q.select("term").distinct(), "term", "left_semi").groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(stats)  # one row
    idf = F.greatest(F.lit(0.0), F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    weight = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    scored = postings.join(df, "term").withColumn("w", weight).filter("w > 0").join(q, "term").groupBy("query", "doc").agg(F.round(F.sum("w"), 6).alias("score")).filter("score > 0")
    return top_k(scored, ["query"], [F.desc("score"), F.col("doc")], k)


def rrf(lists: DataFrame, query: str, item: str, rank: str, k: int = 60, n: int = 5) -> DataFrame:
    """Reciprocal rank fusion of ranked lists given as rows."""
    s = lists.groupBy(query, item).agg(F.round(F.sum(1.0 / (k + F.col(rank))), 6).alias("rrf"))
    return top_k(s, [query], [F.desc("rrf"), F.col(item)], n)


def rerank_scores(candidates: DataFrame, query: str, query_text: str, item: str, text: str) -> DataFrame:
    """Coverage, term weight and early position of query terms (over two characters) in each candidate: .5, .35, .15."""
    long = lambda c: F.filter(tokens(F.coalesce(F.col(c), F.lit(""))), lambda t: F.length(t) > 2)
    rows = candidates.select(query, item, F.array_distinct(long(query_text)).alias("q"), long(text).alias("p"))
    per = rows.withColumn("found", F.array_intersect("q", F.array_distinct("p")))
    n = Window.partitionBy(query)
    counted = per.withColumn("_n", F.count(F.lit(1)).over(n)).select("*", F.explode_outer("q").alias("t"))
    term = counted.withColumn("_has", F.array_contains("p", F.col("t"))).withColumn("_df", F.sum(F.col("_has").cast("int")).over(Window.partitionBy(query, "t")))
    idf = F.ln(1 + F.col("_n") / (1 + F.col("_df")))
    tf = F.size(F.filter("p", lambda x: x == F.col("t"))) / F.size("p")
    early = F.array_contains(F.slice("p", 1, F.greatest(F.lit(1), F.floor(F.size("p") / 4).cast("int"))), F.col("t"))
    agg = term.groupBy(query, item).agg(
        F.avg(F.col("_has").cast("double")).alias("coverage"), F.sum(F.when(F.col("_has"), tf * idf).otherwise(0.0)).alias("_tf"), F.avg(idf).alias("_idf"), F.avg(early.cast("double")).alias("position")
    )
    weight = F.least(F.lit(1.0), F.col("_tf") / (F.col("_idf") + 1e-9))
    return agg.select(query, item, *[F.coalesce(x, F.lit(0.0)).alias(c) for c, x in (("coverage", F.col("coverage")), ("tf_score", weight), ("position", F.col("position")))]).withColumn(
        "rerank_score", 0.5 * F.col("coverage") + 0.35 * F.col("tf_score") + 0.15 * F.col("position")
    )


def ir_metrics(ranked: DataFrame, relevant: DataFrame, query: str, item: str, rank: str, k: int) -> DataFrame:
    """Precision, recall, reciprocal rank, average precision and nDCG at ``k`` per query with relevant items."""
    n = relevant.groupBy(query).agg(F.count(F.lit(1)).alias("n_rel"))
    hits = ranked.filter(F.col(rank) <= k).join(relevant.select(query, item, F.lit(1).alias("hit")), [query, item])
    w = Window.partitionBy(query).orderBy(rank)
    at = hits.withColumn("_h", F.row_number().over(w))
    s = at.groupBy(query).agg(F.count(F.lit(1)).alias("h"), F.min(rank).alias("first"), F.sum(F.col("_h") / F.col(rank)).alias("ap"), F.sum(1 / F.log2(F.col(rank) + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_rel"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1.0))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    return n.join(s, query, "left").select(
        query, z(F.col("h") / k).alias("precision"), z(F.col("h") / F.col("n_rel")).alias("recall"), z(1 / F.col("first")).alias("rr"), z(F.col("ap") / F.col("n_rel")).alias("ap"), z(F.col("dcg") / ideal).alias("ndcg")
    )


def context_precision(question: Column, contexts: Column) -> Column:
    """Share of the contexts (array) that share a content word with the question; 0 without contexts or content words."""
    q = content_tokens(question)
    hit = F.size(F.filter(contexts, lambda c: F.arrays_overlap(content_tokens(c), q)))
    return F.when((F.size(contexts) <= 0) | (F.size(q) == 0), 0.0).otherwise(hit / F.size(contexts))


def context_recall(answer: Column, contexts: Column) -> Column:
    """Share of the answer's sentences that share a content word with any context; 0 without either."""
    parts, known = judged_sentences(answer), F.array_distinct(F.flatten(F.transform(contexts, content_tokens)))
    hit = F.size(F.filter(parts, lambda s: F.arrays_overlap(content_tokens(s), known)))
    return F.when((F.size(parts) <= 0) | (F.size(contexts) <= 0), 0.0).otherwise(hit / F.size(parts))


def answer_relevance(question: Column, answer: Column) -> Column:
    """Jaccard index of the content words of question and answer; 0 if either has none."""
    q, a = content_tokens(question), content_tokens(answer)
    return F.when((F.size(q) <= 0) | (F.size(a) <= 0), 0.0).otherwise(F.size(F.array_intersect(q, a)) / F.size(F.array_union(q, a)))


def faithfulness(answer: Column, context: Column) -> Column:
    """:func:`context_recall` for one text or an array of contexts."""
    return context_recall(answer, context)


def judged(df: DataFrame, question: str, answer: str, contexts: str) -> DataFrame:
    """Add the four lexical measures of a sample, and ``overall``, their mean."""
    q, a, c = F.coalesce(F.col(question), F.lit("")), F.coalesce(F.col(answer), F.lit("")), F.coalesce(F.col(contexts), F.array().cast("array<string>"))
    out = df.withColumns({"context_precision": context_precision(q, c), "context_recall": context_recall(a, c), "answer_relevance": answer_relevance(q, a)})
    out = out.withColumn("faithfulness", F.col("context_recall"))
    return out.withColumn("overall", (F.col("context_precision") + F.col("context_recall") + F.col("answer_relevance") + F.col("faithfulness")) / 4)


MEASURES = ["context_precision", "context_recall", "answer_relevance", "faithfulness", "overall"]


def judged_means(samples: DataFrame) -> DataFrame:
    """Means of the measures over all samples, to 4 places, and their number; zeros without samples."""
    return samples.agg(*[F.coalesce(F.round(F.avg(c), 4), F.lit(0.0)).alias(c) for c in MEASURES], F.count(F.lit(1)).alias("num_samples"))


def ir_report(metrics: DataFrame) -> DataFrame:
    """Macro means of per-query retrieval measures, each rounded to 4 places before."""
    names = [c for c in ("precision", "recall", "rr", "ap", "ndcg") if c in metrics.columns]
    return metrics.agg(*[F.round(F.avg(F.round(c, 4)), 4).alias(c) for c in names], F.count(F.lit(1)).alias("n_queries"))


def keyword_relevance(chunks: DataFrame, chunk: str, text: str, queries: DataFrame, query: str, keywords: str, least: int = 2) -> DataFrame:
    """Pairs of query and chunk where at least ``least`` of the query's keywords occur, case ignored; with their number.

    Any text may hold any keyword, so queries meet chunks without a key: up to 10000 queries are sent along with the tasks.
    """
    asked = queries.select(F.col(query).alias("query"), F.transform(F.col(keywords), lambda k: F.lower(k)).alias("_k"))
    known = F.size(F.filter("_k", lambda k: F.contains(F.col("_t"), k)))
    both = chunks.select(F.col(chunk).alias("chunk"), F.lower(F.col(text)).alias("_t")).join(F.broadcast(asked) if asked.count() <= 10_000 else asked, known >= least)
    return both.select("query", "chunk", known.alias("n_keywords"))


def cooccurrence(mentions: DataFrame, chunk: str, entity: str) -> DataFrame:
    """Pairs of different entities mentioned in the same chunk, with the number of chunks."""
    m = mentions.select(F.col(chunk).alias("c"), F.col(entity).alias("e")).distinct()
    return m.alias("a").join(m.alias("b"), "c").filter(F.col("a.e") < F.col("b.e")).groupBy(F.col("a.e").alias("a"), F.col("b.e").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def rewrite_queries(df: DataFrame, session: str, order: str, question: str, answer: str | None = None, turns: int = 3) -> DataFrame:
    """Short questions (five words or fewer) or such with a reference word get the last ``turns`` turns as context.

    A turn is its question and, if there is one, up to 120 characters of the first sentence of its answer. A question
    without earlier turns stays as it is.
    """
    w = Window.partitionBy(session).orderBy(order)
    said = F.concat(F.lit("Q: "), F.col(question))
    if answer is not None:
        first = F.substring(F.regexp_replace(F.substring_index(F.col(answer), ".", 1), r"(?U)^\s+|\s+$", ""), 1, 120)
        said = F.concat(said, F.when(F.coalesce(F.col(answer), F.lit("")) != "", F.concat(F.lit(" | A: "), first)).otherwise(""))
    past = F.collect_list(said).over(w.rowsBetween(-turns, -1))
    parts = F.filter(F.split(F.lower(question), r"(?U)\s+"), lambda x: x != "")
    needs = (F.size(parts) <= 5) | F.arrays_overlap(parts, F.array(*[F.lit(x) for x in REFERENCE_WORDS]))
    return df.withColumn("rewritten", F.when(needs & (F.size(past) > 0), F.concat(F.col(question), F.lit(" [Context: "), F.array_join(past, " | "), F.lit("]"))).otherwise(F.col(question)))


def kept_turns(df: DataFrame, session: str, order: str, last: int = 10) -> DataFrame:
    """The last ``last`` turns of each session: what a memory holds."""
    return top_k(df, [session], [F.desc(order)], last).drop("rank")


def live_sessions(df: DataFrame, session: str, ts: str, now: Column, ttl_seconds: float = 3600.0) -> DataFrame:
    """Sessions with their last turn, and whether they have been idle for longer than ``ttl_seconds``."""
    last = df.groupBy(session).agg(F.count(F.lit(1)).alias("n_turns"), F.max(ts).alias("last_active"))
    return last.withColumn("is_expired", F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_active").cast("timestamp")) > F.lit(int(ttl_seconds * 1_000_000)))


def trigrams(text: Column, n: int = 3) -> Column:
    """Distinct character n-grams of the lower-cased text, white space collapsed; shorter texts are one gram."""
    t = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return F.when(F.length(t) < n, F.array(t)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of two arrays as sets; two empty ones are equal."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def link_entities(mentions: DataFrame, mention: str, aliases: DataFrame, alias: str, entity: str, least: float = 0.5, k: int = 5) -> DataFrame:
    """The ``k`` best entities of each mention by n-gram Jaccard of the best alias, at ``least`` or more.

    Two sets with an index of ``least`` share one of their first ``n - ceil(least * n) + 1`` n-grams, the rarest first.
    Candidates come from a join on these and are verified on the whole sets.
    """
    grams = lambda df, c: df.select(F.col(c).alias("s")).distinct().withColumn("_g", trigrams(F.col("s")))
    m, a = grams(mentions, mention), grams(aliases, alias)
    counts = a.select(F.explode("_g").alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("_k"))

    def first(df: DataFrame) -> DataFrame:
        # a hair more than the bound, so that rounding never drops one
        most = F.size("_g") - F.ceil(F.size("_g") * least - 1e-9) + 1
        long = df.select("s", F.size("_g").alias("n"), F.least(F.size("_g"), most).alias("_p"), F.explode("_g").alias("g")).join(counts, "g", "left")
        at = F.row_number().over(Window.partitionBy("s").orderBy(F.coalesce("_k", F.lit(0)), "g"))
        return long.withColumn("_at", at).filter("_at <= _p").select("s", "n", "g")

    left, right = first(m).select(F.col("s").alias("mention"), F.col("n").alias("nm"), "g"), first(a).select(F.col("s").alias("alias"), F.col("n").alias("na"), "g")
    fits = (F.col("nm") >= F.col("na") * least - 1e-9) & (F.col("na") >= F.col("nm") * least - 1e-9)
    near = left.join(right, "g").filter(fits).select("mention", "alias").distinct()
    sets = near.join(m.select(F.col("s").alias("mention"), F.col("_g").alias("gm")), "mention").join(a.select(F.col("s").alias("alias"), F.col("_g").alias("ga")), "alias")
    c = F.size(F.array_intersect("gm", "ga"))
    scored = sets.select("mention", "alias", (c / (F.size("gm") + F.size("ga") - c)).alias("score")).filter(F.col("score") >= least)
    best = scored.join(aliases.select(F.col(alias).alias("alias"), F.col(entity).alias("entity")), "alias").groupBy("mention", "entity").agg(F.round(F.max("score"), 6).alias("score"))
    return top_k(best, ["mention"], [F.desc("score"), F.col("entity")], k)


# -- entities, uncertainty -----------------------------------------------------------------------------------------
def decode_bio(df: DataFrame, sentence: str, position: str, token: str, tag: str) -> DataFrame:
    """Entities of BIO tags: B- starts one, I- goes on with it, O ends it; the type is that of the start."""
    w = Window.partitionBy(sentence).orderBy(position)
    starts = F.sum(F.when(F.col(tag).startswith("B-"), 1).otherwise(0)).over(w)
    broken = F.col(tag).startswith("O")
    rows = df.withColumns({"_e": starts, "_o": F.sum(F.when(broken, 1).otherwise(0)).over(w)}).filter(~broken & (F.col("_e") > 0))
    first = rows.withColumn("_first", F.first("_o").over(Window.partitionBy(sentence, "_e").orderBy(position)))
    kept = first.filter(F.col("_o") == F.col("_first"))
    return kept.groupBy(sentence, F.col("_e").alias("entity")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(position, token))), lambda x: x[token]), " ").alias("text"), F.expr(f"substring(min_by({tag}, {position}), 3)").alias("kind"), F.min(position).alias("start")
    ).filter(F.col("kind") != "")


def read_conll(lines: DataFrame, order: str, line: str, sep: str = "\t") -> DataFrame:
    """Tokens of CoNLL lines: a blank line ends a sentence. ``lines`` is one file, ordered."""
    w = Window.partitionBy(F.lit(0)).orderBy(order)
    rows = lines.withColumn("sentence", F.sum(F.when(F.trim(line) == "", 1).otherwise(0)).over(w)).filter(F.trim(line) != "")
    parts = F.split(F.col(line), sep)
    return rows.select("sentence", F.col(order).alias("position"), F.get(parts, 0).alias("token"), F.coalesce(F.get(parts, 1), F.lit("O")).alias("tag"))


def uncertainty(scores: Column, strategy: str) -> Column:
    """Uncertainty of an array of nonconformity scores: least confidence, margin or mean binary entropy."""
    if strategy == "least_confidence":
        return F.array_max(scores)
    if strategy == "margin":
        return F.when(F.size(scores) == 1, F.get(scores, 0)).otherwise(F.array_max(scores) - F.array_min(scores))
    h = lambda p: F.when((p <= 0) | (p >= 1), 0.0).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))
    return F.aggregate(scores, F.lit(0.0), lambda a, p: a + h(p)) / F.size(scores)


def conformal_threshold(df: DataFrame, score: str, alpha: float = 0.1) -> DataFrame:
    """The score at rank ceil(min((n + 1)(1 - alpha) / n, 1) * n); 1 with fewer than ten scores."""
    n = df.filter(F.col(score).isNotNull()).agg(F.count(F.lit(1)).alias("n"))
    level = F.least(F.lit(1.0), (F.col("n") + 1) * (1 - alpha) / F.col("n"))
    ranked = df.filter(F.col(score).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(score))).crossJoin(F.broadcast(n))  # one row
    return ranked.agg(F.when(F.max("n") < 10, 1.0).otherwise(F.min(F.when(F.col("_r") >= F.ceil(level * F.col("n")), F.col(score)))).alias("q_hat"))


def review_route(critical: Column, security: Column, risk: Column) -> Column:
    """Rejects on a critical or security finding or a risk of 8 or more, approves up to .5, else asks a person."""
    return F.when(critical | security | (risk >= 8), "reject").when(risk <= 0.5, "approve").otherwise("human_review")
