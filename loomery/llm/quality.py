"""Quality rules by distribution divergence (operator 5), in DataFrame functions only.

Each text has a histogram of its character classes and one of the common words. References are the pooled histograms
of each language, counted over the whole corpus. A text is kept if, for some language, both Jensen-Shannon distances
(square root of the divergence in bits, 0 to 1) are within limits; a histogram of a text too short to judge passes.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomery.llm.common import SPACE_CHARS, whole, words

#: Character classes: letters that aren't small, digits, symbols, stops, all others, small letters.
CLASSES = ("upper", "digit", "symbol", "stop", "other", "lower")
DIGITS, SYMBOLS = r"\p{Nd}", r"[#*$%&|<>]"
#: Small letters and white space: most of a text. Classes are counted in what remains without them.
COMMON = r"[\p{Ll}\x20\x09-\x0D]"
WINDOW = 8
#: Up to so many references are compared one by one in the plan, which is quicker; more as one constant array.
UNROLLED = 16


def _removed(text: Column, pattern: str) -> Column:
    return F.char_length(text) - F.char_length(F.regexp_replace(text, pattern + "+", ""))


def _pairs(items: Column, apart: int) -> Column:
    """Hashes of each item with the one ``apart`` places on."""
    n = F.greatest(F.size(items) - apart, F.lit(0))
    return F.zip_with(F.slice(items, 1, n), F.slice(items, apart + 1, n), lambda a, b: F.xxhash64(a, b))


def residue(text: Column) -> Column:
    """A text without small letters and white space."""
    return F.regexp_replace(text, COMMON + "+", "")


def base_features(docs: DataFrame) -> DataFrame:
    """Add ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` and ``n_repeat_words`` (long) to ``docs``.

    Null text counts as empty: all zero. A line counts as repeated if it has a word and equals an earlier line.
    """
    lines = F.filter(F.split(whole("text"), "\n", -1), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    step1 = docs.withColumns({"_words": words("text"), "_lines": lines, "_rest": residue(whole("text"))})
    step2 = step1.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": word_characters(whole("text")),
            "_odd": odd_characters(F.col("_rest")),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "_two": _pairs(F.col("_words"), 1),
        }
    ).drop("_lines")
    # windows of eight words as pairs of pairs of pairs, hashed to 64 bits, sorted with their places: windows equal to
    # a neighbour are repeated, and what they cover is measured from place to place; n log n for any text
    step2 = step2.withColumn("n_symbols", _removed(F.col("_odd"), SYMBOLS).cast("long"))
    step3 = step2.withColumn("_four", _pairs(F.col("_two"), 2)).drop("_two").withColumn("_windows", _pairs(F.col("_four"), 4)).drop("_four")
    placed = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    step4 = step3.withColumn("_placed", F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), placed)).drop("_windows")
    again = F.filter(
        "_placed",
        lambda x, i: (F.get(F.col("_placed"), i - 1)["h"] == x["h"]) | F.coalesce(F.get(F.col("_placed"), i + 1)["h"] == x["h"], F.lit(False)),
    )
    step5 = step4.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"]))).drop("_placed")
    count = F.aggregate(
        F.transform("_again", lambda p, i: F.least(F.coalesce(F.get(F.col("_again"), i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)).cast("long")),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return step5.withColumn("n_repeat_words", F.coalesce(count, F.lit(0).cast("long"))).drop("_again")


def odd_characters(rest: Column) -> Column:
    """What is left of a residue without letters and stops: of most texts, hardly anything."""
    return F.regexp_replace(rest, r"[\p{L}.,]+", "")


def class_counts(rest: Column, odd: Column, word_chars: Column) -> Column:
    """Characters of each class (array of longs), from a text's residue and what is odd in it."""
    stops = F.char_length(rest) - F.char_length(F.replace(F.replace(rest, F.lit("."), F.lit("")), F.lit(","), F.lit("")))
    digits, symbols, n_odd = _removed(odd, DIGITS), _removed(odd, SYMBOLS), F.char_length(odd)
    each = [F.char_length(rest) - n_odd - stops, digits, symbols, stops, n_odd - digits - symbols, word_chars - F.char_length(rest)]
    return F.array(*[x.cast("long") for x in each])


def word_characters(text: Column) -> Column:
    """Code points in all words of a text."""
    for c in SPACE_CHARS:
        text = F.replace(text, F.lit(c), F.lit(""))
    return F.char_length(text).cast("long")


def _entropy(shares: Column) -> Column:
    return -F.aggregate(shares, F.lit(0.0), lambda a, p: a + F.when(p > 0, p * F.log2(p)).otherwise(F.lit(0.0)))


def js_distance(shares: Column, entropy: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of shares, of the given entropy in bits, from a list of shares."""
    own = -sum(q * math.log2(q) for q in reference if q > 0)
    mean = F.zip_with(shares, F.array(*[F.lit(float(q)) for q in reference]), lambda p, q: (p + q) / 2)
    return F.sqrt(F.greatest(F.lit(0.0), _entropy(mean) - (entropy + own) / 2))


def references(featured: DataFrame, n_common: int = 16) -> list[dict]:
    """The pooled references of every language, counted over all rows of ``featured`` (``lang``, ``_words``, ``_classes``).

    What reaches the driver is one row a language, with its ``n_common`` most frequent words (of equal counts the first by
    name) and a histogram of the classes. Words of any length count. Null languages make no reference. Ranks are cut
    within partitions before they meet by language.
    """
    named = featured.filter("lang IS NOT NULL")
    n = len(CLASSES)
    pooled = named.groupBy("lang").agg(F.sum(F.size("_words")).alias("n"), *[F.sum(F.col("_classes")[k]).alias(f"c{k}") for k in range(n)])
    langs = sorted(pooled.collect(), key=lambda x: x["lang"])
    counted = named.select("lang", F.explode("_words").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    top: dict[str, list] = {}
    found = counted.withColumn("rank", rank).filter(F.col("rank") <= n_common).collect()
    totals = {x["lang"]: x["n"] for x in langs}
    for x in sorted(found, key=lambda x: (x["lang"], x["rank"])):
        top.setdefault(x["lang"], []).append((x["word"], x["n"] / totals[x["lang"]]))
    out = []
    for x in langs:
        kinds = [x[f"c{k}"] for k in range(n)]
        chars = max(1, sum(kinds))
        common = top.get(x["lang"], [])
        shares = [c for _, c in common]
        out.append(
            {"lang": x["lang"], "classes": [c / chars for c in kinds], "words": [w for w, _ in common], "word_shares": [*shares, max(0.0, 1 - sum(shares))]}
        )
    return out


def _distances_from_table(refs: list[dict]) -> tuple[Column, Column]:
    """Least class and word distance over any number of references, held as one constant array of the plan."""
    bits = lambda shares: -sum(q * math.log2(q) for q in shares if q > 0)
    rows = [{**r, "class_bits": bits(r["classes"]), "word_bits": bits(r["word_shares"])} for r in refs]
    kind = "array<struct<classes: array<double>, words: array<string>, word_shares: array<double>, class_bits: double, word_bits: double>>"
    table = F.from_json(F.lit(json.dumps(rows)), kind)

    def distance(shares: Column, reference: Column, own: Column) -> Column:
        mean = F.zip_with(shares, reference, lambda p, q: (p + q) / 2)
        return F.sqrt(F.greatest(F.lit(0.0), _entropy(mean) - (_entropy(shares) + own) / 2))

    def seen(r: Column) -> Column:
        gone = lambda w: F.col("_size") - F.octet_length(F.replace(F.col("_line"), F.concat(F.lit(" "), w, F.lit(" ")), F.lit("")))
        part = F.transform(r["words"], lambda w: gone(w) / (F.octet_length(w) + 2) / F.greatest(F.col("n_words"), F.lit(1)))
        return F.concat(part, F.array(F.lit(1.0) - F.aggregate(part, F.lit(0.0), lambda a, x: a + x)))

    by_class = F.transform(table, lambda r: distance(F.col("_shares"), r["classes"], r["class_bits"]))
    by_word = F.transform(table, lambda r: distance(seen(r), r["word_shares"], r["word_bits"]))
    return F.array_min(by_class), F.array_min(by_word)


def judge(
    featured: DataFrame, refs: list[dict], max_class: float = 0.32, max_word: float = 0.40, min_chars: int = 200, min_words: int = 50
) -> DataFrame:
    """Add ``class_distance`` and ``word_distance`` (least over the references; null if too short) and ``verdict``.

    Texts under ``min_chars`` characters or ``min_words`` words aren't judged by that histogram. Without any reference
    every text passes.
    """
    if not refs:
        nothing = F.lit(None).cast("double")
        return featured.withColumns({"class_distance": nothing, "word_distance": nothing, "verdict": F.lit(True)})
    # common words kept apart by two spaces, so that removing one leaves the others whole; sizes in bytes
    some = sorted({w for r in refs for w in r["words"]})
    step = featured.withColumns(
        {
            "_shares": F.transform("_classes", lambda c: c / F.greatest(F.col("word_chars"), F.lit(1))),
            "_line": F.concat(F.lit(" "), F.array_join(F.filter("_words", lambda w: w.isin(some)), "  "), F.lit(" ")),
        }
    ).withColumns({"_entropy": _entropy(F.col("_shares")), "_size": F.octet_length("_line").cast("double")})
    unrolled = refs if len(refs) <= UNROLLED else []
    for k, ref in enumerate(unrolled):
        each = [(F.col("_size") - F.octet_length(F.replace(F.col("_line"), F.lit(f" {w} "), F.lit("")))) / float(len(w.encode()) + 2) for w in ref["words"]]
        step = step.withColumn(f"_seen{k}", F.array(*each) if each else F.array().cast("array<double>"))
    for k in range(len(unrolled)):
        part = F.transform(f"_seen{k}", lambda c: c / F.greatest(F.col("n_words"), F.lit(1)))
        step = step.withColumn(f"_seen{k}", F.concat(part, F.array(F.lit(1.0) - F.aggregate(part, F.lit(0.0), lambda a, x: a + x))))
    if unrolled:
        step = step.withColumns({f"_bits{k}": _entropy(F.col(f"_seen{k}")) for k in range(len(refs))})
        by_class = F.array_min(F.array(*[js_distance(F.col("_shares"), F.col("_entropy"), r["classes"]) for r in refs]))
        by_word = F.array_min(F.array(*[js_distance(F.col(f"_seen{k}"), F.col(f"_bits{k}"), r["word_shares"]) for k, r in enumerate(refs)]))
    else:
        by_class, by_word = _distances_from_table(refs)
    out = step.withColumns(
        {
            "class_distance": F.when(F.col("word_chars") >= min_chars, by_class),
            "word_distance": F.when(F.col("n_words") >= min_words, by_word),
        }
    )
    fits = (F.coalesce(F.col("class_distance"), F.lit(0.0)) <= max_class) & (F.coalesce(F.col("word_distance"), F.lit(0.0)) <= max_word)
    return out.withColumn("verdict", fits).drop(
        "_shares", "_entropy", "_line", "_size", *[f"{x}{k}" for x in ("_seen", "_bits") for k in range(len(unrolled))]
    )


#: The columns that the rules add.
MADE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "class_distance", "word_distance", "base_failed", "kept")


def quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """Base rules, then the divergence verdict, on ``docs`` (``text``, ``lang``); other columns are kept.

    ``base_failed``: under 20 words, or over 30 % of the words in repeated windows. ``kept``: not ``base_failed``, and
    the verdict. Null and empty texts fail the base rules. ``docs`` is read more than once: for the references of its
    languages, and for the rows. Repeated rows are judged alike, each counting in the references; no rows: no rows.
    Columns of the names made here are replaced.
    """
    split = docs.select("lang", residue(whole("text")).alias("_rest"), words("text").alias("_words"), word_characters(whole("text")).alias("_chars")).withColumn("_odd", odd_characters(F.col("_rest")))
    refs = references(split.withColumn("_classes", class_counts(F.col("_rest"), F.col("_odd"), F.col("_chars"))))
    featured = base_features(docs).withColumn("_classes", class_counts(F.col("_rest"), F.col("_odd"), F.col("word_chars")))
    judged = judge(featured, refs, **limits)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = judged.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & F.col("verdict"))
    # made in one generated row: a filter on them stays above, and does not write their arrays out again in its condition
    made = F.explode(F.array(F.struct(*MADE))).alias("_made")
    return judged.select(*[F.col(f"`{c}`") for c in docs.columns if c not in MADE], made).select("*", "_made.*").drop("_made")


def op5_quality(docs: DataFrame) -> DataFrame:
    """The contract of operator 5 over ``documents``."""
    return quality_rules(docs.select("doc_id", "text", "lang")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )
