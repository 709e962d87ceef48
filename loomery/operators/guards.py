"""Personal data and prompt guards, as regular expressions in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomery.operators.recsys import top_k

# Patterns of personal data in tables.
PII = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone": r"(?<!\d)(\+?1[\s\-.]?)?\(?\d{3}\)?[\s\-.]?\d{3}[\s\-.]?\d{4}(?!\d)",
    "ssn": r"\b(?!000|666|9\d{2})\d{3}[-\s]?(?!00)\d{2}[-\s]?(?!0000)\d{4}\b",
    "credit_card": r"\b(?:4\d{3}|5[1-5]\d{2}|3[47]\d{2}|6(?:011|5\d{2}))[\s\-]?\d{4}[\s\-]?\d{4}[\s\-]?\d{4}\b",
    "ip_address": r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b",
    "passport": r"\b[A-Z]{1,2}\d{6,9}\b",
    "iban": r"\b[A-Z]{2}\d{2}[A-Z0-9]{4}\d{7}(?:[A-Z0-9]{0,16})\b",
    "date_of_birth": r"\b(?:19|20)\d{2}[-/](0[1-9]|1[0-2])[-/](0[1-9]|[12]\d|3[01])\b|\b(0[1-9]|[12]\d|3[01])[-/](0[1-9]|1[0-2])[-/](?:19|20)\d{2}\b",
    "full_name": r"\b[A-Z][a-z]{2,}\s[A-Z][a-z]{2,}\b",
}
# Severities.
SEVERITY = {"ssn": "critical", "credit_card": "critical", "passport": "high", "iban": "high", "email": "high", "date_of_birth": "medium", "phone": "medium", "ip_address": "low", "full_name": "low"}
# Patterns of personal data in questions, in the order in which they are replaced.
QUERY_PII = {
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b",
    "phone_ru": r"(?:\+7|8)[\s\-]?\(?\d{3}\)?[\s\-]?\d{3}[\s\-]?\d{2}[\s\-]?\d{2}\b",
    "ssn": r"\b\d{3}[\-\s]\d{2}[\-\s]\d{4}\b",
    "credit_card": r"\b(?:\d{4}[\s\-]?){3}\d{4}\b",
    "passport_ru": r"\b\d{4}\s?\d{6}\b",
}
# Those of answers, in their order.
ANSWER_PII = ["email", "phone_ru", "credit_card", "ssn"]
# Patterns of prompt injection, case ignored.
INJECTION = [
    r"ignore\s+(?:(?:previous|all|prior|above)\s+){1,2}(?:instructions?|prompts?|context|rules?)",
    r"forget\s+(everything|all|previous|prior|your\s+instructions)",
    r"you\s+are\s+now\s+(a|an)\s+\w+",
    r"act\s+as\s+(if\s+you\s+are|a|an)\s+",
    r"(system\s*prompt|system\s*message)\s*[:=]",
    r"\bjailbreak\b",
    r"\bdan\s*(mode|prompt|jailbreak)\b",
    r"pretend\s+(you\s+are|to\s+be)\s+",
    r"\[system\]|\[user\]|\[assistant\]",
    r"override\s+(safety|guidelines|rules|restrictions|filters|constraints)",
    r"disregard\s+your\s+(training|guidelines|instructions|constraints)",
    r"new\s+instruction[s]?:\s*",
    r"</?(s|system|instruction|context)>",
]
# Patterns of harmful answers, case ignored.
HARMFUL = [
    r"how\s+to\s+(make|build|create|synthesize)\s+(?:a\s+)?(bomb|explosive|weapon|poison|drug)",
    r"(suicide\s+method|how\s+to\s+self[\s\-]?harm|steps?\s+to\s+(kill|harm)\s+(yourself|oneself))",
    r"(how\s+to\s+hack\s+into|unauthorized\s+access\s+to\s+|bypass\s+authentication)",
    r"step[\s\-]by[\s\-]step\s+(instructions?|guide)\s+(to|for)\s+(attack|exploit|compromise)",
]
HARMFUL_ANSWER = "[Content filtered by output guardrail — potential harmful information detected]"


def pii_scan(df: DataFrame, column: str) -> DataFrame:
    """Per type of personal data: values with a match, their share of the non-blank values, severity."""
    x = F.col(column)
    row = df.agg(F.count_if(F.trim(x) != "").alias("n"), *[F.count_if(x.rlike(p)).alias(k) for k, p in PII.items()])
    each = F.array(*[F.struct(F.lit(k).alias("pii_type"), F.col(k).alias("match_count"), F.lit(SEVERITY[k]).alias("severity")) for k in PII])
    return row.select("n", F.explode(each).alias("r")).select("r.pii_type", "r.match_count", F.round(F.try_divide("r.match_count", "n"), 4).alias("fraction"), "r.severity")


def mask(value: Column, kind: str) -> Column:
    """A value of a type of personal data, safe for logs."""
    digits = F.regexp_replace(value, r"\D", "")
    if kind == "email":
        parts = F.split(value, "@")
        return F.when(F.size(parts) == 2, F.concat(F.substring(F.get(parts, 0), 1, 2), F.lit("***@"), F.get(parts, 1))).otherwise("***")
    if kind in ("credit_card", "ssn", "iban"):
        return F.concat(F.repeat(F.lit("*"), F.greatest(F.lit(0), F.length(digits) - 4)), F.right(digits, F.lit(4)))
    if kind == "phone":
        return F.when(F.length(digits) >= 4, F.concat(F.lit("***-***-"), F.right(digits, F.lit(4)))).otherwise("***")
    return F.when(F.length(value) > 4, F.concat(F.substring(value, 1, 2), F.lit("***"), F.right(value, F.lit(2)))).otherwise("***")


def pii_findings(df: DataFrame, columns: list[str], examples: int = 3) -> DataFrame:
    """Per column and type of personal data that occurs in it: ``column``, ``pii_type``, ``severity``, ``match_count`` (values), ``fraction``
    of the values that are not blank, and ``masked_examples``: the first match of up to ``examples`` values, masked, the least first.

    Columns of any type are read as text; nulls count for nothing. A table without matches gives no rows.
    """
    values = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("r")).select("r.*").filter(~_blank(F.col("v")))
    n = values.groupBy("column").agg(F.count(F.lit(1)).alias("n"))
    kinds = F.array_compact(F.array(*[F.when(F.col("v").rlike(p), F.struct(F.lit(k).alias("pii_type"), mask(F.regexp_extract("v", p, 0), k).alias("shown"))) for k, p in PII.items()]))
    hits = values.select("column", F.explode(kinds).alias("h")).select("column", "h.*").groupBy("column", "pii_type", "shown").agg(F.count(F.lit(1)).alias("m"))
    counted = hits.groupBy("column", "pii_type").agg(F.sum("m").alias("match_count"))
    first = top_k(hits, ["column", "pii_type"], [F.col("shown")], examples)
    # a value that is shown more than once fills as many places, up to the number of examples
    shown = first.select("column", "pii_type", F.array_repeat("shown", F.least("m", F.lit(examples)).cast("int")).alias("s"), "rank")
    lists = shown.groupBy("column", "pii_type").agg(F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("rank", "s"))), lambda x: x["s"])), 1, examples).alias("masked_examples"))
    severity = F.create_map(*[F.lit(x) for k, v in SEVERITY.items() for x in (k, v)])
    out = counted.join(lists, ["column", "pii_type"]).join(n, "column")
    return out.select("column", "pii_type", severity[F.col("pii_type")].alias("severity"), "match_count", F.round(F.col("match_count") / F.col("n"), 4).alias("fraction"), "masked_examples")


def pii_compliance(df: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: ``rows_scanned``, ``affected_columns``, ``critical_columns`` (with critical or high types), sorted, and ``compliant``: there is none of the latter."""
    sets = findings.agg(
        F.sort_array(F.collect_set("column")).alias("affected_columns"), F.sort_array(F.collect_set(F.when(F.col("severity").isin("critical", "high"), F.col("column")))).alias("critical_columns")
    )
    return df.agg(F.count(F.lit(1)).alias("rows_scanned")).crossJoin(sets).withColumn("compliant", F.size("critical_columns") == 0)  # one row each


def _any(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike("(?i)" + p)
    return out


def _redact(text: Column, kinds: list[str]) -> Column:
    for kind in kinds:
        text = F.regexp_replace(text, QUERY_PII[kind], f"[{kind.upper()}_REDACTED]")
    return text


def _found(text: Column, kinds: list[str]) -> Column:
    """The kinds that are found when each is replaced in turn."""
    out = []
    for i, kind in enumerate(kinds):
        out.append(F.when(_redact(text, kinds[:i]).rlike(QUERY_PII[kind]), F.lit(kind)))
    return F.array_compact(F.array(*out))


def _blank(text: Column) -> Column:
    return ~text.rlike(r"(?U)\S")


def is_injection(text: Column) -> Column:
    """Whether any pattern of prompt injection matches."""
    return _any(F.coalesce(text, F.lit("")), INJECTION)


def mask_answer(text: Column) -> Column:
    """An answer with its personal data replaced."""
    return _redact(text, ANSWER_PII)


def input_guard(df: DataFrame, column: str, max_length: int = 2000, domain: list[str] | None = None, block_pii: bool = False, block_off_topic: bool = False) -> DataFrame:
    """Add ``threats`` (array), ``pii``, ``injection``, ``has_pii``, ``off_topic``, ``too_long``, ``empty``, ``is_safe``, ``risk_score`` and ``sanitized``.

    The risk is the largest of: empty 1, injection .95, off topic .5 (with ``domain`` words only), personal data .4, too
    long .3. Injection and blank questions aren't safe; personal data and topics if asked for.
    """
    x = F.coalesce(F.col(column), F.lit(""))
    short = F.substring(x, 1, max_length)
    low = F.lower(x)
    topic = F.lit(True)
    if domain:
        topic = F.lit(False)
        for w in domain:
            topic = topic | low.contains(w.lower())
    full = ~_blank(x)
    flags = df.withColumns(
        {
            "empty": ~full, "too_long": full & (F.length(x) > max_length), "injection": full & _any(x, INJECTION), "pii": _found(short, list(QUERY_PII)), "off_topic": full & ~topic,
            "sanitized": F.when(full, _redact(short, list(QUERY_PII))).otherwise(""),
        }
    ).withColumn("has_pii", F.size("pii") > 0)
    names = {"empty": "empty_query", "too_long": "query_too_long", "injection": "prompt_injection", "has_pii": "pii_in_query", "off_topic": "off_topic"}
    weights = {"empty": 1.0, "injection": 0.95, "off_topic": 0.5, "has_pii": 0.4, "too_long": 0.3}
    stop = F.col("empty") | F.col("injection") | (F.col("has_pii") & F.lit(block_pii)) | (F.col("off_topic") & F.lit(block_off_topic))
    return flags.withColumns(
        {
            "threats": F.array_compact(F.array(*[F.when(F.col(k), F.lit(v)) for k, v in names.items()])), "is_safe": ~stop,
            "risk_score": F.greatest(*[F.when(F.col(k), w).otherwise(0.0) for k, w in weights.items()]),
        }
    )


def output_guard(df: DataFrame, column: str, sources: str | None = None, least: int = 10, mask_pii: bool = True) -> DataFrame:
    """Add ``is_safe``, ``risk_score`` and ``filtered`` to answers: harmful ones are replaced, personal data redacted.

    The risk is 1 for a harmful answer, else the largest of: personal data .6, under ``least`` characters without the
    white space around .2, no sources .1. Without a column of sources there are none.
    """
    x = F.coalesce(F.col(column), F.lit(""))
    harmful = _any(x, HARMFUL)
    pii = F.lit(mask_pii) & (F.size(_found(x, ANSWER_PII)) > 0)
    bare = F.lit(True) if sources is None else F.coalesce(F.size(sources), F.lit(0)) <= 0
    brief = F.length(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")) < least
    risk = F.when(harmful, 1.0).otherwise(F.greatest(F.when(pii, 0.6).otherwise(0.0), F.when(brief, 0.2).otherwise(0.0), F.when(bare, 0.1).otherwise(0.0)))
    return df.withColumns({"is_safe": ~harmful, "risk_score": risk, "filtered": F.when(harmful, HARMFUL_ANSWER).otherwise(mask_answer(x) if mask_pii else x)})
