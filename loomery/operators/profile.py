"""Column profiles, expectation suites, schema contracts, audits: one aggregation per table, whatever the number of checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomery.functions import stats
from loomery.operators.ranking import descending_bucket, running_sums
from loomery.session import stage_table


def is_numeric(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


def q_nearest(column: Column, q: float) -> Column:
    """The value at the nearest rank to ``q * (n - 1)`` of the ordered non-null values."""
    return F.element_at(F.sort_array(F.collect_list(column)), (F.round(F.lit(q) * (F.count(column) - 1)) + 1).cast("int"))


def _long_form(df: DataFrame, aggregates: dict[str, list[tuple[str, Column]]], key: str = "column") -> DataFrame:
    """Evaluate {row: [(name, aggregate)]} in one pass and turn it into one row per key."""
    row = df.agg(*[F.struct(*[c.alias(n) for n, c in parts]).alias(k) for k, parts in aggregates.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias(key), F.col(f"`{k}`").alias("_")) for k in aggregates])).alias("_r")).select(
        f"_r.{key}", "_r._.*"
    )


def profile_numeric(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Per numeric column: counts, distinct values (null is one), mean, sample deviation, extremes, quartiles (linear).

    Moments come from one pass. Distinct values and quartiles come from the counts of each value: these are ranked in
    buckets of about equally many values, so no task holds a column.
    """
    columns = columns or [f.name for f in df.schema if is_numeric(f.dataType)]

    def parts(c: str) -> list[tuple[str, Column]]:
        x = F.col(c).cast("double")
        nulls = F.count_if(F.col(c).isNull())
        return [("count", F.count(F.lit(1))), ("null_count", nulls), ("null_pct", F.round(100.0 * nulls / F.count(F.lit(1)), 2)), ("mean", F.avg(x)), ("std", F.stddev_samp(x)), ("min", F.min(x)), ("max", F.max(x))]

    moments = _long_form(df, {c: parts(c) for c in columns})
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column", "value")
    cells = stage_table(long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")), "profile-cells")
    known = cells.filter("value IS NOT NULL")
    borders = known.groupBy("column").agg(F.percentile_approx("value", [i / 64 for i in range(1, 64)], 1000).alias("_b"))
    placed = known.join(F.broadcast(borders), "column").withColumn("bucket", F.size(F.filter("_b", lambda b: b < F.col("value")))).drop("_b")  # one row a column
    run = running_sums(placed, ["column"], "bucket", [F.col("value")], {"start": F.col("n")}, {"start": "total"})
    at = {q: F.lit(q) * (F.col("total") - 1) for q in (0.25, 0.5, 0.75)}
    holds = lambda k: F.when((F.col("start") <= k) & (k < F.col("start") + F.col("n")), F.col("value"))
    ends = run.groupBy("column").agg(F.max("total").alias("total"), *[F.max(holds(f(at[q]))).alias(f"{n}{int(100 * q)}") for q in at for n, f in (("lo", F.floor), ("hi", F.ceil))])
    quartile = lambda q: F.col(f"lo{int(100 * q)}") + (at[q] - F.floor(at[q])) * (F.col(f"hi{int(100 * q)}") - F.col(f"lo{int(100 * q)}"))
    quartiles = ends.select("column", quartile(0.25).alias("q25"), quartile(0.5).alias("median"), quartile(0.75).alias("q75"))
    distinct = cells.groupBy("column").agg(F.count(F.lit(1)).alias("unique_count"))
    return moments.join(distinct, "column").join(quartiles, "column", "left").select(
        "column", "count", "null_count", "null_pct", "unique_count", "mean", "std", "min", "max", "q25", "median", "q75"
    )


def top_values(df: DataFrame, column: str, k: int = 10) -> DataFrame:
    """The ``k`` most frequent values; of equal counts the smaller value first."""
    return df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value").limit(k)


def _made_once(df: DataFrame) -> DataFrame:
    """The same rows; what follows reads the columns instead of writing their expressions out again."""
    return df.select(F.inline(F.array(F.struct("*"))))


SLICE = 4096  # ranks of one value that are made in one row


def order_statistics(df: DataFrame, column: str) -> DataFrame:
    """One row on a numeric column, from all its values in order (nulls and NaN left out).

    ``n``, ``n_distinct``, ``w`` and ``p_normal`` (Shapiro and Wilk's statistic by Royston's weights, and its p-value), ``w_log``
    and ``p_lognormal`` (of the logarithms; null unless all values are above 0), ``d`` and ``p_uniform`` (Kolmogorov's distance
    to the uniform distribution over the range, with Stephens' factor). Null under 8 values, or where all are equal.
    Royston fitted the p-values up to 5000 values; beyond, they are the same curves carried on.

    Values are counted first; ranks are running sums over ordered buckets of values. A value's ranks are made in slices
    that are dealt anew, so neither a frequent value nor the whole column meets in one task.
    """
    x = F.col(column).cast("double")
    counts = df.select(x.alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").groupBy("x").agg(F.count(F.lit(1)).alias("c"))
    placed = running_sums(descending_bucket(counts, "x"), [], "_bucket", [F.desc("x")], {"before": F.col("c")}, {"before": "n"})
    about = counts.agg(
        F.count(F.lit(1)).alias("n_distinct"), F.min("x").alias("low"), F.max("x").alias("high"), (F.sum(F.col("x") * F.col("c")) / F.sum("c")).alias("mean"),
        (F.sum(F.when(F.col("x") > 0, F.ln("x") * F.col("c"))) / F.sum("c")).alias("mean_log"),
    )
    each = placed.crossJoin(F.broadcast(about))  # one row
    share = F.try_divide(F.col("x") - F.col("low"), F.col("high") - F.col("low"))
    under, upto = (F.col("n") - F.col("before") - F.col("c")) / F.col("n"), (F.col("n") - F.col("before")) / F.col("n")
    each = each.withColumns({"gap": F.greatest(upto - share, share - under), "part": F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("c") - 1) / SLICE).cast("long")))})
    dealt = each.withColumns({"from": F.col("before") + F.col("part") * SLICE + 1, "to": F.least(F.col("before") + F.col("c"), F.col("before") + (F.col("part") + 1) * SLICE)}).repartition("x", "part")
    ranks = dealt.withColumn("i", F.explode(F.sequence("from", "to")))
    share_of = lambda i: (i - 0.375) / (F.col("n") + 0.25)
    ranks = _made_once(ranks.withColumns({"_near": share_of(F.least("i", F.col("n") + 1 - F.col("i"))), "_side": F.signum(F.col("n") + 1.0 - 2 * F.col("i"))}))
    ranks = _made_once(ranks.withColumns({"m": -stats.lower_quantile(F.col("_near")) * F.col("_side"), "v": F.col("x") - F.col("mean"), "l": F.when(F.col("low") > 0, F.ln("x") - F.col("mean_log"))}).select("n", "n_distinct", "gap", "i", "m", "v", "l"))
    inner = (F.col("i") > 2) & (F.col("i") < F.col("n") - 1)
    at = lambda i, v: F.max(F.when(F.col("i") == i, F.col(v)))
    sums = ranks.agg(
        F.max("n").alias("n"), F.max("n_distinct").alias("n_distinct"), F.max("gap").alias("d"), F.sum(F.col("m") * F.col("m")).alias("mm"),
        *[f.alias(f"{name}_{v}") for v in "vl" for name, f in {
            "dot": F.sum(F.when(inner, F.col("m") * F.col(v))), "ss": F.sum(F.col(v) * F.col(v)), "ends": at(1, v) - at(F.col("n"), v), "next": at(2, v) - at(F.col("n") - 1, v),
        }.items()],
    )
    n, u = F.col("n"), 1 / F.sqrt("n")
    sums = _made_once(sums.withColumns({"_p1": share_of(F.lit(1)), "_p2": share_of(F.lit(2))}))
    sums = _made_once(sums.withColumns({"_m1": -stats.lower_quantile(F.col("_p1")), "_m2": -stats.lower_quantile(F.col("_p2"))}))
    last, second = F.col("_m1"), F.col("_m2")
    # Weights of the two outermost values on each side, p-values by number; highest power first.
    outer = last / F.sqrt("mm") + stats.polynomial(u, [-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, 0.0])
    beside = second / F.sqrt("mm") + stats.polynomial(u, [-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0.0])
    phi = (F.col("mm") - 2 * last * last - 2 * second * second) / (1 - 2 * outer * outer - 2 * beside * beside)
    out = _made_once(sums.withColumns({"_outer": outer, "_beside": beside, "_phi": phi}))

    def w(v: str) -> Column:
        top = F.col("_outer") * F.col(f"ends_{v}") + F.col("_beside") * F.col(f"next_{v}") + F.col(f"dot_{v}") / F.sqrt("_phi")
        return F.when((n >= 8) & (F.col(f"ss_{v}") > 0), F.least(F.lit(1.0), top * top / F.col(f"ss_{v}")))

    def p(w: str) -> Column:
        rest, logn = F.ln(F.greatest(F.lit(1e-300), 1 - F.col(w))), F.ln(n)
        few = (-F.ln(stats.polynomial(n, [0.459, -2.273]) - rest) - stats.polynomial(n, [-0.0006714, 0.025054, -0.39978, 0.5440])) / F.exp(stats.polynomial(n, [-0.0020322, 0.062767, -0.77857, 1.3822]))
        many = (rest - stats.polynomial(logn, [0.0038915, -0.083751, -0.31082, -1.5861])) / F.exp(stats.polynomial(logn, [0.0030302, -0.082676, -0.4803]))
        z = F.when(n <= 11, few).otherwise(many)
        half = stats.normal_two_sided(z) / 2
        return F.when(F.col(w).isNotNull(), F.when(z > 0, half).otherwise(1 - half))

    out = _made_once(out.withColumns({"w": w("v"), "w_log": w("l")})).withColumns({"p_normal": p("w"), "p_lognormal": p("w_log")})
    far = (F.sqrt(n.cast("double")) + 0.12 + 0.11 * u) * F.col("d")
    out = out.withColumn("p_uniform", F.when((n >= 8) & (F.col("n_distinct") > 1), stats.kolmogorov_tail(far)))
    return out.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"), "w", "p_normal", "w_log", "p_lognormal", "d", "p_uniform")


def distribution_type(df: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """A name for a numeric column's distribution: too few values (under 8), categorical (at most 10 different ones), then the first shape
    that is not rejected at ``alpha``: normal, lognormal, uniform; else other. All by :func:`order_statistics`, over all rows.
    """
    kind = F.when(F.col("n") < 8, "too_few_values").when(F.col("n_distinct") <= 10, "categorical")
    for shape in ("normal", "lognormal", "uniform"):
        kind = kind.when(F.col(f"p_{shape}") > alpha, shape)
    return order_statistics(df, column).select(kind.otherwise("other").alias("kind"))


@dataclass
class Check:
    """One expectation: ``kind`` is not_null, unique, in_range, exists or in_set."""

    kind: str
    column: str
    low: float | None = None
    high: float | None = None
    allowed: list = field(default_factory=list)

    def violations(self) -> Column:
        c = F.col(self.column)
        if self.kind == "not_null":
            return F.count_if(c.isNull())
        if self.kind == "unique":
            return F.count(c) - F.count_distinct(c)
        if self.kind == "in_range":
            out = F.lit(0).cast("long")
            if self.low is not None:
                out = out + F.count_if(c < self.low)
            return out if self.high is None else out + F.count_if(c > self.high)
        if self.kind == "in_set":
            return F.count_if(c.isNotNull() & ~c.isin(self.allowed))
        return F.lit(0).cast("long")


KINDS = ("not_null", "unique", "in_range", "exists", "in_set")


def run_suite(df: DataFrame, suite: list[Check]) -> DataFrame:
    """All checks in one pass: ``id``, ``kind``, ``column``, ``passed``, ``violations``, ``error``, in suite order.

    A missing column or an unknown kind is a failed row with an error, not an exception.
    """
    spark = df.sparkSession
    good = [(i, c) for i, c in enumerate(suite) if c.kind in KINDS and c.column in df.columns]
    bad = [(i, c.kind, c.column, False, None, "unknown check" if c.kind not in KINDS else "missing column") for i, c in enumerate(suite) if (i, c) not in good]
    schema = "id int, kind string, column string, passed boolean, violations long, error string"
    out = spark.createDataFrame(bad, schema)
    if good:
        row = df.agg(*[c.violations().cast("long").alias(f"v{i}") for i, c in good])
        each = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(c.kind).alias("kind"), F.lit(c.column).alias("column"), F.col(f"v{i}").alias("violations")) for i, c in good])
        ran = row.select(F.explode(each).alias("r")).select("r.id", "r.kind", "r.column", (F.col("r.violations") == 0).alias("passed"), "r.violations", F.lit(None).cast("string").alias("error"))
        out = out.unionByName(ran)
    return out


def suite_from_dict(config: dict) -> list[Check]:
    """A suite from its dictionary form: ``{"expectations": [{"check", "column", "kwargs"}]}``."""
    names = {"expect_not_null": "not_null", "expect_unique": "unique", "expect_values_in_range": "in_range", "expect_column_exists": "exists", "expect_values_in_set": "in_set"}
    out = []
    for e in config.get("expectations", []):
        extra = e.get("kwargs", {})
        out.append(Check(names.get(e["check"], e["check"]), e["column"], extra.get("min_value"), extra.get("max_value"), list(extra.get("allowed_values", []))))
    return out


# -- schema contracts ----------------------------------------------------------------------------------------------
KIND_NAMES = {T.StringType: "string", T.BooleanType: "boolean", T.DateType: "datetime", T.TimestampType: "datetime", T.TimestampNTZType: "datetime", T.FloatType: "float", T.DoubleType: "float"}


def kind_name(kind: T.DataType) -> str:
    if isinstance(kind, T.IntegralType):
        return "integer"
    return KIND_NAMES.get(type(kind), kind.typeName())


def infer_contract(df: DataFrame) -> DataFrame:
    """Columns of a table as rows: ``column``, ``dtype``, ``nullable`` (a null was seen)."""
    flags = df.agg(*[F.coalesce(F.bool_or(F.col(f"`{f.name}`").isNull()), F.lit(False)).alias(f.name) for f in df.schema])
    rows = [F.struct(F.lit(f.name).alias("column"), F.lit(kind_name(f.dataType)).alias("dtype"), F.col(f"`{f.name}`").alias("nullable")) for f in df.schema]
    return flags.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Breaking changes between two contracts (``column``, ``dtype``, ``nullable``): one row per change."""
    o, n = old.select("column", F.col("dtype").alias("o"), F.col("nullable").alias("on")), new.select("column", F.col("dtype").alias("n"), F.col("nullable").alias("nn"))
    both = o.join(n, "column", "full_outer")
    change = (
        F.when(F.col("n").isNull(), "removed")
        .when(F.col("o").isNull() & ~F.col("nn"), "new_required")
        .when((F.col("o") != F.col("n")) & ~((F.col("o") == "integer") & (F.col("n") == "float")), "type_changed")
        .when(F.col("on") & ~F.col("nn"), "became_required")
    )
    return both.select("column", change.alias("change")).filter("change IS NOT NULL")


def next_version(version: Column, breaking: Column) -> Column:
    """Semantic version after a change: major if it breaks, else minor."""
    p = F.split(version, r"\.")
    return F.when(breaking, F.concat(F.get(p, 0).cast("int") + 1, F.lit(".0.0"))).otherwise(F.concat(F.get(p, 0), F.lit("."), F.get(p, 1).cast("int") + 1, F.lit(".0")))


# -- audits --------------------------------------------------------------------------------------------------------
def iqr_outlier_ratio(df: DataFrame, column: str, groups: list[str]) -> DataFrame:
    """Share of values outside 1.5 interquartile ranges, quartiles by index n // 4 and 3n // 4; 0 if n < 4 or flat.

    Values are counted, and the counts summed up in buckets of values, so that no task orders a group's rows. Nulls
    don't count; null groups are groups.
    """
    key = F.to_json(F.struct(*groups)).alias("_g")
    counts = stage_table(df.filter(F.col(column).isNotNull()).groupBy(*groups, F.col(column).alias("_x")).agg(F.count(F.lit(1)).alias("_c")).select(*groups, key, "_x", "_c"), "value-counts")
    placed = descending_bucket(counts, "_x").withColumn("_bucket", -F.col("_bucket"))
    ranked = running_sums(placed, ["_g"], "_bucket", [F.col("_x")], {"_i": F.col("_c")}, {"_i": "_n"})
    holds = lambda at: (F.col("_i") <= at) & (at < F.col("_i") + F.col("_c"))
    quartiles = ranked.groupBy("_g").agg(
        F.max("_n").alias("_n"), F.max(F.when(holds(F.floor(F.col("_n") / 4)), F.col("_x"))).alias("_q1"), F.max(F.when(holds(F.floor(3 * F.col("_n") / 4)), F.col("_x"))).alias("_q3")
    )
    iqr = F.col("_q3") - F.col("_q1")
    out = (F.col("_x") < F.col("_q1") - 1.5 * iqr) | (F.col("_x") > F.col("_q3") + 1.5 * iqr)
    marks = counts.join(quartiles, "_g").groupBy(*groups)
    return marks.agg(F.when((F.max("_n") < 4) | (F.max(iqr) == 0), 0.0).otherwise(F.sum(F.when(out, F.col("_c")).otherwise(0)) / F.max("_n")).alias("outlier_ratio"))


def label_entropy(df: DataFrame, column: str) -> DataFrame:
    """Shannon entropy of a column over log2 of its number of values; 1 if empty, 0 for one value."""
    n = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    p = F.col("n") / F.col("_t")
    total = n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("_t"), F.count(F.lit(1)).alias("_k"))))  # one row
    return total.agg(
        F.when(F.count(F.lit(1)) == 0, 1.0).when(F.max("_k") == 1, 0.0).otherwise(-F.sum(p * F.log2(p)) / F.log2(F.max("_k"))).alias("entropy")
    )


def column_audit(df: DataFrame) -> DataFrame:
    """Per column: null ratio over .3 (skew), distinct ratio over .95 (membership), as findings with their weights."""
    def parts(c: str):
        return [("null_ratio", F.avg(F.col(c).isNull().cast("double"))), ("distinct_ratio", F.count_distinct(c) / F.count(F.lit(1)))]

    rows = _long_form(df, {c: parts(c) for c in df.columns})
    found = F.array_compact(F.array(F.when(F.col("null_ratio") > 0.3, F.lit("model_skewing")), F.when(F.col("distinct_ratio") > 0.95, F.lit("membership_inference"))))
    return rows.withColumn("findings", F.array_join(found, ","))


def audit_score(findings: DataFrame, severity: str = "severity") -> DataFrame:
    """100 minus 40, 20, 10 and 5 for each critical, high, medium and low finding; not below 0."""
    weight = F.when(F.col(severity) == "critical", 40).when(F.col(severity) == "high", 20).when(F.col(severity) == "medium", 10).when(F.col(severity) == "low", 5).otherwise(0)
    return findings.agg(F.greatest(F.lit(0), 100 - F.coalesce(F.sum(weight), F.lit(0))).cast("long").alias("score"))
