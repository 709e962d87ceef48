"""Contracts of tables: validation in one pass, and a registry of their versions kept as a table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomery.operators.profile import is_numeric, next_version, schema_diff


@dataclass
class Rule:
    """What a contract says of one column."""

    column: str
    dtype: str = "string"
    nullable: bool = True
    allowed: list | None = None
    low: float | None = None
    high: float | None = None


def validate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """One row for each check of a contract: ``column``, ``check``, ``passed``, ``violations``.

    A column must exist; one that does is checked for nulls if it may have none, for values outside of ``allowed``, and,
    if numeric, for values out of range (other types pass). All counts are taken in one pass. Types aren't compared.
    Columns that the contract doesn't name are no violation: see :func:`extra_columns`.
    """
    checks = []
    for r in rules:
        there = r.column in df.columns
        checks.append((r.column, "column_exists", F.lit(0 if there else 1)))
        if not there:
            continue
        c = F.col(f"`{r.column}`")
        checks.append((r.column, "nullable", F.lit(0) if r.nullable else F.count_if(c.isNull())))
        if r.allowed is not None:
            checks.append((r.column, "allowed_values", F.count_if(c.isNotNull() & ~c.isin(r.allowed))))
        if r.low is not None or r.high is not None:
            out = F.lit(0)
            if is_numeric(df.schema[r.column].dataType):
                out = out + (F.count_if(c < r.low) if r.low is not None else 0) + (F.count_if(c > r.high) if r.high is not None else 0)
            checks.append((r.column, "value_range", out))
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[v.cast("long").alias(f"v{i}") for i, (_, _, v) in enumerate(checks)])
    each = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("check"), F.col(f"v{i}").alias("violations")) for i, (c, k, _) in enumerate(checks)])
    return row.select(F.explode(each).alias("r")).select("r.column", "r.check", (F.col("r.violations") == 0).alias("passed"), "r.violations")


def extra_columns(df: DataFrame, rules: list[Rule]) -> list[str]:
    """Columns of a table that its contract doesn't name."""
    return [c for c in df.columns if c not in {r.column for r in rules}]


def summary(checks: DataFrame) -> DataFrame:
    """Whether all checks passed, and their numbers."""
    return checks.agg(F.bool_and("passed").alias("passed"), F.count(F.lit(1)).alias("total_checks"), F.count_if("passed").alias("passed_checks"), F.count_if(~F.col("passed")).alias("failed_checks"))


# -- registry ----------------------------------------------------------------------------------------------------------
REGISTRY = "name string, seq int, version string, column string, dtype string, nullable boolean"


def latest(registry: DataFrame, name: str, version: str | None = None) -> DataFrame:
    """The columns of a contract's last version, or of the version asked for; no rows if there is none."""
    mine = registry.filter(F.col("name") == name)
    if version is not None:
        return mine.filter(F.col("version") == version)
    last = F.broadcast(mine.agg(F.max("seq").alias("_last")))  # one row
    return mine.join(last, F.col("seq") == F.col("_last")).drop("_last")


def compatibility(registry: DataFrame, name: str, candidate: DataFrame) -> DataFrame:
    """Breaking changes of a candidate (``column``, ``dtype``, ``nullable``) against the last version; none if there is none."""
    known = latest(registry, name)
    return schema_diff(known, candidate) if known.limit(1).count() else schema_diff(candidate, candidate)


def register(registry: DataFrame, name: str, candidate: DataFrame, version: str | None = None, allow_breaking: bool = False) -> DataFrame:
    """The registry with one version more: 1.0.0 at first, then a major step if the change breaks readers, else a minor one.

    Contracts are small tables, so their differences are looked at here; a breaking change raises unless allowed.
    """
    before = latest(registry, name).select("seq", "version").distinct().first()
    if before is None:
        seq, number = 1, version or "1.0.0"
    else:
        broken = [f"{r['column']}: {r['change']}" for r in compatibility(registry, name, candidate).collect()]
        if broken and not allow_breaking:
            raise ValueError(f"breaking change of {name}: {', '.join(sorted(broken))}")
        seq = before["seq"] + 1
        number = version or registry.sparkSession.range(1).select(next_version(F.lit(before["version"]), F.lit(bool(broken)))).first()[0]
    new = candidate.select(F.lit(name).alias("name"), F.lit(seq).alias("seq"), F.lit(number).alias("version"), "column", "dtype", "nullable")
    return registry.unionByName(new)


def versions(registry: DataFrame) -> DataFrame:
    """``name``, ``version``, ``n_columns``, ``is_latest`` of all versions."""
    each = registry.groupBy("name", "seq", "version").agg(F.count(F.lit(1)).alias("n_columns"))
    last = registry.groupBy("name").agg(F.max("seq").alias("_last"))
    return each.join(last, "name").select("name", "version", "n_columns", (F.col("seq") == F.col("_last")).alias("is_latest"))
