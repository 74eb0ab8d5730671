"""Rule chains over columns: first match wins, or all findings; and guards that stop a query with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Rule = tuple[str, Column]


def first_match(rules: list[Rule], otherwise: str | None = None) -> Column:
    """The code of the first rule that holds; a rule that is null does not hold."""
    out = F.lit(otherwise).cast("string")
    for code, holds in reversed(rules):
        out = F.when(holds, code).otherwise(out)
    return out


def all_findings(rules: list[tuple[str, str, Column]]) -> Column:
    """All rules (code, severity, holds) that hold, in order, as an array of structs."""
    found = [F.when(holds, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"))) for code, severity, holds in rules]
    return F.array_compact(F.array(*found))


def acceptable(findings: Column) -> Column:
    return ~F.exists(findings, lambda x: x["severity"] == "Blocking")


def require(df: DataFrame, holds: Column, message: str) -> DataFrame:
    """``df``, or an error at run time if a row breaks the rule."""
    return df.where(F.when(holds, True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def require_empty(bad: DataFrame, message: str) -> None:
    """A driver-side guard: one row is enough to stop."""
    row = bad.limit(1).collect()
    if row:
        raise ValueError(f"{message}: {row[0].asDict()}")


def check_ratios(train: float, validation: float, test: float) -> None:
    if min(train, validation, test) < 0 or abs(train + validation + test - 1) > 1e-9:
        raise ValueError("split ratios are not negative and add up to 1")
