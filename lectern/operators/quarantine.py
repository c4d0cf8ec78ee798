"""Inputs that cannot be used: set aside with a name and a reason, counted, never silent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_reason(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """The rows with ``reason``: the name of the first rule that holds, NULL for usable rows.

    A rule that is NULL does not hold.
    """
    if "reason" in rows.columns:
        raise ValueError("rename the column 'reason' first")
    choices = [F.when(holds, F.lit(name)) for name, holds in rules.items()]
    none = F.lit(None).cast("string")
    return rows.withColumn("reason", F.coalesce(*choices, none))


def text_rules(text: Column) -> dict[str, Column]:
    """Rules of texts: missing, blank, or holding the mark of bytes that were no text."""
    return {
        "missing": text.isNull(),
        "blank": F.trim(text) == "",
        "undecodable": text.contains("�"),
    }


def usable(judged: DataFrame) -> DataFrame:
    """Rows without a reason; an error if there are none."""
    good = judged.filter(F.col("reason").isNull()).drop("reason")
    if good.isEmpty():
        raise ValueError("no usable input remains")
    return good


def failures(judged: DataFrame, name: str) -> DataFrame:
    """``name, reason`` of the rows set aside, to be written beside the output."""
    return judged.filter(F.col("reason").isNotNull()).select(name, "reason")


def failure_counts(judged: DataFrame, name: str) -> DataFrame:
    """``reason, n, first_name`` for every reason, and a row without reason for usable rows."""
    return judged.groupBy("reason").agg(F.count("*").alias("n"), F.min(name).alias("first_name"))
