"""Array expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body``.

    Without this, an expression named inside an array lambda is computed again for each
    element once the optimizer has merged the projections.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def first_where(items: Column, test: Callable[[Column], Column]) -> Column:
    """First element that passes, or NULL."""
    return F.try_element_at(F.filter(items, test), F.lit(1))


def last_of(items: Column) -> Column:
    return F.try_element_at(items, F.lit(-1))




def rows_of(df: DataFrame, keep: list[str], items: Column, position: str, item: str) -> DataFrame:
    """One row per element of a computed array: ``keep``, ``position`` (from 0), ``item``.

    A plain ``posexplode`` makes the optimizer filter on the array's size first, which
    computes the array again for that filter. The outer form is left alone; the rows of
    empty arrays are dropped afterwards.
    """
    expanded = df.select(*keep, F.posexplode_outer(items).alias(position, item))
    return expanded.filter(F.col(position).isNotNull())
