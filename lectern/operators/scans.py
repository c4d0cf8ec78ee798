"""Ordered scans that stay balanced when one key holds a large share of the rows.

A plain window over ``(key, order)`` puts a whole key into one task. Here each key is cut
into segments by a deterministic expression of the order columns: the window runs inside
``(key, segment)``, each segment is reduced to one summary row (partial aggregation on
the map side), the small summaries are scanned per key, and the carried value is joined
back on ``(key, segment)``. NULL keys and segments are values like others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import reliable_checkpoint

_SEGMENT = "__segment"


def _frame(keys: Sequence[str], order: Sequence[str], exclusive: bool):
    window = Window.partitionBy(*keys, _SEGMENT).orderBy(*order)
    return window.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)


def _with_carry(rows: DataFrame, carried: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join on keys and segment, NULLs equal to each other."""
    names = [*keys, _SEGMENT]
    renamed = carried.withColumnsRenamed({name: f"__same_{name}" for name in names})
    same = [F.col(name).eqNullSafe(F.col(f"__same_{name}")) for name in names]
    return rows.join(renamed, same).drop(*[f"__same_{name}" for name in names])


def running_last(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: dict[str, Column],
    exclusive: bool = False,
    first: dict[str, Column] | None = None,
    lowest: dict[str, Column] | None = None,
) -> DataFrame:
    """Last non-null value up to each row (before it, if ``exclusive``).

    ``first`` adds columns with the first non-null value of the whole key, ``lowest``
    with its smallest value.
    """
    first, lowest = first or {}, lowest or {}
    rows = df.withColumn(_SEGMENT, segment)
    position = F.struct(*order)
    summary = rows.groupBy(*keys, _SEGMENT).agg(
        *[
            F.max_by(value, F.when(value.isNotNull(), position)).alias(f"__carry_{name}")
            for name, value in values.items()
        ],
        *[
            F.min_by(value, F.when(value.isNotNull(), position)).alias(f"__first_{name}")
            for name, value in first.items()
        ],
        *[F.min(value).alias(f"__lowest_{name}") for name, value in lowest.items()],
    )
    before = Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    whole = (
        Window.partitionBy(*keys)
        .orderBy(_SEGMENT)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    carried = summary.select(
        *keys,
        _SEGMENT,
        *[F.last(f"__carry_{n}", ignorenulls=True).over(before).alias(f"__carry_{n}") for n in values],
        *[F.first(f"__first_{n}", ignorenulls=True).over(whole).alias(f"__first_{n}") for n in first],
        *[F.min(f"__lowest_{n}").over(whole).alias(f"__lowest_{n}") for n in lowest],
    )
    # What is carried into a segment stands ahead of its rows, so rows move once and are not joined.
    own = F.col("__own")
    both = rows.withColumn("__own", F.lit(True)).unionByName(
        carried.withColumn("__own", F.lit(False)), allowMissingColumns=True
    )
    within = Window.partitionBy(*keys, _SEGMENT).orderBy("__own", *order)
    frame = within.rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    ahead = within.rowsBetween(Window.unboundedPreceding, 0)
    names = [*[f"__carry_{n}" for n in values], *[f"__first_{n}" for n in first], *[f"__lowest_{n}" for n in lowest]]
    local = both.select(
        "*",
        *[F.last(F.when(own, v), ignorenulls=True).over(frame).alias(f"__local_{n}") for n, v in values.items()],
        *[F.first(name).over(ahead).alias(f"__at{name}") for name in names],
    )
    return local.filter(own).select(
        *df.columns,
        *[F.coalesce(f"__local_{n}", f"__at__carry_{n}").alias(n) for n in values],
        *[F.col(f"__at__first_{n}").alias(n) for n in first],
        *[F.col(f"__at__lowest_{n}").alias(n) for n in lowest],
    )


def next_within(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: dict[str, Column],
    rows: int | None = None,
) -> DataFrame:
    """Next non-null value after each row, at most ``rows`` rows ahead of it in its key.

    ``<name>_in`` tells how many rows ahead it stands. A window looks ahead inside the
    segment; where it finds nothing, the first value of the following segments counts if it
    is near enough. Of those segments only a row each is scanned: their number of rows, which
    places them in the key, and their first value.
    """
    local = Window.partitionBy(*keys, _SEGMENT).orderBy(*order)
    reach = Window.unboundedFollowing if rows is None else rows
    placed = df.withColumn(_SEGMENT, segment).withColumn("__place", F.row_number().over(local).cast("long"))

    def mark(value: Column) -> Column:
        return F.when(value.isNotNull(), F.struct(F.col("__place").alias("place"), value.alias("value")))

    summary = placed.groupBy(*keys, _SEGMENT).agg(
        F.count("*").alias("__rows"), *[F.min(mark(value)).alias(f"__first_{n}") for n, value in values.items()]
    )
    by_segment = Window.partitionBy(*keys).orderBy(_SEGMENT)
    base = F.coalesce(
        F.sum("__rows").over(by_segment.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")
    )
    later = by_segment.rowsBetween(1, Window.unboundedFollowing)

    def moved(name: str) -> Column:
        first = F.col(f"__first_{name}")
        there = F.struct((F.col("__base") + first["place"]).alias("place"), first["value"].alias("value"))
        return F.first(F.when(first.isNotNull(), there), ignorenulls=True).over(later)

    carried = summary.withColumn("__base", base).select(
        *keys, _SEGMENT, "__base", *[moved(n).alias(f"__carry_{n}") for n in values]
    )
    ahead = placed.select(
        "*",
        *[
            F.first(mark(value), ignorenulls=True).over(local.rowsBetween(1, reach)).alias(f"__local_{n}")
            for n, value in values.items()
        ],
    )
    out = []
    for n in values:
        inside, outside = F.col(f"__local_{n}"), F.col(f"__carry_{n}")
        gap = outside["place"] - F.col("__base") - F.col("__place")
        near = F.lit(True) if rows is None else gap <= rows
        out += [
            F.coalesce(inside["value"], F.when(near, outside["value"])).alias(n),
            F.coalesce(inside["place"] - F.col("__place"), F.when(near, gap)).alias(f"{n}_in"),
        ]
    return _with_carry(ahead, carried, keys).select(*df.columns, *out)


def with_key_values(
    df: DataFrame, keys: Sequence[str], segment: Column, per_key: DataFrame
) -> DataFrame:
    """The rows with the columns of ``per_key`` (one row a key), NULL where a key has none.

    The values go to the segments of their key first and from there to the rows, so no task
    holds more than a segment of one key.
    """
    names = [name for name in per_key.columns if name not in keys]
    rows = df.withColumn(_SEGMENT, segment)
    known = per_key.withColumnsRenamed({name: f"__same_{name}" for name in keys})
    same = [F.col(name).eqNullSafe(F.col(f"__same_{name}")) for name in keys]
    spread_out = rows.select(*keys, _SEGMENT).distinct().join(known, same, "left")
    return _with_carry(rows, spread_out.select(*keys, _SEGMENT, *names), keys).select(*df.columns, *names)


def key_totals(
    df: DataFrame, keys: Sequence[str], segment: Column, values: dict[str, Column]
) -> DataFrame:
    """Sums over the whole key, on every row."""
    totals = df.groupBy(*keys).agg(*[F.sum(value).alias(name) for name, value in values.items()])
    return with_key_values(df, keys, segment, totals)


def running_sum(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    segment: Column,
    values: dict[str, Column],
    exclusive: bool = False,
) -> DataFrame:
    """Cumulative sums up to each row (before it, if ``exclusive``); 0 at the start."""
    rows = df.withColumn(_SEGMENT, segment)
    summary = rows.groupBy(*keys, _SEGMENT).agg(
        *[F.sum(value).alias(f"__carry_{name}") for name, value in values.items()]
    )
    before = Window.partitionBy(*keys).orderBy(_SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *keys,
        _SEGMENT,
        *[F.sum(f"__carry_{n}").over(before).alias(f"__carry_{n}") for n in values],
    )
    frame = _frame(keys, order, exclusive)
    local = rows.select(
        "*", *[F.sum(v).over(frame).alias(f"__local_{n}") for n, v in values.items()]
    )
    zero = F.lit(0).cast("long")
    return _with_carry(local, carried, keys).select(
        *df.columns,
        *[
            (F.coalesce(f"__local_{n}", zero) + F.coalesce(f"__carry_{n}", zero)).alias(n)
            for n in values
        ],
    )


def global_offsets(df: DataFrame, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Sums over all rows before each row in a total order; 0 at the start.

    The rows are range-sorted and checkpointed, which fixes their partitions. Sums run
    inside each partition, and only one row per partition is scanned in a single task.
    Pass narrow rows: the checkpoint holds all of them.
    """
    placed = (
        reliable_checkpoint(df.orderBy(*order))
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id())
    )
    zero = F.lit(0).cast("long")
    totals = placed.groupBy("__part").agg(
        *[F.sum(value).alias(f"__total_{name}") for name, value in values.items()]
    )
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        "__part",
        *[F.coalesce(F.sum(f"__total_{n}").over(earlier), zero).alias(f"__start_{n}") for n in values],
    )
    inside = (
        Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    )
    local = placed.select(
        "*", *[F.coalesce(F.sum(v).over(inside), zero).alias(f"__local_{n}") for n, v in values.items()]
    )
    return local.join(starts, "__part").select(
        *df.columns, *[(F.col(f"__local_{n}") + F.col(f"__start_{n}")).alias(n) for n in values]
    )
