"""Mixing sources to target weights by Pareto order sampling.

Every source gets a target number of words. Sources are weighted in code point order, a
missing source last, and share all words by weight; a source stops at ``most_copies`` times
its own words and what it cannot take is shared again by weight. A source whose target is
``f`` times its words takes ``floor(f)`` whole copies of each document.

The rest is an unequal-probability sample. Longer documents are likelier to be in it: the
inclusion odds ``p / (1 - p)`` of a document are ``scale * 2 ** (c * LENGTH_POWER)``, where ``c``
numbers its size class (sizes from ``2 ** c`` up to the next power; ``LENGTH_POWER`` 0.5 is the
square root of the length, 0 gives all the same chance). The source's ``scale`` makes the expected
words of the sample the words that remain for it. Documents are ranked by
``(u / (1 - u)) / (p / (1 - p))``, with ``u`` a uniform number hashed from id and text, and the lowest
ranks are taken until those words are reached (the document that crosses the border is taken if
its middle lies before it). A document of more than twice those words, whose middle is always
beyond them, has probability 0 and is not in the way of others.

Nothing but DataFrame expressions is used. A source may hold any share of the rows: its ranks
are summed in slices (``scans.running_sum``), which hold equal shares, since the distribution of
a source's ranks follows from its size classes; the border is one number per source, and every
document compares itself with it. Only one row per source, with one entry per size class, meets
in one task.

Defined results: a null text has no words; a null source is a source of its own; documents
without words are taken or left like others and count nothing; rows with equal id and text
have running numbers, which enter their uniform numbers, so each is drawn on its own; texts of
any length are counted whole; an empty table gives an empty result; other
columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.arrays import bind
from lectern.operators.scans import running_sum
from lectern.session import reliable_checkpoint

WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SLICE_ROWS = 5_000
LENGTH_POWER = 0.5
SCALE_BITS = 64  # A scale lies between 2 ** -SCALE_BITS and 2 ** SCALE_BITS.
SCALE_STEPS = 60
_SPACE = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(_SPACE)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, most_copies: int = MOST_COPIES
) -> DataFrame:
    """``(source, source_no, rows, source_size, target)`` from rows of ``(source, size)``.

    The common level ``l`` with ``target = min(most_copies * size, l * weight)`` is found in
    order of ``most_copies * size / weight``: the first source whose cap is not below the
    level that remains for it and all later ones sets it.
    """
    totals = sizes.groupBy("source").agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("source_size")
    )
    return _targets(totals, weights, most_copies)


def _targets(totals: DataFrame, weights: Sequence[float], most_copies: int) -> DataFrame:
    """Targets from one row ``(source, rows, source_size)`` per source; other columns stay."""
    others = [c for c in totals.columns if c not in ("source", "rows", "source_size")]
    numbered = totals.withColumn(
        "source_no", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    )
    pattern = F.array(*[F.lit(float(w)) for w in weights])
    capped = (
        numbered.withColumn(
            "weight", F.get(pattern, (F.col("source_no") % F.lit(len(weights))).cast("int"))
        )
        .withColumn("cap", (F.col("source_size") * F.lit(most_copies)).cast("double"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
    )
    order = Window.orderBy("ratio", "source_no")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0)).rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing
    )
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ) / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levelled = capped.withColumn("level", level).withColumn(
        "level",
        F.first(F.when(F.col("level") <= F.col("ratio"), F.col("level")), ignorenulls=True).over(
            order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        ),
    )
    target = F.least(F.col("cap"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return levelled.select("source", "source_no", "rows", "source_size", target.alias("target"), *others)


def _whole(target: Column, size: Column) -> Column:
    """Whole copies of each document of a source."""
    ratio = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    # A ratio a rounding error below a whole number counts as that number.
    return F.floor(ratio + F.lit(1e-9)).cast("long")


def _size_class(size: Column) -> Column:
    """``floor(log2(size))``, exactly: the length of the size in bits, less one; 0 for size 0."""
    return (F.length(F.bin(F.greatest(size, F.lit(1)))) - 1).cast("int")


def _class_odds(size_class: Column, power: float) -> Column:
    return F.pow(F.lit(2.0), size_class * F.lit(power))


def _scale(classes: Column, room: Column, power: float) -> Column:
    """Factor of the odds with which a source's sample is expected to hold ``room`` words.

    ``classes`` has ``size_class``, ``rows`` and ``words``. The expected words rise with the scale,
    so its binary logarithm is found by bisection.
    """

    def expected(log_scale):
        def share(total, c):
            odds = F.pow(F.lit(2.0), log_scale) * _class_odds(c["size_class"], power)
            return total + c["words"] * (odds / (1 + odds))

        return F.aggregate(classes, F.lit(0.0), share)

    def halve(found, step):
        width = F.lit(float(SCALE_BITS)) / F.pow(F.lit(2.0), step)
        return bind(found + width, lambda middle: F.when(expected(middle) <= room, middle).otherwise(found))

    steps = F.sequence(F.lit(0), F.lit(SCALE_STEPS))
    return F.pow(F.lit(2.0), F.aggregate(steps, F.lit(-float(SCALE_BITS)), halve))


def _uniform(key: Column) -> Column:
    """A number between 0 and 1 from the first 52 bits of a key in hexadecimal."""
    digits = F.conv(F.substring(key, 1, 13), 16, 10).cast("long")
    return (digits + F.lit(0.5)) / F.lit(float(1 << 52))


def _rank(key: Column, odds: Column) -> Column:
    """Pareto ranking variable, random odds by inclusion odds; NULL without a sample."""
    u = _uniform(key)
    return F.when(odds > 0, (u / (1 - u)) / odds)


def _rank_share(rank: Column, classes: Column, scale: Column, power: float) -> Column:
    """Share of a source's ranks expected below ``rank``: those of each class, by their rows."""

    def add(acc, c):
        odds = rank * scale * _class_odds(c["size_class"], power)
        # In this form every rounded step keeps the order of the ranks.
        return F.struct(
            (acc["below"] + c["rows"] * (1 - 1 / (1 + odds))).alias("below"),
            (acc["rows"] + c["rows"]).alias("rows"),
        )

    start = F.struct(F.lit(0.0).alias("below"), F.lit(0).cast("long").alias("rows"))
    return F.aggregate(classes, start, add, lambda acc: acc["below"] / F.greatest(acc["rows"], F.lit(1)))


def _keyed(docs: DataFrame) -> DataFrame:
    """The rows with ``__key``, a hash of id and text; equal rows get keys of their own.

    Equal rows are numbered by sums over the tasks that hold them, so a row that is repeated
    without end is in no one task. Which of them gets which number makes no difference.
    """
    said = F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))
    own = F.md5(F.concat(*said))
    marked = docs.withColumn("__key", own)
    repeated = reliable_checkpoint(
        docs.select(own.alias("__key")).groupBy("__key").agg(F.count("*").alias("__n")).filter(F.col("__n") > 1).drop("__n")
    )
    if repeated.isEmpty():
        return marked
    placed = reliable_checkpoint(
        marked.join(repeated, "__key", "left_semi")
        .withColumn("__part", F.spark_partition_id())
        .withColumn("__at", F.monotonically_increasing_id())
    )
    numbered = running_sum(
        placed, ["__key"], ["__at"], F.col("__part"), {"__number": F.lit(1).cast("long")}, exclusive=True
    )
    again = F.when(F.col("__number") > 0, F.md5(F.concat("__key", F.lit(":"), "__number"))).otherwise(F.col("__key"))
    several = numbered.withColumn("__key", again).select(*marked.columns)
    return marked.join(repeated, "__key", "left_anti").select(*marked.columns).unionByName(several)


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    most_copies: int = MOST_COPIES,
    slice_rows: int = SLICE_ROWS,
    keep: Sequence[str] = (),
    length_power: float = LENGTH_POWER,
) -> DataFrame:
    """``doc_id, size, source_size, target, copies, inclusion`` per row, and the columns in ``keep``.

    ``inclusion`` is the probability with which the document is in the sample that comes on top
    of the whole copies.
    """
    size = word_count(F.col("text"))
    docs = _keyed(docs.select(*dict.fromkeys(["doc_id", "source", "text", *keep])))
    narrow = docs.select("source", size.alias("size"), F.col("__key").alias("key"))
    by_class = narrow.groupBy("source", _size_class(F.col("size")).alias("size_class")).agg(
        F.count("*").alias("rows"), F.sum("size").alias("words")
    )
    totals = by_class.groupBy("source").agg(
        F.sum("rows").alias("rows"),
        F.sum("words").alias("source_size"),
        F.array_sort(F.collect_list(F.struct("size_class", "rows", "words"))).alias("classes"),
    )
    targets = _targets(totals, weights, most_copies)
    whole = _whole(F.col("target"), F.col("source_size"))
    room = F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))
    fits = F.filter("classes", lambda c: F.pow(F.lit(2.0), c["size_class"]) <= 2 * F.col("room"))
    targets = targets.withColumn("whole", whole).withColumn("room", room).withColumn("classes", fits)
    scale = F.when(F.col("room") > 0, _scale(F.col("classes"), F.col("room"), length_power))
    targets = reliable_checkpoint(targets.withColumn("scale", scale))

    def drawn(size: Column) -> Column:
        odds = F.col("t.scale") * _class_odds(_size_class(size), length_power)
        return F.when((F.col("t.room") > 0) & (size <= 2 * F.col("t.room")), odds).otherwise(F.lit(0.0))

    by_source = F.col("s.source").eqNullSafe(F.col("t.source"))
    ranked = (
        narrow.alias("s")
        .join(targets.alias("t"), by_source)
        .select("t.source_no", "t.rows", "t.room", "t.scale", "t.classes", "s.size", "s.key",
                _rank(F.col("s.key"), drawn(F.col("s.size"))).alias("rank"))
        .filter(F.col("rank").isNotNull())
    )
    share = _rank_share(F.col("rank"), F.col("classes"), F.col("scale"), length_power)
    slices = F.floor(share * (1 + F.floor(F.col("rows") / slice_rows)))
    placed = running_sum(
        ranked.select("source_no", "room", "size", "key", "rank", slices.alias("slice")),
        ["source_no"], ["rank", "key"], F.col("slice"), {"before": F.col("size")}, exclusive=True,
    )
    borders = placed.filter(F.col("before") + F.col("size") / 2 <= F.col("room")).groupBy("source_no").agg(
        F.max("rank").alias("border")
    )
    limits = targets.join(borders, "source_no", "left")

    named = docs.select(
        *[F.col(c).alias(f"__keep_{c}") for c in keep],
        F.col("doc_id"),
        F.col("source").alias("__source"),
        size.alias("size"),
        "__key",
    )
    odds = drawn(F.col("d.size"))
    taken = F.coalesce(_rank(F.col("d.__key"), odds) <= F.col("t.border"), F.lit(False))
    return (
        named.alias("d")
        .join(limits.alias("t"), F.col("d.__source").eqNullSafe(F.col("t.source")))
        .select(
            *[F.col(f"d.__keep_{c}").alias(c) for c in keep if c != "doc_id"],
            "d.doc_id",
            "d.size",
            "t.source_size",
            "t.target",
            (F.col("t.whole") + taken.cast("long")).alias("copies"),
            (odds / (1 + odds)).alias("inclusion"),
        )
    )


# The same mix of ``documents`` in DuckDB's SQL.
ORACLE = rf"""
WITH RECURSIVE sized AS (
    SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{_SPACE}')), 0) AS size,
           md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')) AS plain
    FROM documents
), numbered AS (
    SELECT *, row_number() OVER (PARTITION BY plain) - 1 AS n FROM sized
), docs AS (
    SELECT doc_id, source, size, length(bin(greatest(size, 1)::BIGINT)) - 1 AS c,
           CASE WHEN n = 0 THEN plain ELSE md5(plain || ':' || n) END AS key
    FROM numbered
), totals AS (
    SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source
), weighed AS (
    SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS source_no,
           ({list(WEIGHTS)})[((source_no % {len(WEIGHTS)}) + 1)::INT]::DOUBLE AS weight,
           {MOST_COPIES} * source_size::DOUBLE AS cap
    FROM totals
), levels AS (
    SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER before, 0))
              / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS own_level
    FROM weighed
    WINDOW before AS (ORDER BY cap / weight, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
    SELECT coalesce(arg_min(own_level, (cap / weight, source_no)) FILTER (own_level <= cap / weight), 0) AS level
    FROM levels
), targets AS (
    SELECT source, source_no, source_size, least(cap, level * weight) AS target,
           CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-9) ELSE 0 END::BIGINT AS whole,
           greatest(target - whole * source_size, 0) AS room
    FROM weighed, level
), classes AS (
    SELECT t.source_no, d.c, sum(d.size)::DOUBLE AS words
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
    WHERE pow(2.0, d.c) <= 2 * t.room
    GROUP BY t.source_no, d.c
), halving AS (
    SELECT source_no, room, 0 AS step, -{float(SCALE_BITS)} AS found FROM targets WHERE room > 0
    UNION ALL
    SELECT h.source_no, h.room, h.step + 1,
           CASE WHEN (
               SELECT sum(k.words * (pow(2.0, h.found + {float(SCALE_BITS)} / pow(2.0, h.step))
                                     * pow(2.0, k.c * {LENGTH_POWER})
                                     / (1 + pow(2.0, h.found + {float(SCALE_BITS)} / pow(2.0, h.step))
                                        * pow(2.0, k.c * {LENGTH_POWER}))))
               FROM classes k WHERE k.source_no = h.source_no
           ) <= h.room THEN h.found + {float(SCALE_BITS)} / pow(2.0, h.step) ELSE h.found END
    FROM halving h WHERE h.step <= {SCALE_STEPS}
), scales AS (
    SELECT source_no, pow(2.0, found) AS scale FROM halving WHERE step = {SCALE_STEPS + 1}
), ranked AS (
    SELECT d.*, t.source_no, t.source_size, t.target, t.whole, t.room,
           (('0x' || substr(key, 1, 13))::BIGINT + 0.5::DOUBLE) / pow(2.0, 52) AS u,
           CASE WHEN size <= 2 * room THEN u / (1 - u) / (scale * pow(2.0, c * {LENGTH_POWER})) END AS rank
    FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN scales USING (source_no)
), summed AS (
    SELECT *, sum(size) OVER (PARTITION BY source_no ORDER BY rank, key
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
    FROM ranked WHERE rank IS NOT NULL
), borders AS (
    SELECT source_no, max(rank) AS border FROM summed WHERE before + size / 2.0 <= room GROUP BY source_no
)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole + coalesce(rank <= border, false)::BIGINT)::BIGINT AS copies, copies * size::BIGINT AS taken
FROM ranked LEFT JOIN borders USING (source_no)
"""
