"""Line deduplication by distinct-site spread.

A line that stands on many sites is boilerplate. Every line hash gets a HyperLogLog sketch of
its sites; sketches are built per task and merged by the aggregation, so a line on a third of
all documents is a sketch like any other. Lines whose estimate lies near the threshold get
their distinct sites counted exactly; the others are decided by the estimate. Of a boilerplate
line the first occurrence (smallest document id, then position) stays and all others go, so no
line is lost to the corpus.

Line hashes, not lines, are shuffled and stored; a text is moved once, to meet the positions
of the lines it loses.

Lines are matched with what is known of them in ``SALTS`` parts, so the most frequent line is
not one task. A very long text is one row of lines and is moved once like any other.

Defined results: lines are compared without blanks at either end; lines shorter than
``MIN_CHARS`` are left alone; a null text stays null; a null site is a site of its own; rows
with equal id and text are one document here and lose the same lines; a null id counts as
smaller than all others; an empty table gives an empty result; other columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.session import reliable_checkpoint

MIN_SITES = 5
MIN_CHARS = 15
SALTS = 32
SKETCH_BITS = 12
# A sketch of 2**12 registers errs by 1.6 % (one standard deviation).
MARGIN = 0.07


def _trimmed(line: Column) -> Column:
    return F.regexp_replace(line, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")


def line_occurrences(docs: DataFrame, site: str = "source", min_chars: int = MIN_CHARS) -> DataFrame:
    """``(__id, __key, __site, pos, line)`` of every line that is long enough; lines hashed."""

    def hashed(line: Column) -> Column:
        trimmed = _trimmed(line)
        return F.when(F.length(trimmed) >= min_chars, F.xxhash64(trimmed))

    lines = F.transform(F.split("text", "\n"), hashed)
    rows = docs.select(
        F.col("doc_id").alias("__id"),
        F.xxhash64("text").alias("__key"),
        F.coalesce(F.col(site).cast("string"), F.lit("\0")).alias("__site"),
        F.posexplode_outer(lines).alias("pos", "line"),
    )
    return rows.filter(F.col("line").isNotNull())


def _of_lines(occurrences: DataFrame, lines: DataFrame) -> DataFrame:
    """Occurrences joined with ``lines``, one row a line, where a line may be very frequent.

    A line's occurrences go to ``SALTS`` tasks, so the line's row goes to each of them.
    """
    salted = occurrences.withColumn("__salt", F.pmod(F.xxhash64("__id", "pos"), F.lit(SALTS)).cast("int"))
    copies = lines.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["line", "__salt"]).drop("__salt")


def boilerplate_lines(
    occurrences: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN
) -> DataFrame:
    """``(line, first)``: lines on at least ``min_sites`` sites, and where each stands first."""
    spread = occurrences.groupBy("line").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("__site", F.lit(SKETCH_BITS))).alias("sites"),
        F.min(F.struct("__id", "__key", "pos")).alias("first"),
    )
    near = max(1, int(-(-min_sites * margin // 1)))
    candidates = reliable_checkpoint(spread.filter(F.col("sites") >= min_sites - near))
    sure = candidates.filter(F.col("sites") > min_sites + near).select("line", "first")
    unsure = candidates.filter(F.col("sites") <= min_sites + near)
    exact = (
        _of_lines(occurrences, unsure.select("line"))
        .select("line", "__site")
        .distinct()
        .groupBy("line")
        .agg(F.count("*").alias("exact"))
        .filter(F.col("exact") >= min_sites)
    )
    return sure.unionByName(unsure.join(exact, "line", "left_semi").select("line", "first"))


def remove_boilerplate(
    docs: DataFrame,
    site: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """The rows of ``docs`` with boilerplate lines cut from ``text``, and ``n_removed``.

    A column ``n_removed`` of ``docs`` is replaced.
    """
    docs = docs.drop("n_removed")
    occurrences = reliable_checkpoint(line_occurrences(docs, site, min_chars))
    known = boilerplate_lines(occurrences, min_sites)
    here = F.struct("__id", "__key", "pos")
    drops = (
        _of_lines(occurrences, known)
        .filter(~here.eqNullSafe(F.col("first")))
        .groupBy("__id", "__key")
        .agg(F.collect_set("pos").alias("__drop"))
    )
    joined = docs.withColumn("__text_key", F.xxhash64("text")).join(
        drops, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text_key") == F.col("__key")), "left"
    )
    lines = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__drop"))
    text = F.when(F.col("__drop").isNull(), F.col("text")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")
    )
    return joined.select(
        *[text.alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_removed"),
    )


def line_table(docs: DataFrame) -> DataFrame:
    """Lines, removed lines, characters and hash of the remaining text of every document."""
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    own = docs.select("doc_id", "text", "source", n_lines.cast("long").alias("n_lines"))
    return remove_boilerplate(own).select(
        "doc_id",
        "n_lines",
        "n_removed",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_left"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"),
    )


# The same rule for DuckDB, with exact counts throughout.
ORACLE = rf"""
WITH lines AS (
  SELECT doc_id, source, text, i - 1 AS pos, trim(list[i], E' \t\n\v\f\r') AS line
  FROM (SELECT *, string_split(text, E'\n') AS list FROM documents), unnest(range(1, len(list) + 1)) AS u(i)
), known AS (
  SELECT line, count(DISTINCT coalesce(source, E'\x01')) AS sites, min((doc_id, pos)) AS first
  FROM lines WHERE length(line) >= {MIN_CHARS} GROUP BY line
  HAVING count(DISTINCT coalesce(source, E'\x01')) >= {MIN_SITES}
), kept AS (
  SELECT l.doc_id, l.pos, string_split(l.text, E'\n')[l.pos + 1] AS raw
  FROM lines l LEFT JOIN known k ON l.line = k.line
  WHERE k.line IS NULL OR (l.doc_id, l.pos) = k.first
), joined AS (
  SELECT doc_id, count(*) AS n, string_agg(raw, E'\n' ORDER BY pos) AS text FROM kept GROUP BY doc_id
)
SELECT d.doc_id, len(string_split(d.text, E'\n')) AS n_lines,
  len(string_split(d.text, E'\n')) - coalesce(j.n, 0) AS n_removed,
  length(coalesce(j.text, '')) AS n_chars_left, sha256(coalesce(j.text, '')) AS text_sha256
FROM documents d LEFT JOIN joined j USING (doc_id)
"""
