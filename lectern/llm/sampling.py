"""Bounded samples of labelled texts for fitting classifiers on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 40
_SPARE = 8


def remainder(doc_id: Column, modulus: int) -> Column:
    """``crc32`` of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, per_label: int, chars: int) -> dict:
    """Label to texts: at most ``per_label`` documents of each, at most ``chars`` of each.

    ``labels`` has ``doc_id`` and ``label``. Documents are taken in order of a hash of their
    id. Of a longer text the sample has ``chars`` characters from a place that the hash gives,
    of several texts with one id the smallest piece. Ids are ranked without texts, after a
    cut of the hash's range that leaves about eight times as many as are wanted, so a label
    of any size sends few rows to its ranking. The cut follows the label's number of distinct
    ids (estimated within a few percent), so repeated rows do not narrow it, and a label with
    few ids keeps its whole range. Only the ranked ids' texts are fetched: the
    ids are broadcast, at most ``per_label`` for each label, as are the labels' counts (each
    label has a model of its own in the driver).
    """
    order = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(17)), F.lit(_RANGE))
    named = labels.filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull())
    counts = named.groupBy("label").agg(F.approx_count_distinct("doc_id").alias("__ids"))
    wanted = F.lit(float(_RANGE)) * (_SPARE * per_label) / F.col("__ids")
    rank = F.row_number().over(Window.partitionBy("label").orderBy(order, "doc_id"))
    ids = (
        named.join(F.broadcast(counts), "label")
        .filter(order <= wanted)
        .select("label", "doc_id")
        .distinct()
        .withColumn("__rank", rank)
        .filter(F.col("__rank") <= per_label)
    )
    span = F.greatest(F.length("text") - chars + 1, F.lit(1)).cast("bigint")
    start = (F.pmod(order, span) + 1).cast("int")
    texts = (
        docs.filter(F.length("text") > 0)
        .select("doc_id", F.substring("text", start, F.lit(chars)).alias("text"))
        .join(F.broadcast(ids.select("doc_id", "label")), "doc_id")
        .groupBy("label", "doc_id")
        .agg(F.min("text").alias("text"))
        .select("label", order.alias("at"), "text")
    )
    out: dict = {}
    for row in sorted(texts.collect(), key=lambda r: (str(r[0]), r[1], r[2])):
        out.setdefault(row[0], []).append(row[2])
    return out
