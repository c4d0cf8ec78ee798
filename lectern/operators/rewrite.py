"""Conversational rewriting of template questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions import fixed
from lectern.functions.arrays import bind, last_of
from lectern.functions.text import strip


def clean_topic(title: Column) -> Column:
    """A section title as a noun phrase with its article."""
    bare = F.regexp_replace(title, fixed.TOPIC_NUMBERING, "")
    bare = strip(F.regexp_replace(bare, fixed.TOPIC_BULLET, ""))
    articles = "|".join(fixed.TOPIC_ARTICLES)
    vowels = "".join(fixed.TOPIC_VOWELS)

    def lowered(topic):
        capitals = (F.upper(topic) == topic) & (F.lower(topic) != topic)
        first = F.concat(F.lower(F.substring(topic, 1, 1)), F.substring(topic, 2, 1 << 30))
        return F.when(capitals, F.lower(topic)).otherwise(first)

    def with_article(topic):
        return (
            F.when(topic.rlike(f"^(?:{articles})"), topic)
            .when(topic.rlike(f"^[{vowels}]"), F.concat(F.lit("l'"), topic))
            .when(topic.endswith("s") & ~topic.endswith("ss"), F.concat(F.lit("les "), topic))
            .otherwise(F.concat(F.lit("le "), topic))
        )

    return bind(bind(bare, lowered), with_article)


def conversational_question(question_type: Column, title: Column) -> Column:
    pairs = [F.lit(x) for pair in fixed.REWRITE_TEMPLATES.items() for x in pair]
    template = F.coalesce(
        F.try_element_at(F.create_map(*pairs), question_type), F.lit(fixed.REWRITE_DEFAULT)
    )
    return F.replace(template, F.lit("%s"), clean_topic(title))


def rewrite_questions(items: DataFrame) -> DataFrame:
    """Replace each question whose section title is known; other rows stay as they are.

    The title is the last of ``section_path``, else the text between guillemets in the
    question. A missing ``question_type`` counts as factual.
    """
    quoted = F.regexp_extract("question", fixed.QUOTED_TITLE, 1)
    has_path = F.coalesce(F.size("section_path") > 0, F.lit(False))
    title = F.when(has_path, last_of(F.col("section_path"))).otherwise(quoted)
    kind = F.coalesce("question_type", F.lit(fixed.DEFAULT_QUESTION_TYPE))
    return items.withColumn(
        "question",
        F.when(F.coalesce(title, F.lit("")) != "", conversational_question(kind, title)).otherwise(
            F.col("question")
        ),
    )
