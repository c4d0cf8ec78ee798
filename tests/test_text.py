import unicodedata

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import text as T

SETTINGS = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)
ALPHABET = "aB é \n\r\t\x1c ßﬁ²…É.!?;0 1"


def evaluate(spark, texts, *columns):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return frame.select("i", *columns).orderBy("i").collect()


def fold(text):
    return " ".join(unicodedata.normalize("NFKC", text).split()).casefold()


@SETTINGS
@given(st.lists(st.text(ALPHABET, max_size=30), min_size=1, max_size=40))
def test_python_string_semantics(spark, texts):
    t = F.col("t")
    rows = evaluate(
        spark,
        texts,
        T.strip(t).alias("strip"),
        T.rstrip(t).alias("rstrip"),
        T.split_lines(t).alias("lines"),
        T.count_words(t).alias("words"),
        T.normalise(t).alias("folded"),
    )
    for text, row in zip(texts, rows):
        assert row.strip == text.strip()
        assert row.rstrip == text.rstrip()
        assert row.lines == text.splitlines()
        assert row.words == len(text.split())
        assert row.folded == fold(text)


def test_clean_text_squeezes_blank_lines(spark):
    row = evaluate(spark, ["\n a  \n \n\t\n\nb\t\n\n"], T.clean_text(F.col("t")).alias("c"))[0]
    assert row.c == "a\n\nb"


def test_units_keep_twelve_characters_and_drop_digits(spark):
    text = "Onze signes\nDouze signes\n12/03 - 2024. 17\nUne phrase. Une autre phrase!"
    row = evaluate(spark, [text], T.sentence_units(F.col("t")).alias("u"))[0]
    assert row.u == ["Douze signes", "Une autre phrase!"]


def test_round_like_python(spark):
    values = [k / 100 for k in range(0, 3000)] + [k + 0.25 for k in range(40)] + [-6.55, -0.25]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    for row in frame.select("v", T.python_round1(F.col("v")).alias("r")).collect():
        assert row.r == round(row.v, 1), row


def test_short_numeric_lines(spark):
    text = "page 1\n" + "x" * 39 + "1\nno digit\n  ²  "
    row = evaluate(spark, [text], T.short_numeric_lines(F.col("t")).alias("n"))[0]
    assert row.n == 2
