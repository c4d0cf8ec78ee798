"""Spans are found and cut in one Python stage."""

from pyspark.sql import functions as F

from lectern.llm.decontaminate import remove_items

ITEM = "one two three four five six seven eight nine ten eleven"


def test_documents_pass_python_once(spark):
    docs = spark.createDataFrame(
        [(1, "before it came " + ITEM + " and after it much more was said here by all of them"), (2, ITEM), (3, "nothing"), (4, None), (5, "")],
        "doc_id long, text string",
    )
    items = spark.createDataFrame([("i", ITEM)], "item_id string, text string")
    kept = remove_items(docs.withColumn("items", F.lit("mine")), items)
    plan = kept._sc._jvm.PythonSQLUtils.explainString(kept._jdf.queryExecution(), "simple")
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1
    rows = {r.doc_id: r.text for r in kept.collect()}
    assert rows == {1: "before it came  and after it much more was said here by all of them", 3: "nothing", 4: None, 5: ""}
    assert kept.columns == ["doc_id", "text", "items"]
