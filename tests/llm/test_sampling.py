from pyspark.sql import functions as F

from lectern.llm.sampling import labelled_sample


def test_repeated_rows_do_not_thin_a_label(spark):
    docs = spark.createDataFrame([(i, f"text {i:03d}") for i in range(60)], "doc_id long, text string")
    labels = spark.range(30).select(F.col("id").alias("doc_id"), F.lit("aa").alias("label"))
    rare = spark.range(30, 33).select(F.col("id").alias("doc_id"), F.lit("bb").alias("label"))
    plain = labelled_sample(docs, labels.unionByName(rare), 4, 8)
    copies = spark.range(40_000).select((F.col("id") % 2 * 30).alias("doc_id"), F.lit("aa").alias("label"))
    more = copies.withColumn("label", F.when(F.col("doc_id") == 30, "bb").otherwise("aa"))
    thick = labelled_sample(docs, labels.unionByName(rare).unionByName(more), 4, 8)
    assert {k: len(v) for k, v in thick.items()} == {"aa": 4, "bb": 3}
    assert thick == plain
