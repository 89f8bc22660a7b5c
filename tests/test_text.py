"""Text operators on small tables."""

from pyspark.sql import functions as F

from lamella.operators import text
from lamella.plans.text_queries import evd_quotes


def test_quotes_of_all_pairs(spark, tmp_path):
    """Items 240 and above, documents divisible by 240 and pairs of any numbers are looked at."""
    said = "one two three four five six seven eight nine"
    docs = spark.createDataFrame([(240, f"He said: {said.upper()}!"), (7, "Two, three - four; five six"), (8, "two three four six five"), (9, None), (10, "")], "doc_id bigint, text string")
    items = spark.createDataFrame([(240, said), (3, "a b c d e f g"), (5, said + " ten eleven twelve"), (6, None)], "item_id bigint, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    items.write.parquet(str(tmp_path / "eval_items.parquet"))
    got = sorted((r["doc_id"], r["item_id"]) for r in evd_quotes(spark, str(tmp_path)).collect())
    pairs = docs.crossJoin(items.withColumnRenamed("text", "quote")).where(text.quote_found(F.col("quote"), F.col("text")))
    assert got == sorted((r["doc_id"], r["item_id"]) for r in pairs.select("doc_id", "item_id").collect())
    assert got == [(7, 5), (7, 240), (240, 5), (240, 240)]
