"""Raw CSV tables: the files' number follows the rows, their order stays."""

from pyspark.sql import functions as F

from ordermart.operators import clean
from ordermart.plans import registry


def reviews(spark, n):
    rows = spark.range(n).select(
        F.floor((F.col("id") * 7919) % n / 2).alias("review_id"), F.lit('said, "so"\nthere').alias("text"), ((F.col("id") * 7919) % n).alias("src_order")
    )
    return rows.repartition(3)


def test_ordered_files_follow_the_size(spark, monkeypatch):
    df, n = reviews(spark, 3000), []
    monkeypatch.setattr(registry, "FILE_BYTES", 4000)
    for split in (False, True):
        back = registry._raw_csv(df, True, "src_order", split=split)
        n.append(len(registry._raw_csv(df, True, "src_order").inputFiles()))
        kept = clean.keep_first(back.withColumn("at", F.col("src_order")), ["review_id"], ["src_order"])
        assert kept.count() == 1500 and back.count() == 3000
        assert back.where(F.col("text") != 'said, "so"\nthere').count() == 0
    assert min(n) > 10
    few = registry._raw_csv(reviews(spark, 30), True, "src_order")
    assert len(few.inputFiles()) == registry.FILES


def test_unordered_files_with_newlines_follow_the_size(spark, monkeypatch):
    monkeypatch.setattr(registry, "FILE_BYTES", 4000)
    df = reviews(spark, 3000).drop("src_order")
    back = registry._raw_csv(df, True, infer=True)
    assert len(back.inputFiles()) > 10 and back.count() == 3000
    assert dict(back.dtypes) == {"review_id": "bigint", "text": "string"}
    assert registry._raw_csv(df.drop("text"), False).count() == 3000
