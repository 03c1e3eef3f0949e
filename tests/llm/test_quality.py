from pyspark.sql import functions as F

from lodestar.llm import quality


def test_held_out_rows_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(docs, labels)
    rows = quality.with_scores(docs, model).join(labels, "doc_id").where(~quality.training_row("doc_id")).select("score", "quality").collect()
    good, bad = [r.score for r in rows if r.quality == 1], [r.score for r in rows if r.quality == 0]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert auc > 0.9
    assert sum(s >= 0.3 for s in good) / len(good) > 0.97


def test_no_label_of_a_held_out_row_is_learnt(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * 9) for i in range(60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    held = [r.doc_id for r in docs.where(~quality.training_row("doc_id")).collect()]
    flipped = labels.withColumn("quality", F.when(F.col("doc_id").isin(held), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert held and quality.fit(docs, labels) == quality.fit(docs, flipped)


def test_edges(spark, docs, no_docs):
    some = spark.createDataFrame([(1, 1), (2, 0), (3, None), (8, 1), (9, 0), (7, 5)], "doc_id long, quality int")
    for labels in (some, some.where("quality = 1"), some.where("false")):
        model = quality.fit(docs, labels)
        got = quality.with_scores(docs, model, score_col="s").collect()
        assert len(got) == docs.count() and all(0 <= r.s <= 1 for r in got)
        assert {r.s for r in got if not r.text} == {model.prior}
    assert quality.with_scores(no_docs, quality.fit(no_docs, some)).count() == 0
