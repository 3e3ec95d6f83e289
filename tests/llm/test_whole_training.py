"""Models learn from all rows, however many there are."""

from pyspark.sql import functions as F

from weblake.llm import pii, toxicity


def test_span_model_sees_candidates_beyond_any_number_of_others(spark):
    mail, order = "Mail me: x@mail.example.com today", "Order (555) 123-4567 of room 3"
    place = lambda start, kind: F.xxhash64(F.col("doc_id"), F.lit(start), F.lit(kind))
    ids = spark.range(200_000).select(F.col("id").alias("doc_id"))
    known = ids.orderBy(place(9, 0)).limit(20_500).withColumn("text", F.lit(mail))
    others = ids.orderBy(place(6, 3).desc()).limit(500).withColumn("text", F.lit(order))
    docs = known.unionByName(others.join(known, "doc_id", "left_anti"))
    counted = {(r.kind, r.label): r.n for r in pii.counted_candidates(docs).groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    assert counted == {(0, 1.0): 20_500, (3, 0.0): docs.filter(F.col("text") == order).count()}
    assert pii.fit(docs).thresholds


def test_toxicity_learns_from_labels_beyond_any_number_of_others(spark):
    ids = spark.range(200_000).select(F.col("id").alias("doc_id")).filter(~toxicity.held_out())
    clean = ids.orderBy(F.xxhash64("doc_id")).limit(20_500).withColumn("text", F.lit("a plain and kindly word"))
    toxic = ids.orderBy(F.xxhash64("doc_id").desc()).limit(200).withColumn("text", F.lit("grubbish and vileness, scornful"))
    docs = clean.unionByName(toxic)
    labels = docs.select("doc_id", F.col("text").startswith("grubbish").cast("long").alias("toxic"))
    model = toxicity.fit(docs, labels)
    assert "=vileness" in model.lexicon.names
    assert model.score("grubbish and vileness, scornful") > 0.8 and model.score("a plain and kindly word") < 0.1


def test_toxicity_learns_once_from_repeated_rows(spark):
    rows = [(i, "vileness and scorn" if i % 5 == 0 else "a kindly word") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i, _ in rows], "doc_id long, toxic long")
    more = docs.filter("doc_id % 5 = 0").withColumn("text", F.lit("~ larger, so never read"))
    one, two = (toxicity.fit(d, labels) for d in (docs, docs.unionByName(docs).unionByName(more)))
    assert one.lexicon.names and one.lexicon.names == two.lexicon.names
    assert abs(one.weights - two.weights).max() < 1e-9
