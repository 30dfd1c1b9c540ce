"""Columns named as operators name their own helpers, and repeated keys."""

import corpus_pipeline
from pyspark.sql import functions as F

from gridwright.llm import decontamination, quality_classifier, quality_rules, secret_scan, suffix_dedup, url_filters


def test_helper_names_in_the_table_stay(spark, odd):
    texts = odd.select(F.coalesce("text", F.lit("")).alias("t"), (F.col("doc_id") < 5).alias("trusted")).fillna(False)
    ruled = quality_rules.rules(odd, quality_rules.log_ratios_within(texts, 64), buckets=64)
    left = suffix_dedup.remove(odd)
    for found in (ruled, left):
        assert found.count() == odd.count() and {r.words_ for r in found.select("words_").collect()} == {"words_"}
        assert {r.own_sha256_ for r in found.select("own_sha256_").collect()} == {"own_sha256_"}
    assert all(r.has_repeats == (r.n_removed > 0) for r in left.collect())
    masked = corpus_pipeline.mask_secrets(spark, odd.withColumn("n_chars", F.lit(1).cast("long")), "")
    assert set(odd.columns) <= set(masked.columns) and {r.text_before_ for r in masked.collect()} == {"text_before_"}


def test_captures_with_helper_names(spark):
    captures = spark.createDataFrame([("http://a.b/c", "2024-01-02", 1, 2), (None, None, 3, 4)], "url string, fetched string, u_ int, f_ int")
    entries = spark.createDataFrame([("spam", "host:a.b", "add", "2024-01-01")], "list string, pattern string, action string, day string")
    found = url_filters.evaluate(captures.withColumn("fetched", F.col("fetched").cast("date")), url_filters.intervals(entries.withColumn("day", F.col("day").cast("date"))))
    assert {(r.u_, r.f_, r.blocked, r.lists) for r in found.collect()} == {(1, 2, True, "spam"), (3, 4, False, "")}


def test_item_keys_of_other_types(spark):
    docs = spark.createDataFrame([(1, "one two three four five six seven eight"), (2, "none of them")], "doc_id long, text string")
    for kind in ("smallint", "double", "date", "decimal(9,2)", "string"):
        value = "DATE '2024-01-01'" if kind == "date" else "7"
        items = spark.sql(f"SELECT CAST({value} AS {kind}) AS item_id, 'one two three four five six seven eight' AS text")
        found = {r.doc_id: r.items for r in decontamination.mark(docs, items).collect()}
        assert len(found[1]) == 1 and found[2] == [] and found[1] == [items.first().item_id]


def test_a_key_that_repeats_sends_one_text(spark):
    docs = spark.range(300).selectExpr("IF(id < 200, 1, id) AS doc_id", "concat('text number ', id, ' of some words') AS text")
    labels = spark.range(400).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    model = quality_classifier.fit(docs, labels)
    assert 0 < model.share < 1 and len(model.good) + len(model.bad) > 0
