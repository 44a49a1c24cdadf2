from pyspark.sql import functions as F

from stratafolio.llm import language_id, quality_classifier


def test_language_sample_is_shared_among_labels(spark):
    rows = [(k, f"text {k}", "en") for k in range(4000)] + [(k, f"texte {k}", "fr") for k in range(4000, 4030)] + [(9999, "une", "es")] + [(1, "text 1", "en")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = language_id.sample_of(docs, F.col("lang"), 90)
    by = {k: [t for t, label in got if label == k] for k in ("en", "fr", "es")}
    assert {k: len(v) for k, v in by.items()} == {"en": 30, "fr": 30, "es": 1} and len(set(by["en"])) == 30
    assert got == language_id.sample_of(docs.repartition(7), F.col("lang"), 90)
    assert language_id.sample_of(docs.limit(0), F.col("lang"), 90) == []
    many = spark.createDataFrame([(k, f"t{k}", f"l{k}") for k in range(40)], "doc_id long, text string, lang string")
    assert {label for _, label in language_id.sample_of(many, F.col("lang"), 10)} == {f"l{k}" for k in range(40)}


def test_quality_model_with_repeated_ids(spark):
    docs = spark.createDataFrame([(k % 30, "the word " * (k % 7 + 1)) for k in range(300)], "doc_id long, text string")
    labels = spark.createDataFrame([(k % 30, k % 2) for k in range(90)], "doc_id long, quality int")
    once = quality_classifier.trained(docs.dropDuplicates(), labels)
    again = quality_classifier.trained(docs.unionByName(docs), labels.unionByName(labels))
    assert [t.tolist() for t in once.tables] == [t.tolist() for t in again.tables]


def test_labels_of_repeated_rows_are_learned(spark):
    """Rows that repeat share one hash: what counts is how many different ones a label has."""
    english = spark.range(600).select(F.col("id").alias("doc_id"), F.format_string("the text number %d", "id").alias("text"), F.lit("en").alias("lang"))
    french = spark.range(900).select((F.col("id") % 3 + 5000).alias("doc_id"), F.format_string("le texte %d", F.col("id") % 3).alias("text"), F.lit("fr").alias("lang"))
    got = language_id.sample_of(english.unionByName(french), F.col("lang"), 200)
    assert sorted(t for t, label in got if label == "fr") == ["le texte 0", "le texte 1", "le texte 2"]
    assert sum(label == "en" for _, label in got) == 100
