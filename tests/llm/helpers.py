"""Small tables with the awkward cases every operator must take."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, lang="en"):
    """Documents 0.. from texts; None stays null."""
    return spark.createDataFrame([(i, t, lang, f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)], SCHEMA)


def awkward(spark):
    """Nulls in every column, empty and blank texts, a very long text, ties, repeated rows, an extra column whose name clashes with internals."""
    rows = [
        (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 100),
        (1, "the quick brown fox jumps over the lazy dog " * 3, "en", "a", 100),
        (2, None, "en", "b", None),
        (3, "", None, None, 0),
        (4, " \n\t ", "xx", "c", 4),
        (None, "a row without an id, mail me@example.com", "en", None, 40),
        (5, "word " * 60_000, "de", "a", 300_000),
        (6, "the quick brown fox jumps over the lazy dog " * 3, None, "z", 100),
        (7, "x" * 100_000, "fr", "a", 100_000),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return frame.withColumn("shard", F.lit(1)).withColumn("length", F.lit("x")).withColumn("rank", F.lit(2.0))


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
