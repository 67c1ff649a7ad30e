import pytest

#: a table whose other columns have names that operators use themselves
EXTRA = "n_words bigint, component string, size double, bucket string, place string, kind string"
EXTRA_VALUES = (None, "x", 1.5, "", None, "k")


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text[, lang[, source]]), with clashing columns and spread over partitions."""
    def build(rows, partitions=3):
        full = [(*r, *(("en", "src0")[len(r) - 2:]), len(r[1] or ""), *EXTRA_VALUES) for r in rows]
        schema = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"
        return spark.createDataFrame(full, schema).repartition(partitions)
    return build
