"""Pasted text and plain source files as cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom import fixed


def split_cells(texts: DataFrame, keys: list[str], column: str = "text") -> DataFrame:
    """Text -> cells at the separator lines, trimmed, blanks dropped."""
    parts = F.transform(F.split(column, fixed.CELL_SEPARATOR, -1), lambda c: F.regexp_replace(c, r"^\s+|\s+$", ""))
    kept = F.filter(parts, lambda c: c != "")
    return texts.select(*keys, F.posexplode(kept).alias("cell_index", "source"))


def read_source_files(spark, path: str) -> DataFrame:
    """Each ``.py``, ``.sql`` or ``.txt`` file is one cell; blank files give none."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("source"))
    return (
        files.filter(F.rlike("file", F.lit(r"(?i)\.(py|sql|txt)$")))
        .select("file", F.lit(0).alias("cell_index"), F.regexp_replace("source", r"^\s+|\s+$", "").alias("source"))
        .filter("source <> ''")
    )
