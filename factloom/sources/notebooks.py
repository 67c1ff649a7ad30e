"""Notebook files as cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PYTHON = ["", "python", "pyspark"]
_SQL = ["sql", "spark-sql", "sparksql"]


def notebook_files(spark, path: str) -> DataFrame:
    """``file, content`` of every notebook under ``path``, one row per file."""
    return (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.ipynb").text(path, wholetext=True)
        .select(F.input_file_name().alias("file"), F.col("value").alias("content"))
    )


def _cells(content: Column) -> Column:
    """The cells array, null when the text is no JSON or has none."""
    return F.try_variant_get(F.try_parse_json(content), "$.cells", "array<variant>")


def _field(cell: Column, path: str) -> Column:
    return F.try_variant_get(cell, path, "string")


def _is_code(cell: Column) -> Column:
    """A cell without a type counts as code."""
    kind = _field(cell, "$.cell_type")
    return kind.isNull() | (kind == "code")


def _source(cell: Column) -> Column:
    """A text, or an array whose texts are joined without a separator."""
    lines = F.filter(F.try_variant_get(cell, "$.source", "array<variant>"), lambda v: F.schema_of_variant(v) == "STRING")
    is_text = F.schema_of_variant(F.try_variant_get(cell, "$.source", "variant")) == "STRING"
    return F.when(is_text, _field(cell, "$.source")).otherwise(
        F.coalesce(F.array_join(F.transform(lines, lambda v: F.try_variant_get(v, "$", "string")), ""), F.lit("")))


def _code_cells(files: DataFrame) -> DataFrame:
    cells = files.select("file", F.posexplode(_cells(F.col("content"))).alias("cell_index", "c"))
    return cells.filter(_is_code(F.col("c"))).select(
        "file", "cell_index", F.lower(F.coalesce(_field(F.col("c"), "$.metadata.language"), F.lit(""))).alias("language"),
        _source(F.col("c")).alias("source"))


def parse_notebooks(files: DataFrame) -> DataFrame:
    """``file, cell_index, source`` of Python and SQL code cells, trimmed, blanks dropped.

    The language is the cell's own or that of its leading ``%%`` line, which is
    cut off for Python. SQL cells keep (or get) their magic line, so that a scan
    still knows them for SQL.
    """
    magic = F.lower(F.trim(F.regexp_extract("source", r"^\s*%%([^\n]*)", 1)))
    language = F.when(F.col("language") != "", F.col("language")).otherwise(magic)
    has_magic = F.rlike("source", F.lit(r"^\s*%%"))
    body = F.regexp_replace("source", r"^\s*%%[^\n]*\n?", "")
    is_sql = F.col("_lang").isin(_SQL)
    text = (
        F.when(is_sql & ~has_magic, F.concat(F.lit("%%sql\n"), F.col("source")))
        .when(~is_sql & has_magic, body)
        .otherwise(F.col("source"))
    )
    return (
        _code_cells(files).withColumn("_lang", language)
        .filter(F.col("_lang").isin(_PYTHON + _SQL))
        .select("file", "cell_index", F.regexp_replace(text, r"^\s+|\s+$", "").alias("source"))
        .filter("source <> ''")
    )


def read_notebooks(spark, path: str) -> DataFrame:
    return parse_notebooks(notebook_files(spark, path))


def notebook_errors(files: DataFrame) -> DataFrame:
    """One row per file that is no notebook, or one without code."""
    document, cells = F.try_parse_json("content"), _cells(F.col("content"))
    with_code = F.filter(cells, lambda c: _is_code(c) & F.rlike(_source(c), F.lit(r"\S")))
    error = (
        F.when(document.isNull(), "not valid JSON")
        .when(cells.isNull(), "no cells array, so not a notebook")
        .when(F.coalesce(F.size(with_code), F.lit(0)) <= 0, "no code cells to analyse")
    )
    return files.select("file", error.alias("error")).filter("error IS NOT NULL")
