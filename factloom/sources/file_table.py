"""A table of Parquet files that changes by files: a version is a list of files, and a change rewrites those it touches."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from factloom.operators import verbs
from factloom.session import cut_lineage, exists

#: bytes of a file that :meth:`FileTable.compact` aims at
FILE_BYTES = 256 << 20


def _names(rows: DataFrame) -> set[str]:
    """Files that rows come from, as a manifest names them. Paths are told apart first: no pattern runs for every row."""
    return {_name(r[0]) for r in rows.select("_file").distinct().collect()}


def _name(path: str) -> str:
    return "/".join(path.rsplit("/", 2)[1:])


class FileTable:
    """``path``/data holds files, ``path``/manifest a list of them per version; the greatest version is the table.

    A change reads the files that hold a row it concerns, writes their rows anew and publishes the next version: the files
    it did not touch, under their names, and the new ones. A reader keeps the version it began with; a change
    that fails leaves none. Of two changes at once one fails, because its version is there already. Lists of files are read on the
    driver, which holds them for any scan.
    """

    def __init__(self, spark, path: str, schema):
        self.spark, self.path = spark, path
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    # -- versions --

    def _manifests(self) -> DataFrame:
        return self.spark.read.schema("file string, version bigint").parquet(f"{self.path}/manifest")

    def version(self) -> int:
        """0 before anything is written."""
        if not exists(self.spark, f"{self.path}/manifest"):
            return 0
        return self._manifests().agg(F.max("version")).first()[0] or 0

    def files(self, version: int | None = None) -> list[str]:
        version = self.version() if version is None else version
        if not version:
            return []
        return sorted(r.file for r in self._manifests().filter((F.col("version") == version) & (F.col("file") != "")).collect())

    def _publish(self, version: int, files: list[str]) -> int:
        # A version without files has one empty name, so that it is there.
        rows = self.spark.createDataFrame([(f,) for f in files or [""]], "file string").coalesce(1)
        rows.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version}")
        return version

    # -- rows --

    def _scan(self, files: list[str]) -> DataFrame:
        """Rows of some files, with the path of the file and its bytes."""
        if not files:
            return self.spark.createDataFrame([], self.schema).withColumns({"_file": F.lit(""), "_bytes": F.lit(0).cast("bigint")})
        rows = self.spark.read.schema(self.schema).parquet(*(f"{self.path}/data/{f}" for f in files))
        return rows.select(*self.schema.names, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_size").alias("_bytes"))

    def read(self, version: int | None = None) -> DataFrame:
        return self._scan(self.files(version)).select(self.schema.names)

    def _write(self, rows: DataFrame) -> list[str]:
        folder = uuid.uuid4().hex
        rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema)).write.parquet(f"{self.path}/data/{folder}")
        written = self.spark.read.schema(self.schema).parquet(f"{self.path}/data/{folder}")
        return sorted(_names(written.select(F.col("_metadata.file_path").alias("_file"))))

    # -- changes, each of which gives the new version --

    def append(self, rows: DataFrame) -> int:
        version = self.version()
        return self._publish(version + 1, self.files(version) + self._write(rows))

    def _change(self, touches, rewrite) -> int:
        """``touches``: of all rows those concerned; ``rewrite``: the rows of the files that hold any."""
        version = self.version()
        files = self.files(version)
        touched = _names(touches(self._scan(files)))
        rows = rewrite(self._scan(sorted(touched)).select(self.schema.names))
        return self._publish(version + 1, [f for f in files if f not in touched] + self._write(rows))

    def update(self, condition: Column, values: dict[str, Column]) -> int:
        return self._change(lambda rows: rows.filter(condition), lambda rows: verbs.update_rows(rows, condition, values))

    def delete(self, condition: Column) -> int:
        return self._change(lambda rows: rows.filter(condition), lambda rows: verbs.delete_rows(rows, condition))

    def merge(self, source: DataFrame, on: list[str], **clauses) -> int:
        """As :func:`verbs.merge_rows`. A source row that meets nothing in the touched files meets nothing at all."""
        source = cut_lineage(source)
        return self._change(
            lambda rows: rows.join(source.select(*on).distinct(), on, "left_semi"), lambda rows: verbs.merge_rows(rows, source, on, **clauses))

    def compact(self, file_bytes: int = FILE_BYTES) -> int:
        """Files of less than half of ``file_bytes`` become files of about that size; rows stay."""
        version = self.version()
        files = self.files(version)
        small = self._scan(files).select("_file", "_bytes").distinct().filter(F.col("_bytes") * 2 < file_bytes)
        found = {_name(r[0]): r[1] for r in small.collect()}
        if len(found) < 2:
            return version
        rows = self._scan(sorted(found)).select(self.schema.names).repartition(-(-sum(found.values()) // file_bytes))
        return self._publish(version + 1, [f for f in files if f not in found] + self._write(rows))
