"""Pipeline definitions as activities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_SIDE = (
    "struct<datasetSettings:struct<"
    "typeProperties:struct<table:string,location:struct<fileName:string,folderPath:string>>,"
    "linkedService:struct<name:string,properties:struct<typeProperties:struct<workspaceId:string,artifactId:string>>>>>"
)
_COLUMN = "struct<name:string,path:string>"
PROPERTIES = (
    "struct<notebookId:string,notebook:struct<id:string>,pipelineId:string,pipeline:struct<referenceName:string>,"
    f"workspaceId:string,source:{_SIDE},sink:{_SIDE},translator:struct<mappings:array<struct<source:{_COLUMN},sink:{_COLUMN}>>>>"
)
_ACTIVITY = (
    f"struct<name:string,type:string,dependsOn:array<string>,typeProperties:{PROPERTIES},"
    "inputs:array<struct<referenceName:string>>,outputs:array<struct<referenceName:string>>>"
)


def read_definitions(parts: DataFrame) -> DataFrame:
    """Base64 definition parts -> one row per named activity.

    ``parts``: workspace_id, pipeline_id, path, payload. Activities sit under
    ``properties`` or, where there are none, at the top. What cannot be read
    gives no rows. ``depends_on`` takes objects and bare names.
    """
    text = F.make_valid_utf8(F.try_to_binary("payload", F.lit("base64")).cast("string"))  # a bad byte becomes a replacement character
    document = F.from_json("_text", f"properties struct<activities:array<{_ACTIVITY}>>, activities array<{_ACTIVITY}>")
    nested = F.get_json_object("_text", "$.properties")
    has_properties = ~F.coalesce(F.rlike(nested, F.lit(r"^\{\s*\}$")), F.lit(True))  # named once: each mention reads the whole text
    activities = F.when(has_properties, F.col("_doc.properties.activities")).otherwise(F.col("_doc.activities"))
    depends = F.transform("a.dependsOn", lambda d: F.when(F.ltrim(d).startswith("{"), F.get_json_object(d, "$.activity")).otherwise(d))
    return (
        parts.filter(F.lower("path").endswith("pipeline-content.json"))
        .select("workspace_id", "pipeline_id", text.alias("_text"))
        .withColumn("_doc", document)
        .select("workspace_id", "pipeline_id", F.posexplode(activities).alias("seq", "a"))
        .filter("a.name IS NOT NULL AND a.name <> ''")
        .select(
            "workspace_id", "pipeline_id", "seq", "a.name",
            F.coalesce(F.nullif("a.type", F.lit("")), F.lit("Unknown")).alias("type"),
            F.filter(F.coalesce(depends, F.array().cast("array<string>")), lambda d: d.isNotNull() & (d != "")).alias("depends_on"),
            F.coalesce("a.typeProperties.notebookId", "a.typeProperties.notebook.id").alias("notebook_id"),
            F.coalesce("a.typeProperties.pipelineId", "a.typeProperties.pipeline.referenceName").alias("child_pipeline_id"),
            F.col("a.typeProperties.workspaceId").alias("child_workspace_id"),
            F.col("a.typeProperties").alias("properties"), "a.inputs", "a.outputs",
        )
    )


def activity_deps(activity: DataFrame) -> DataFrame:
    """One row per dependency of each activity."""
    return activity.select("workspace_id", "pipeline_id", "name", F.explode("depends_on").alias("depends_on"))
