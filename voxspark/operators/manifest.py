"""Label manifests: JSON documents that describe the labels of volume files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.functions.text import file_name


def _typed(value: str, path: str, kind: str) -> Column:
    """A field of a VARIANT column if it has the wanted JSON type, else NULL."""
    cast = {"string": "string", "number": "double"}[kind]
    types = {"string": "= 'STRING'", "number": "rlike '^(BIGINT|DOUBLE|DECIMAL|FLOAT)'"}[kind]
    variant = f"try_variant_get({value}, '{path}', 'variant')"
    return F.expr(f"CASE WHEN schema_of_variant({variant}) {types} THEN try_variant_get({value}, '{path}', '{cast}') END")


def _string_map(path: str) -> Column:
    """String entries of a JSON object as a map, NULL if there are none."""
    variant = f"try_variant_get(meta, '{path}', 'map<string, variant>')"
    kept = F.expr(f"map_filter({variant}, (k, v) -> schema_of_variant(v) = 'STRING')")
    texts = F.transform_values(kept, lambda k, v: F.try_variant_get(v, "$", "string"))
    return F.when(F.size(texts) > 0, texts)


def manifest_entries(manifests: DataFrame) -> DataFrame:
    """One row per manifest and described file.

    ``manifests`` has manifest_id and text. Malformed documents give no rows. If several entries share a base file
    name, the last in the document wins. Map values and scalars of the wrong JSON type are dropped.
    """
    parsed = manifests.select("manifest_id", F.try_parse_json("text").alias("doc"))
    files = parsed.select(
        "manifest_id",
        F.posexplode(F.map_entries(F.expr("try_variant_get(doc, '$.files', 'map<string, variant>')"))).alias("pos", "e"),
    ).select("manifest_id", "pos", file_name("e.key").alias("file"), F.col("e.value").alias("meta"))
    described = files.select(
        "manifest_id",
        "file",
        "pos",
        _typed("meta", "$.kind", "string").alias("kind"),
        _string_map("$.labels").alias("labels"),
        _string_map("$.dynamic_labels").alias("dynamic_labels"),
        _typed("meta", "$.value_description", "string").alias("value_description"),
        _typed("meta", "$.isovalue", "number").alias("isovalue"),
    )
    fields = ("kind", "labels", "dynamic_labels", "value_description", "isovalue")
    return (
        described.groupBy("manifest_id", "file")
        .agg(F.max_by(F.struct(*fields), "pos").alias("m"))
        .select("manifest_id", "file", *[F.col(f"m.{f}").alias(f) for f in fields])
    )


def label_rows(described: DataFrame, volume_id: str = "file") -> DataFrame:
    """Label maps as rows: volume_id, code, text."""
    return described.select(F.col(volume_id).alias("volume_id"), F.explode("labels").alias("code", "text"))
