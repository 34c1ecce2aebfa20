"""Label volumes: classification, colours, texts, slices and histograms."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from voxspark import constants as C
from voxspark.functions import colors, labels, text
from voxspark.operators import volumes as vol
from voxspark.operators.manifest import label_rows, manifest_entries

KIND_VALUES = ", ".join(f"('{k}')" for k in C.VOLUME_KINDS)

# Cells under every kind; values are labels 0..8, or hundredths from -0.20 to 0.20 for the scalar field.
KINDED = f"""kinded AS (
  SELECT volume_id, i, j, k, kind,
         CASE WHEN kind = 'scalarField' THEN scalar_hundredths / 100.0::DOUBLE ELSE label::DOUBLE END AS value, label
  FROM cells, (VALUES {KIND_VALUES}) AS kinds(kind))"""

CATEGORY = """CASE kind WHEN 'scalarField' THEN NULL WHEN 'linfinityDistanceCases' THEN 'linfCase'
  WHEN 'boundaryMask' THEN CASE WHEN label = 0 THEN 'unknown' ELSE 'surface' END
  WHEN 'componentLabels' THEN CASE WHEN label = 0 THEN 'unknown' ELSE 'components' END
  WHEN 'finalCclComponents' THEN CASE label WHEN 0 THEN 'unknown' WHEN 1 THEN 'outside' WHEN 2 THEN 'inside'
    WHEN 3 THEN 'surface' ELSE 'components' END
  WHEN 'finalCclCases' THEN CASE label WHEN 1 THEN 'outside' WHEN 2 THEN 'inside' WHEN 3 THEN 'surface'
    WHEN 4 THEN 'insideOnly' WHEN 5 THEN 'outsideOnly' WHEN 6 THEN 'bothSides' WHEN 7 THEN 'isolated' ELSE 'unknown' END
  WHEN 'surfaceBoundaryClassification' THEN CASE label WHEN 1 THEN 'outside' WHEN 2 THEN 'inside'
    WHEN 3 THEN 'surfaceBoundaryInside' WHEN 4 THEN 'surfaceBoundaryOutside' ELSE 'unknown' END
  ELSE CASE label WHEN 1 THEN 'outside' WHEN 2 THEN 'inside' WHEN 3 THEN 'band' WHEN 4 THEN 'surface' ELSE 'unknown' END
  END"""
NAMES = "(VALUES " + ", ".join(f"({n}, '{k}', '{t}', '{c}')" for n, (k, t, c) in enumerate(C.CATEGORIES)) + ")"


def kinded(spark, sf):
    value = F.when(F.col("kind") == "scalarField", F.col("scalar_hundredths") / 100.0).otherwise(F.col("label"))
    kinds = F.explode(F.array(*[F.lit(k) for k in C.VOLUME_KINDS]))
    return d.cells(spark, sf).withColumn("kind", kinds).withColumn("value", value.cast("double"))


def volumes(cells, kind):
    return cells.select("volume_id").distinct().select(
        "volume_id", F.lit(8).alias("nx"), F.lit(8).alias("ny"), F.lit(16).alias("nz"), F.lit(kind).alias("visualization")
    )


def case_rows(spark, sf):
    rows = d.spark_sql(spark, sf, d.MANIFEST)
    return rows.withColumn("code", F.col("code").cast("string"))


@query(
    "x1_label_categories",
    f"WITH {KINDED} SELECT volume_id, i, j, k, kind, {CATEGORY} AS category FROM kinded",
    ("cells",),
)
def x1(spark, sf):
    return kinded(spark, sf).select("volume_id", "i", "j", "k", "kind", labels.classify_label("value", "kind").alias("category"))


@query(
    "x2_category_names",
    f"""WITH {KINDED}, names AS (SELECT * FROM {NAMES} AS n(ord, category, label_text, color)),
        classified AS (SELECT DISTINCT kind, {CATEGORY} AS category FROM kinded)
        SELECT c.kind, c.category, n.label_text AS label, n.color, n.ord FROM classified AS c
        JOIN names AS n ON n.category = c.category""",
    ("cells",),
)
def x2(spark, sf):
    found = kinded(spark, sf).select("kind", labels.classify_label("value", "kind").alias("category")).distinct()
    return found.join(F.broadcast(labels.categories(spark)), "category").select("kind", "category", "label", "color", "ord")


def _ramp(positive, negative):
    level = "sqrt(abs(value) / 0.1::DOUBLE)"
    up, down = f"1 - {level} + {positive}::DOUBLE * {level}", f"1 - {level} + {negative}::DOUBLE * {level}"
    chosen = f"CASE WHEN value >= 0 THEN {up} ELSE {down} END"
    return f"CASE WHEN abs(value) > 0.1 THEN 0 ELSE CAST(floor(LEAST(GREATEST({chosen}, 0), 1) * 255 + 0.5) AS INT) END"


def _hue(shift):
    """Channel of the pseudo-random colour of whole label ``seed``."""
    h = f"(((seed * 137.508::DOUBLE) % 360) / 360 + {shift}::DOUBLE)"
    t = f"(CASE WHEN {h} < 0 THEN {h} + 1 WHEN {h} > 1 THEN {h} - 1 ELSE {h} END)"
    high = C.COMPONENT_LIGHTNESS + C.COMPONENT_SATURATION - C.COMPONENT_LIGHTNESS * C.COMPONENT_SATURATION
    low = 2 * C.COMPONENT_LIGHTNESS - high
    gap = high - low
    level = (
        f"CASE WHEN {t} < 1 / 6.0::DOUBLE THEN {low!r}::DOUBLE + {gap!r}::DOUBLE * 6 * {t} "
        f"WHEN {t} < 0.5 THEN {high!r}::DOUBLE WHEN {t} < 2 / 3.0::DOUBLE "
        f"THEN {low!r}::DOUBLE + {gap!r}::DOUBLE * (2 / 3.0::DOUBLE - {t}) * 6 ELSE {low!r}::DOUBLE END"
    )
    return f"CAST(floor(({level}) * 255 + 0.5) AS INT)"


_HUES = {"r": _hue(repr(1 / 3)), "g": _hue("0.0"), "b": _hue(repr(-1 / 3))}


@query(
    "x5_scalar_colors",
    f"""SELECT volume_id, i, j, k, {_ramp(0.9, 0.05)} AS r, {_ramp(0.05, 0.2)} AS g, {_ramp(0.05, 0.95)} AS b
        FROM (SELECT *, scalar_hundredths / 100.0::DOUBLE AS value FROM cells) AS c""",
    ("cells",),
)
def x5(spark, sf):
    colored = d.cells(spark, sf).withColumn("c", colors.scalar_color(F.col("scalar_hundredths") / 100.0))
    return colored.select("volume_id", "i", "j", "k", *colors.channels("c"))


@query(
    "x7_component_colors",
    f"SELECT o_orderkey, {_HUES['r']} AS r, {_HUES['g']} AS g, {_HUES['b']} AS b "
    "FROM (SELECT o_orderkey, abs(o_orderkey - 500) AS seed FROM orders) AS o",
)
def x7(spark, sf):
    orders = d.spark_table(spark, sf, "orders")
    return orders.select("o_orderkey", colors.component_color(F.col("o_orderkey") - 500).alias("c")).select(
        "o_orderkey", *colors.channels("c")
    )


@query(
    "x6_label_colors",
    f"""WITH {KINDED}, names AS (SELECT * FROM {NAMES} AS n(ord, category, label_text, color)),
        seeded AS (
          SELECT *, {CATEGORY} AS category,
            CASE WHEN kind = 'finalCclComponents' THEN GREATEST(0, label - 3) ELSE label END AS seed
          FROM kinded WHERE kind <> 'scalarField')
        SELECT s.volume_id, s.i, s.j, s.k, s.kind, """
    + ", ".join(
        f"CASE WHEN s.category IN ('components', 'linfCase') THEN {_HUES[c]} "
        f"ELSE CAST(('0x' || substr(n.color, {p}, 2)) AS INT) END AS {c}"
        for c, p in (("r", 2), ("g", 4), ("b", 6))
    )
    + " FROM seeded AS s LEFT JOIN names AS n ON n.category = s.category",
    ("cells",),
)
def x6(spark, sf):
    cells = kinded(spark, sf).where("kind <> 'scalarField'")
    return cells.withColumn("c", colors.label_color("value", "kind")).select(
        "volume_id", "i", "j", "k", "kind", *colors.channels("c")
    )


@query(
    "x12_scalar_sides",
    """SELECT volume_id, i, j, k, CASE WHEN abs(scalar_hundredths / 100.0::DOUBLE) > 0.1 THEN 'far field'
       WHEN scalar_hundredths >= 0 THEN 'positive / outside' ELSE 'negative / inside' END AS side FROM cells""",
    ("cells",),
)
def x12(spark, sf):
    return d.cells(spark, sf).select("volume_id", "i", "j", "k", labels.scalar_side(F.col("scalar_hundredths") / 100.0).alias("side"))


@query(
    "x13_label_texts",
    f"""WITH {KINDED}, names AS (SELECT * FROM {NAMES} AS n(ord, category, label_text, color)),
        classified AS (SELECT *, {CATEGORY} AS category FROM kinded WHERE kind <> 'scalarField')
        SELECT c.volume_id, c.i, c.j, c.k, c.kind,
          CASE WHEN c.kind = 'finalCclComponents' AND c.label > 3 THEN 'component ' || (c.label - 3)
               WHEN c.kind = 'finalCclCases' THEN c.label || ' ' || n.label_text
               WHEN c.kind = 'linfinityDistanceCases' THEN 'case ' || c.label ELSE CAST(c.label AS VARCHAR) END AS text
        FROM classified AS c LEFT JOIN names AS n ON n.category = c.category""",
    ("cells",),
)
def x13(spark, sf):
    cells = kinded(spark, sf).where("kind <> 'scalarField'")
    named = labels.inspector_label("value", "kind", F.lit(None).cast("string"))
    return cells.select("volume_id", "i", "j", "k", "kind", named.alias("text"))


@query(
    "x14_short_phrases",
    r"""WITH trimmed AS (
         SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS t FROM documents),
       heads AS (SELECT *, regexp_replace(split_part(t, ':', 1), '\s+$', '') AS head FROM trimmed)
       SELECT doc_id, CASE WHEN t = '' THEN 'none' WHEN head <> '' THEN head WHEN length(t) <= 28 THEN t
         ELSE regexp_replace(substr(t, 1, 25), '\s+$', '') || '...' END AS phrase FROM heads""",
)
def x14(spark, sf):
    documents = d.spark_table(spark, sf, "documents")
    return documents.select("doc_id", labels.short_phrase("text", F.lit("none")).alias("phrase"))


@query(
    "x15_byte_texts",
    """WITH sizes AS (SELECT o_orderkey, o_orderkey * o_orderkey * 37 - 40 AS n FROM orders),
       scaled AS (SELECT *, CASE WHEN n < 1048576 THEN 1024 WHEN n < 1073741824 THEN 1048576 ELSE 1073741824 END AS u,
                  CASE WHEN n < 1048576 THEN ' KB' WHEN n < 1073741824 THEN ' MB' ELSE ' GB' END AS unit FROM sizes),
       tenths AS (SELECT *, (n * 10 + u // 2) // u AS t FROM scaled)
       SELECT o_orderkey, CASE WHEN n < 0 THEN '' WHEN n < 1024 THEN n || ' B' ELSE (t // 10) || '.' || (t % 10) || unit END
         AS size_text FROM tenths""",
)
def x15(spark, sf):
    orders = d.spark_table(spark, sf, "orders")
    size = F.col("o_orderkey") * F.col("o_orderkey") * 37 - 40
    return orders.select("o_orderkey", text.bytes_text(size).alias("size_text"))


@query(
    "x16_age_texts",
    """WITH ages AS (SELECT o_orderkey, (o_orderkey - 10) * 123457 AS ms FROM orders)
       SELECT o_orderkey, CASE WHEN ms <= 0 THEN '0m'
         WHEN ms < 3600000 THEN GREATEST(1, CAST(floor(ms / 60000.0::DOUBLE + 0.5) AS BIGINT)) || 'm'
         WHEN ms < 86400000 THEN GREATEST(1, CAST(floor(ms / 3600000.0::DOUBLE + 0.5) AS BIGINT)) || 'h'
         ELSE GREATEST(1, CAST(floor(ms / 86400000.0::DOUBLE + 0.5) AS BIGINT)) || 'd' END AS age FROM ages""",
)
def x16(spark, sf):
    orders = d.spark_table(spark, sf, "orders")
    return orders.select("o_orderkey", text.age_text((F.col("o_orderkey") - 10) * 123457).alias("age"))


@query(
    "x17_path_parts",
    r"""SELECT page_id, CASE WHEN regexp_extract(url, '([^/]+)/*$', 1) = '' THEN 'remote'
          ELSE regexp_extract(url, '([^/]+)/*$', 1) END AS base,
        split_part(url, '/', -1) AS file,
        CASE WHEN regexp_extract(url, '^(.+)/[^/]*$', 1) = '' THEN '/' ELSE regexp_extract(url, '^(.+)/[^/]*$', 1) END AS dir,
        split_part(url, ':', 1) || ':' || regexp_extract(url, '([^/]+)/*$', 1) AS label FROM pages""",
)
def x17(spark, sf):
    pages = d.spark_table(spark, sf, "pages")
    return pages.select(
        "page_id",
        text.base_name("url").alias("base"),
        text.file_name("url").alias("file"),
        text.directory_name("url").alias("dir"),
        text.folder_label("url").alias("label"),
    )


@query(
    "x18_safe_names",
    r"""SELECT page_id, CASE WHEN regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]+', '_', 'g') = ''
        THEN 'input.vxz' ELSE regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '[^A-Za-z0-9._-]+', '_', 'g') END AS name
        FROM pages""",
)
def x18(spark, sf):
    return d.spark_table(spark, sf, "pages").select("page_id", text.safe_file_name("url").alias("name"))


@query(
    "x19_resolution_arguments",
    """WITH given AS (
         SELECT event_id, CASE event_id % 7 WHEN 0 THEN ' Auto ' WHEN 1 THEN '' WHEN 2 THEN CAST(user_id AS VARCHAR)
           WHEN 3 THEN '-' || user_id WHEN 4 THEN event_type WHEN 5 THEN user_id || '.0' ELSE user_id || '.5' END AS text,
           event_id % 7 AS shape, user_id FROM events)
       SELECT event_id, CASE WHEN shape IN (2, 5) AND user_id > 0 THEN CAST(user_id AS INT) END AS resolution,
         shape IN (0, 1) OR (shape IN (2, 5) AND user_id > 0) AS valid FROM given""",
)
def x19(spark, sf):
    given = d.spark_table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 7 WHEN 0 THEN ' Auto ' WHEN 1 THEN '' WHEN 2 THEN CAST(user_id AS STRING)
           WHEN 3 THEN '-' || user_id WHEN 4 THEN event_type WHEN 5 THEN user_id || '.0' ELSE user_id || '.5' END AS t""",
    )
    parsed = given.select("event_id", text.parse_resolution("t").alias("p"))
    return parsed.select("event_id", F.col("p.value").alias("resolution"), "p.valid")


@query(
    "x21_clamped_fractions",
    "SELECT event_id, LEAST(GREATEST(value / 50 - 0.5::DOUBLE, 0), 1) AS fraction FROM events",
)
def x21(spark, sf):
    events = d.spark_table(spark, sf, "events")
    return events.select("event_id", text.clamp_fraction(F.col("value") / 50 - 0.5).alias("fraction"))


@query(
    "f11_request_checks",
    """WITH asked AS (
         SELECT event_id, CASE event_id % 3 WHEN 0 THEN sha256(CAST(event_id AS VARCHAR)) WHEN 1 THEN upper(sha256('a'))
           ELSE event_type END AS id, CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'z' WHEN 2 THEN 'w' ELSE 'y' END AS axis,
           user_id - 20 AS idx, (event_id - 100) * 1000000 AS size FROM events)
       SELECT event_id, regexp_full_match(id, '[a-f0-9]{64}') AS good_id,
         regexp_full_match(id, '[a-f0-9]{64}') AND axis <> 'w' AND idx >= 0 AS good_slice,
         size BETWEEN 1 AND 2147483648 AS good_size FROM asked""",
)
def f11(spark, sf):
    asked = d.spark_table(spark, sf, "events").selectExpr(
        "event_id",
        """CASE event_id % 3 WHEN 0 THEN sha2(CAST(event_id AS STRING), 256) WHEN 1 THEN upper(sha2('a', 256))
           ELSE event_type END AS id""",
        "CASE event_id % 4 WHEN 0 THEN 'x' WHEN 1 THEN 'z' WHEN 2 THEN 'w' ELSE 'y' END AS axis",
        "user_id - 20 AS idx",
        "(event_id - 100) * 1000000 AS size",
    )
    return asked.select(
        "event_id",
        text.valid_store_id("id").alias("good_id"),
        text.valid_slice_request("id", "axis", "idx").alias("good_slice"),
        text.valid_input_size("size").alias("good_size"),
    )


@query(
    "f2_volume_slice",
    f"""WITH pixels AS (
          SELECT volume_id, i AS px, 15 - k AS py, label, 'finalCclCases' AS kind FROM cells WHERE j = 3)
        SELECT volume_id, px, py, label::DOUBLE AS value, {CATEGORY} AS category FROM pixels""",
    ("cells",),
)
def f2(spark, sf):
    cells = d.cells(spark, sf).withColumn("value", F.col("label").cast("double"))
    pixels = vol.volume_pixels(vol.volume_slice(cells, "y", 3), volumes(cells, "finalCclCases"), "y")
    return pixels.select("volume_id", "px", "py", "value", "category")


@query(
    "a4_category_histogram",
    f"""WITH names AS (SELECT * FROM {NAMES} AS n(ord, category, label_text, color)),
        hits AS (SELECT volume_id, label, 'pipelineLabels' AS kind FROM cells WHERE k = 5),
        counted AS (SELECT volume_id, {CATEGORY} AS category, COUNT(*) AS cells FROM hits GROUP BY 1, 2)
        SELECT c.volume_id, c.category, n.ord, n.label_text AS label, n.color, c.cells FROM counted AS c
        JOIN names AS n ON n.category = c.category""",
    ("cells",),
)
def a4(spark, sf):
    cells = d.cells(spark, sf).withColumn("value", F.col("label").cast("double"))
    return vol.category_histogram(vol.volume_slice(cells, "z", 5), volumes(cells, "pipelineLabels"))


@query(
    "o5_legend_order",
    f"""WITH names AS (SELECT * FROM {NAMES} AS n(ord, category, label_text, color)),
        hits AS (SELECT volume_id, label, 'surfaceBoundaryClassification' AS kind FROM cells),
        counted AS (SELECT {CATEGORY} AS category, COUNT(*) AS cells FROM hits GROUP BY 1)
        SELECT CAST(ROW_NUMBER() OVER (ORDER BY n.ord) AS INT) AS place, n.label_text AS label, c.cells
        FROM counted AS c JOIN names AS n ON n.category = c.category""",
    ("cells",),
)
def o5(spark, sf):
    cells = d.cells(spark, sf).withColumn("value", F.col("label").cast("double"))
    counted = vol.category_histogram(cells, volumes(cells, "surfaceBoundaryClassification"))
    # One row per category, thirteen at most, so a single sorted window is small by construction.
    legend = counted.groupBy("ord", "label").agg(F.sum("cells").cast("long").alias("cells"))
    return legend.select(F.row_number().over(Window.orderBy("ord")).alias("place"), "label", "cells")


@query(
    "a5_label_histogram",
    f"""WITH counted AS (SELECT volume_id, label, COUNT(*) AS cells FROM cells WHERE i = 2 GROUP BY 1, 2)
        SELECT c.volume_id, CAST(c.label AS BIGINT) AS label, c.cells, {_HUES['r']} AS r, {_HUES['g']} AS g, {_HUES['b']} AS b,
          COALESCE(m.text, 'L-infinity case ' || c.label) AS text,
          COALESCE(split_part(m.text, ':', 1), 'L-infinity case ' || c.label) AS phrase
        FROM (SELECT *, label AS seed FROM counted) AS c
        LEFT JOIN manifest AS m ON m.volume_id = c.volume_id AND m.code = c.label""",
    ("cells", "manifest"),
)
def a5(spark, sf):
    cells = d.cells(spark, sf).withColumn("value", F.col("label").cast("double"))
    return vol.label_histogram(vol.volume_slice(cells, "x", 2), case_rows(spark, sf))


@query(
    "j7_label_texts",
    """SELECT c.volume_id, c.i, c.j, c.k, COALESCE(m.text, 'label ' || c.label) AS text FROM cells AS c
       LEFT JOIN manifest AS m ON m.volume_id = c.volume_id AND m.code = c.label""",
    ("cells", "manifest"),
)
def j7(spark, sf):
    cells = d.cells(spark, sf).withColumn("value", F.col("label") + 0.25)
    fallback = F.concat(F.lit("label "), F.col("label").cast("string"))
    return vol.label_texts(cells, case_rows(spark, sf), fallback).select("volume_id", "i", "j", "k", "text")


@query(
    "j6_inspect_cells",
    """WITH asked AS (
         SELECT event_id, CASE WHEN idx < 8 THEN 'O' ELSE 'F' END || SUBSTRING(model_id, 2) AS volume_id, axis, CAST(idx % 8 AS INT) AS idx, CAST(px % 8 AS INT) AS px,
                CAST(py % 8 AS INT) AS py FROM probes),
       located AS (
         SELECT *, CASE axis WHEN 'x' THEN idx ELSE px END AS i, CASE axis WHEN 'y' THEN idx ELSE 7 - py END AS j,
                CASE axis WHEN 'x' THEN px WHEN 'y' THEN 15 - py ELSE idx END AS k FROM asked)
       SELECT p.event_id, p.volume_id, p.axis, p.idx, p.px, p.py, p.i, p.j, p.k, c.label::DOUBLE AS value,
         ROUND(-1 + p.k * 2 / 15.0::DOUBLE, 6) AS world_z,
         CASE WHEN c.label IS NULL THEN NULL WHEN m.text IS NULL THEN 'case ' || c.label
           ELSE split_part(m.text, ':', 1) END AS label_text,
         CASE WHEN c.label IS NULL THEN '-' ELSE 'L-infinity distance case' END AS category
       FROM located AS p LEFT JOIN cells AS c ON c.volume_id = p.volume_id AND c.i = p.i AND c.j = p.j AND c.k = p.k
       LEFT JOIN manifest AS m ON m.volume_id = p.volume_id AND m.code = c.label""",
    ("cells", "manifest", "probes"),
)
def j6(spark, sf):
    cells = d.cells(spark, sf).withColumn("value", F.col("label").cast("double"))
    probes = d.spark_sql(spark, sf, d.PROBES).select(
        "event_id", F.expr("CASE WHEN idx < 8 THEN 'O' ELSE 'F' END || substring(model_id, 2)").alias("volume_id"), "axis", *[(F.col(c) % 8).cast("int").alias(c) for c in ("idx", "px", "py")]
    )
    report = vol.inspect(probes, cells, volumes(cells, "linfinityDistanceCases"), case_rows(spark, sf))
    return report.select(
        *probes.columns, "i", "j", "k", "value", F.round("world_z", 6).alias("world_z"), "label_text", "category"
    )


@query(
    "s6_manifest_entries",
    """SELECT o_orderkey AS manifest_id, name || '.npy' AS file, 'k' || o_orderkey AS kind,
         CASE name WHEN 'a' THEN 'open ' || o_orderpriority ELSE NULL END AS label_1,
         CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS DOUBLE) END AS isovalue
       FROM orders, (VALUES ('a'), ('b')) AS names(name) WHERE o_orderkey % 7 <> 0""",
)
def s6(spark, sf):
    documents = d.spark_table(spark, sf, "orders").selectExpr(
        "o_orderkey AS manifest_id",
        """CASE WHEN o_orderkey % 7 = 0 THEN '{"files": {broken'
           ELSE '{"files":{"old/a.npy":{"kind":"first"},"x/a.npy":{"kind":"k' || o_orderkey || '","labels":{"1":"open '
             || o_orderpriority || '","2":7},"isovalue":'
             || CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey AS STRING) ELSE '"none"' END
             || '},"b.npy":{"kind":"k' || o_orderkey || '","labels":[1,2],"isovalue":'
             || CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey || '.0' ELSE 'null' END || '}}}' END AS text""",
    )
    entries = manifest_entries(documents)
    return entries.select("manifest_id", "file", "kind", F.try_element_at("labels", F.lit("1")).alias("label_1"), "isovalue")


@query(
    "s6_manifest_labels",
    """SELECT CAST(o_orderkey AS VARCHAR) AS volume_id, CAST(o_orderkey % 5 AS VARCHAR) AS code, o_orderpriority AS text
       FROM orders""",
)
def s6_rows(spark, sf):
    documents = d.spark_table(spark, sf, "orders").selectExpr(
        "o_orderkey AS manifest_id",
        """'{"files":{"' || o_orderkey || '":{"labels":{"' || (o_orderkey % 5) || '":"' || o_orderpriority
           || '","9":null}}}}' AS text""",
    )
    return label_rows(manifest_entries(documents))
