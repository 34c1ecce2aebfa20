"""Slices, rasters, legends, inspection, sampling and constraints of voxel grids."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from voxspark.functions.colors import channels, voxel_color
from voxspark.functions.geometry import pack_cell
from voxspark.functions.labels import edge_description, fallback_description, rank_deficient, rank_description
from voxspark.operators import slices
from voxspark.operators.constraints import complete_stores, duplicate_cells, validate_voxels
from voxspark.operators.ordinals import dense_ordinals
from voxspark.operators.summary import case_counts, systematic_sample

R = d.RESOLUTION
INDEX = 7


def models(v):
    return v.select("model_id").distinct().withColumn("resolution", F.lit(R))


@query(
    "f1_voxel_slice",
    f"SELECT model_id, vid, x, y, z, dx, dy, dz, flags, ovoxel_type, qef_rank FROM voxels WHERE z = {INDEX}",
    ("voxels",),
)
def f1(spark, sf):
    rows = slices.voxel_slice(d.voxels(spark, sf), "z", INDEX)
    return rows.select("model_id", "vid", "x", "y", "z", "dx", "dy", "dz", "flags", "ovoxel_type", "qef_rank")


@query(
    "f6_systematic_sample",
    """WITH numbered AS (
         SELECT model_id, vid, ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY vid) - 1 AS ordinal,
                COUNT(*) OVER (PARTITION BY model_id) AS n FROM voxels)
       SELECT model_id, vid, CAST(ordinal AS BIGINT) AS ordinal FROM numbered WHERE ordinal % ((n + 999) // 1000) = 0""",
    ("voxels",),
)
def f6(spark, sf):
    keys = d.voxels(spark, sf).select("model_id", "vid")
    return systematic_sample(dense_ordinals(keys, "vid", "ordinal"), 1000, "ordinal")


_COLORS = """
  CASE mode WHEN 'fallback' THEN CASE ovoxel_type WHEN 0 THEN 37 WHEN 1 THEN 16 WHEN 2 THEN 245 WHEN 3 THEN 225 ELSE 100 END
    WHEN 'rank' THEN CASE qef_rank WHEN 0 THEN 190 WHEN 1 THEN 220 WHEN 2 THEN 245 WHEN 3 THEN 16 ELSE 100 END
    WHEN 'dual' THEN dx
    WHEN 'edges' THEN CASE WHEN flags & 7 = 0 THEN 92 WHEN flags & 1 = 0 THEN 28 WHEN flags & 8 <> 0 THEN 255 ELSE 145 END
    ELSE 22 END AS r,
  CASE mode WHEN 'fallback' THEN CASE ovoxel_type WHEN 0 THEN 99 WHEN 1 THEN 185 WHEN 2 THEN 158 WHEN 3 THEN 29 ELSE 116 END
    WHEN 'rank' THEN CASE qef_rank WHEN 0 THEN 24 WHEN 1 THEN 38 WHEN 2 THEN 158 WHEN 3 THEN 185 ELSE 116 END
    WHEN 'dual' THEN dy
    WHEN 'edges' THEN CASE WHEN flags & 7 = 0 THEN 105 WHEN flags & 2 = 0 THEN 28 WHEN flags & 16 <> 0 THEN 255 ELSE 145 END
    ELSE 150 END AS g,
  CASE mode WHEN 'fallback' THEN CASE ovoxel_type WHEN 0 THEN 235 WHEN 1 THEN 129 WHEN 2 THEN 11 WHEN 3 THEN 72 ELSE 139 END
    WHEN 'rank' THEN CASE qef_rank WHEN 0 THEN 93 WHEN 1 THEN 38 WHEN 2 THEN 11 WHEN 3 THEN 129 ELSE 139 END
    WHEN 'dual' THEN dz
    WHEN 'edges' THEN CASE WHEN flags & 7 = 0 THEN 122 WHEN flags & 4 = 0 THEN 28 WHEN flags & 32 <> 0 THEN 255 ELSE 145 END
    ELSE 200 END AS b"""


@query(
    "x8_voxel_colors",
    f"""SELECT model_id, vid, mode, {_COLORS}
        FROM voxels, (VALUES ('occupancy'), ('edges'), ('dual'), ('fallback'), ('rank')) AS modes(mode)""",
    ("voxels",),
)
def x8(spark, sf):
    modes = F.explode(F.array(*[F.lit(m) for m in ("occupancy", "edges", "dual", "fallback", "rank")]))
    colored = d.voxels(spark, sf).withColumn("mode", modes).withColumn("color", voxel_color("mode"))
    return colored.select("model_id", "vid", "mode", *channels("color"))


@query(
    "x9_rank_texts",
    """SELECT model_id, vid, qef_rank, qef_rank < 3 AS deficient,
       CASE WHEN qef_rank IS NULL THEN 'Unavailable' WHEN qef_rank < 3 THEN CAST(qef_rank AS VARCHAR) || ' · rank deficient'
            ELSE CAST(qef_rank AS VARCHAR) || ' · full rank' END AS text FROM voxels""",
    ("voxels",),
)
def x9(spark, sf):
    return d.voxels(spark, sf).select(
        "model_id", "vid", "qef_rank", rank_deficient("qef_rank").alias("deficient"), rank_description("qef_rank").alias("text")
    )


_FALLBACK = """CASE ovoxel_type WHEN 0 THEN '0 · Interior (3D unconstrained)' WHEN 1 THEN '1 · Voxel face (2D optimum)'
  WHEN 2 THEN '2 · Voxel edge (1D optimum)' WHEN 3 THEN '3 · Voxel corner' ELSE 'unavailable' END"""
_EDGES = """CASE WHEN flags & 7 = 0 THEN 'none' ELSE CONCAT_WS(', ',
  CASE WHEN flags & 1 <> 0 THEN CASE WHEN flags & 8 <> 0 THEN 'X+' ELSE 'X−' END END,
  CASE WHEN flags & 2 <> 0 THEN CASE WHEN flags & 16 <> 0 THEN 'Y+' ELSE 'Y−' END END,
  CASE WHEN flags & 4 <> 0 THEN CASE WHEN flags & 32 <> 0 THEN 'Z+' ELSE 'Z−' END END) END"""


@query("x10_fallback_texts", f"SELECT model_id, vid, {_FALLBACK} AS text FROM voxels", ("voxels",))
def x10(spark, sf):
    return d.voxels(spark, sf).select("model_id", "vid", fallback_description("ovoxel_type").alias("text"))


@query("x11_edge_texts", f"SELECT model_id, vid, {_EDGES} AS text FROM voxels", ("voxels",))
def x11(spark, sf):
    return d.voxels(spark, sf).select("model_id", "vid", edge_description("flags").alias("text"))


@query(
    "a2_case_counts",
    "SELECT model_id, "
    + ", ".join(f"COUNT(*) FILTER (ovoxel_type = {n}) AS type_{n}" for n in range(4))
    + ", "
    + ", ".join(f"COUNT(*) FILTER (qef_rank = {n}) AS rank_{n}" for n in range(4))
    + " FROM voxels GROUP BY model_id",
    ("voxels",),
)
def a2(spark, sf):
    counted = d.voxels(spark, sf).groupBy("model_id").agg(
        case_counts("ovoxel_type").alias("t"), case_counts("qef_rank").alias("k")
    )
    return counted.select(
        "model_id",
        *[F.col("t")[n].alias(f"type_{n}") for n in range(4)],
        *[F.col("k")[n].alias(f"rank_{n}") for n in range(4)],
    )


@query(
    "a3_slice_legend",
    f"""SELECT m.model_id, COUNT(v.vid) AS active, CAST({R} * {R} - COUNT(v.vid) AS BIGINT) AS inactive,
        COUNT(*) FILTER (ovoxel_type = 1) AS type_1, COUNT(*) FILTER (qef_rank = 2) AS rank_2
        FROM (SELECT DISTINCT model_id FROM voxels) AS m
        LEFT JOIN voxels AS v ON v.model_id = m.model_id AND v.y = {INDEX} GROUP BY m.model_id""",
    ("voxels",),
)
def a3(spark, sf):
    v = d.voxels(spark, sf)
    legend = slices.slice_legend(slices.voxel_slice(v, "y", INDEX), models(v))
    return legend.select(
        "model_id",
        "active",
        "inactive",
        F.col("type_counts")[1].alias("type_1"),
        F.col("rank_counts")[2].alias("rank_2"),
    )


@query(
    "j5_slice_raster",
    f"""WITH grid AS (
          SELECT m.model_id, CAST(a.range AS INT) AS px, CAST(b.range AS INT) AS py
          FROM (SELECT DISTINCT model_id FROM voxels) AS m, range({R}) AS a, range({R}) AS b),
        hits AS (SELECT *, z AS hx, {R} - 1 - y AS hy, 'edges' AS mode FROM voxels WHERE x = {INDEX}),
        colored AS (SELECT model_id, hx, hy, {_COLORS} FROM hits)
        SELECT g.model_id, g.px, g.py, c.r IS NOT NULL AS active, COALESCE(c.r, 244) AS r, COALESCE(c.g, 247) AS g,
               COALESCE(c.b, 250) AS b
        FROM grid AS g LEFT JOIN colored AS c ON c.model_id = g.model_id AND c.hx = g.px AND c.hy = g.py""",
    ("voxels",),
)
def j5(spark, sf):
    v = d.voxels(spark, sf)
    sized = models(v)
    pixels = slices.slice_pixels(slices.voxel_slice(v, "x", INDEX), sized, "x")
    return slices.slice_raster(pixels, sized, "edges")


@query(
    "j6_inspect_voxels",
    f"""WITH located AS (
          SELECT *, CASE axis WHEN 'x' THEN idx ELSE px END AS gx, CASE axis WHEN 'y' THEN idx ELSE {R} - 1 - py END AS gy,
                 CASE axis WHEN 'x' THEN px WHEN 'y' THEN {R} - 1 - py ELSE idx END AS gz FROM probes)
        SELECT p.event_id, p.axis, p.idx, p.px, p.py, p.model_id, p.gx AS x, p.gy AS y, p.gz AS z,
          ROUND((p.gx + 0.5::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS world_x, v.vid IS NOT NULL AS active,
          ROUND(CASE p.axis WHEN 'x' THEN v.z + v.dz / 255.0::DOUBLE ELSE v.x + v.dx / 255.0::DOUBLE END, 6) AS dual_px,
          ROUND({R} - CASE p.axis WHEN 'y' THEN v.z + v.dz / 255.0::DOUBLE ELSE v.y + v.dy / 255.0::DOUBLE END, 6) AS dual_py,
          CASE WHEN v.vid IS NULL THEN '-' ELSE '[' || v.dx || ', ' || v.dy || ', ' || v.dz || ']' END AS dual_text,
          CASE WHEN v.vid IS NULL THEN '-' ELSE {_EDGES} END AS intersections,
          CASE WHEN v.vid IS NULL THEN '-' ELSE {_FALLBACK} END AS fallback_case,
          CASE WHEN qef_rank IS NULL THEN '-' WHEN qef_rank < 3 THEN 'yes' ELSE 'no' END AS rank_deficient
        FROM located AS p LEFT JOIN voxels AS v
          ON v.model_id = p.model_id AND v.x = p.gx AND v.y = p.gy AND v.z = p.gz""",
    ("voxels", "probes"),
)
def j6(spark, sf):
    v = d.voxels(spark, sf)
    report = slices.inspect(d.spark_sql(spark, sf, d.PROBES), v, models(v))
    return report.select(
        "event_id",
        "axis",
        "idx",
        "px",
        "py",
        "model_id",
        "x",
        "y",
        "z",
        *[F.round(c, 6).alias(c) for c in ("world_x",)],
        "active",
        *[F.round(c, 6).alias(c) for c in ("dual_px", "dual_py")],
        "dual_text",
        "intersections",
        "fallback_case",
        "rank_deficient",
    )


@query(
    "f7_voxel_rules",
    f"""WITH doubled AS (
          SELECT model_id, x, y, z, ovoxel_type, qef_rank FROM voxels
          UNION ALL SELECT model_id, x, y, z, ovoxel_type + 3, qef_rank FROM voxels WHERE flags = 9),
        counted AS (
          SELECT model_id, SUM(n) AS n, SUM(bad) AS bad, COUNT(*) FILTER (n > 1) AS twice,
                 SUM(CASE WHEN GREATEST(x, y, z) >= {R - 4} THEN n ELSE 0 END) AS beyond
          FROM (SELECT model_id, x, y, z, COUNT(*) AS n, COUNT(*) FILTER (ovoxel_type NOT BETWEEN 0 AND 3) AS bad
                FROM doubled GROUP BY 1, 2, 3, 4) AS c GROUP BY model_id),
        announced AS (SELECT model_id, COUNT(*) AS num_voxel FROM voxels GROUP BY model_id)
        SELECT c.model_id, rule, CAST(CASE rule WHEN 'voxel_count' THEN CASE WHEN c.n <> a.num_voxel THEN 1 ELSE 0 END
          WHEN 'ovoxel_type_range' THEN c.bad WHEN 'duplicate_cell' THEN c.twice WHEN 'beyond_resolution' THEN c.beyond
          ELSE 0 END AS BIGINT) AS violations
        FROM counted AS c JOIN announced AS a ON a.model_id = c.model_id,
          (VALUES ('voxel_count'), ('ovoxel_type_range'), ('qef_rank_range'), ('duplicate_cell'), ('key_range'),
                  ('record_range'), ('resolution_limit'), ('beyond_resolution')) AS rules(rule)""",
    ("voxels",),
)
def f7(spark, sf):
    v = d.voxels(spark, sf).select("model_id", "x", "y", "z", "flags", "ovoxel_type", "qef_rank")
    announced = v.groupBy("model_id").agg(F.count("*").alias("num_voxel")).withColumn("resolution", F.lit(R - 4))
    doubled = v.unionByName(v.where("flags = 9").withColumn("ovoxel_type", F.col("ovoxel_type") + 3))
    return validate_voxels(doubled, announced)


@query(
    "d3_duplicate_cells",
    """SELECT l_returnflag AS model_id, CAST(l_partkey % 64 AS INT) AS x, CAST(l_suppkey % 64 AS INT) AS y,
       CAST(l_orderkey % 64 AS INT) AS z, COUNT(*) AS copies FROM lineitem GROUP BY 1, 2, 3, 4 HAVING COUNT(*) > 1""",
)
def d3(spark, sf):
    raw = d.spark_table(spark, sf, "lineitem").selectExpr(
        "l_returnflag AS model_id",
        "CAST(l_partkey % 64 AS INT) AS x",
        "CAST(l_suppkey % 64 AS INT) AS y",
        "CAST(l_orderkey % 64 AS INT) AS z",
    )
    return duplicate_cells(raw)


@query(
    "f8_complete_stores",
    """WITH stores AS (SELECT job_id % 50 AS store_id, name, format_version, store_version FROM artefacts)
       SELECT store_id, CAST(COUNT(DISTINCT name) FILTER (name <> 'scratch.tmp') AS INT) AS artefacts,
         COUNT(DISTINCT name) FILTER (name <> 'scratch.tmp') = 8 AND MIN(format_version) = 3 AND MAX(format_version) = 3
           AND MIN(store_version) = 5 AND MAX(store_version) = 5 AS complete FROM stores GROUP BY store_id""",
    ("artefacts",),
)
def f8(spark, sf):
    artefacts = d.spark_sql(spark, sf, d.ARTEFACTS)
    return complete_stores(artefacts.withColumn("store_id", F.col("job_id") % 50))


@query(
    "o1_cell_order",
    """SELECT model_id, vid, CAST(ROW_NUMBER() OVER (PARTITION BY model_id ORDER BY cell) - 1 AS BIGINT) AS place
       FROM (SELECT model_id, vid, (CAST(x AS BIGINT) << 42) | (CAST(y AS BIGINT) << 21) | z AS cell FROM voxels) AS c""",
    ("voxels",),
)
def o1(spark, sf):
    keyed = d.voxels(spark, sf).select("model_id", "vid", pack_cell("x", "y", "z").alias("cell"))
    return dense_ordinals(keyed, "cell", "place").drop("cell")
