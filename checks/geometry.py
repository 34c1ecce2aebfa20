"""Coordinate projections and keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from voxspark.functions import geometry as g
from voxspark.functions.labels import effective_mode

R = d.RESOLUTION


def r6(column, name):
    return F.round(column, 6).alias(name)


@query(
    "p1_cell_centers",
    f"""SELECT model_id, vid, ROUND((x + 0.5::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS wx,
        ROUND((y + 0.5::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS wy, ROUND((z + 0.5::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS wz
        FROM voxels""",
    ("voxels",),
)
def p1(spark, sf):
    v = d.voxels(spark, sf)
    return v.select("model_id", "vid", *[r6(g.cell_center(c, R), f"w{c}") for c in "xyz"])


@query(
    "p2_dual_positions",
    f"""SELECT model_id, vid, ROUND((x + dx / 255.0::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS wx,
        ROUND((y + dy / 255.0::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS wy,
        ROUND((z + dz / 255.0::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS wz FROM voxels""",
    ("voxels",),
)
def p2(spark, sf):
    v = d.voxels(spark, sf)
    return v.select("model_id", "vid", *[r6(g.dual_position(c, f"d{c}", R), f"w{c}") for c in "xyz"])


@query(
    "p3_split_positions",
    f"""SELECT model_id, vid,
        (CAST(x AS FLOAT) + CAST(dx AS FLOAT) / 255::FLOAT) * CAST(1.0::DOUBLE / {R + 1} AS FLOAT) - 0.5::FLOAT AS wx,
        (CAST(y AS FLOAT) + CAST(dy AS FLOAT) / 255::FLOAT) * CAST(1.0::DOUBLE / {R + 1} AS FLOAT) - 0.5::FLOAT AS wy,
        (CAST(z AS FLOAT) + CAST(dz AS FLOAT) / 255::FLOAT) * CAST(1.0::DOUBLE / {R + 1} AS FLOAT) - 0.5::FLOAT AS wz
        FROM voxels""",
    ("voxels",),
)
def p3(spark, sf):
    v = d.voxels(spark, sf)
    return v.select("model_id", "vid", *[g.split_position_f32(c, f"d{c}", R + 1).alias(f"w{c}") for c in "xyz"])


@query(
    "p4_packed_cells",
    """SELECT model_id, vid, (CAST(x AS BIGINT) << 42) | (CAST(y AS BIGINT) << 21) | CAST(z AS BIGINT) AS cell
       FROM voxels""",
    ("voxels",),
)
def p4(spark, sf):
    return d.voxels(spark, sf).select("model_id", "vid", g.pack_cell("x", "y", "z").alias("cell"))


_MORTON = " + ".join(
    f"((({c} >> {bit}) & 1) << {3 * bit + offset})" for bit in range(5) for offset, c in ((2, "x"), (1, "y"), (0, "z"))
)


@query(
    "p5_morton_codes",
    f"SELECT model_id, vid, CAST({_MORTON} AS INT) AS code, x AS mx, y AS my, z AS mz FROM voxels",
    ("voxels",),
)
def p5(spark, sf):
    coded = d.voxels(spark, sf).select("model_id", "vid", g.morton_encode("x", "y", "z").alias("code"))
    return coded.select("*", *[c.alias(n) for c, n in zip(g.morton_decode("code"), ("mx", "my", "mz"))])


@query(
    "p6_grid_to_pixel",
    f"""SELECT model_id, vid, axis, CASE axis WHEN 'x' THEN z ELSE x END AS px,
        CAST({R} - 1 - CASE axis WHEN 'y' THEN z ELSE y END AS INT) AS py
        FROM voxels, (VALUES ('x'), ('y'), ('z')) AS axes(axis)""",
    ("voxels",),
)
def p6(spark, sf):
    v = d.voxels(spark, sf).withColumn("axis", F.explode(F.array(*[F.lit(a) for a in "xyz"])))
    px, py = g.grid_to_pixel("axis", "x", "y", "z", R)
    return v.select("model_id", "vid", "axis", px.cast("int").alias("px"), py.cast("int").alias("py"))


@query(
    "p7_pixel_to_grid",
    f"""SELECT event_id, CASE axis WHEN 'x' THEN idx ELSE px END AS gx,
        CASE axis WHEN 'y' THEN idx ELSE {R} - 1 - py END AS gy,
        CASE axis WHEN 'x' THEN px WHEN 'y' THEN {R} - 1 - py ELSE idx END AS gz FROM probes""",
    ("probes",),
)
def p7(spark, sf):
    probes = d.spark_sql(spark, sf, d.PROBES)
    grid = g.pixel_to_grid("axis", "idx", "px", "py", R)
    return probes.select("event_id", *[c.alias(f"g{n}") for c, n in zip(grid, "xyz")])


@query(
    "p8_dual_projection",
    f"""WITH p AS (SELECT model_id, vid, axis,
          CASE axis WHEN 'x' THEN z + dz / 255.0::DOUBLE ELSE x + dx / 255.0::DOUBLE END AS h,
          {R} - CASE axis WHEN 'y' THEN z + dz / 255.0::DOUBLE ELSE y + dy / 255.0::DOUBLE END AS v
          FROM voxels, (VALUES ('x'), ('y'), ('z')) AS axes(axis))
        SELECT model_id, vid, axis, ROUND(h, 6) AS pixel_x, ROUND(v, 6) AS pixel_y,
        ROUND(h / {R} * 2 - 1, 6) AS plane_x, ROUND(1 - v / {R} * 2, 6) AS plane_y FROM p""",
    ("voxels",),
)
def p8(spark, sf):
    v = d.voxels(spark, sf).withColumn("axis", F.explode(F.array(*[F.lit(a) for a in "xyz"])))
    projected = g.dual_to_slice("axis", ("x", "y", "z"), ("dx", "dy", "dz"), R)
    return v.select("model_id", "vid", "axis", *[r6(c, n) for n, c in projected.items()])


@query(
    "p9_node_positions",
    """SELECT volume_id, i, j, k, ROUND(-1 + i * 2 / 7.0::DOUBLE, 6) AS wx, ROUND(-1 + j * 2 / 7.0::DOUBLE, 6) AS wy,
       ROUND(-1 + k * 2 / 15.0::DOUBLE, 6) AS wz, 0.0::DOUBLE AS w1 FROM cells""",
    ("cells",),
)
def p9(spark, sf):
    return d.cells(spark, sf).select(
        "volume_id",
        "i",
        "j",
        "k",
        *[r6(g.node_position(n, s), w) for n, s, w in (("i", 8, "wx"), ("j", 8, "wy"), ("k", 16, "wz"), ("i", 1, "w1"))],
    )


@query(
    "p10_flat_offsets",
    """SELECT volume_id, i, j, k, CAST(k + 16 * (j + 8 * i) AS BIGINT) AS c_offset,
       CAST(i + 8 * (j + 8 * k) AS BIGINT) AS f_offset, i AS ci, j AS cj, k AS ck, i AS fi, j AS fj, k AS fk FROM cells""",
    ("cells",),
)
def p10(spark, sf):
    shape = (8, 8, 16)
    flat = d.cells(spark, sf).select(
        "volume_id",
        "i",
        "j",
        "k",
        g.flat_offset("i", "j", "k", *shape, F.lit(False)).alias("c_offset"),
        g.flat_offset("i", "j", "k", *shape, F.lit(True)).alias("f_offset"),
    )
    nodes = []
    for order, fortran in (("c", False), ("f", True)):
        node = g.flat_to_node(f"{order}_offset", *shape, F.lit(fortran))
        nodes += [c.alias(f"{order}{n}") for c, n in zip(node, "ijk")]
    return flat.select("*", *nodes)


@query(
    "p11_volume_pixels",
    """SELECT event_id, axis, CASE axis WHEN 'x' THEN 16 ELSE 8 END AS width,
       CASE axis WHEN 'y' THEN 16 ELSE 8 END AS height,
       CASE axis WHEN 'x' THEN idx ELSE px END AS ni,
       CASE axis WHEN 'y' THEN idx ELSE 7 - py END AS nj,
       CASE axis WHEN 'x' THEN px WHEN 'y' THEN 15 - py ELSE idx END AS nk FROM probes""",
    ("probes",),
)
def p11(spark, sf):
    probes = d.spark_sql(spark, sf, d.PROBES)
    width, height = g.slice_width("axis", 8, 8, 16), g.slice_height("axis", 8, 8, 16)
    node = g.pixel_to_grid("axis", "idx", "px", "py", height)
    return probes.select(
        "event_id", "axis", width.alias("width"), height.alias("height"), *[c.alias(f"n{n}") for c, n in zip(node, "ijk")]
    )


@query(
    "p12_plane_positions",
    f"""SELECT event_id, ROUND((idx + 0.5::DOUBLE) / {R} - 0.5::DOUBLE, 6) AS cell_plane,
        ROUND(-1 + idx * 2 / ({R} - 1.0::DOUBLE), 6) AS node_plane FROM probes""",
    ("probes",),
)
def p12(spark, sf):
    probes = d.spark_sql(spark, sf, d.PROBES)
    return probes.select(
        "event_id",
        r6(g.slice_plane_position("idx", R, F.lit(False)), "cell_plane"),
        r6(g.slice_plane_position("idx", R, F.lit(True)), "node_plane"),
    )


@query(
    "p13_axis_indices",
    "SELECT event_id, axis, CASE axis WHEN 'x' THEN 0 WHEN 'y' THEN 1 ELSE 2 END AS axis_index FROM probes",
    ("probes",),
)
def p13(spark, sf):
    return d.spark_sql(spark, sf, d.PROBES).select("event_id", "axis", g.axis_index("axis").alias("axis_index"))


@query(
    "o6_slice_index",
    """SELECT event_id, CAST(LEAST(GREATEST(FLOOR(value / 3 - 10 + 0.5), 0), 31) AS BIGINT) AS clamped,
       CAST(FLOOR((user_id % 40) / 2.0) AS BIGINT) AS middle FROM events""",
)
def o6(spark, sf):
    events = d.spark_table(spark, sf, "events")
    return events.select(
        "event_id",
        g.clamp_index(F.col("value") / 3 - 10, 32).alias("clamped"),
        g.middle_index(F.col("user_id") % 40 + 1).cast("long").alias("middle"),
    )


@query(
    "x20_overlay_scale",
    "SELECT o_orderkey, CASE WHEN (o_orderkey % 4096) * 2 <= 4096 THEN 2 ELSE 1 END AS scale FROM orders",
)
def x20(spark, sf):
    orders = d.spark_table(spark, sf, "orders")
    return orders.select("o_orderkey", g.overlay_scale(F.col("o_orderkey") % 4096).alias("scale"))


@query(
    "x22_effective_mode",
    """SELECT DISTINCT model_id, mode,
       CASE WHEN (mode = 'fallback' AND NOT has_type) OR (mode = 'rank' AND NOT has_rank) THEN 'occupancy' ELSE mode END
         AS effective
       FROM (SELECT model_id, COUNT(ovoxel_type) > 0 AS has_type, COUNT(qef_rank) > 0 AS has_rank
             FROM voxels GROUP BY model_id) AS m,
            (VALUES ('occupancy'), ('edges'), ('dual'), ('fallback'), ('rank')) AS modes(mode)""",
    ("voxels",),
)
def x22(spark, sf):
    flags = d.voxels(spark, sf).groupBy("model_id").agg(
        (F.count("ovoxel_type") > 0).alias("has_type"), (F.count("qef_rank") > 0).alias("has_rank")
    )
    modes = F.explode(F.array(*[F.lit(m) for m in ("occupancy", "edges", "dual", "fallback", "rank")]))
    listed = flags.withColumn("mode", modes)
    return listed.select("model_id", "mode", effective_mode("mode", "has_type", "has_rank").alias("effective"))
