"""Voxel, volume, mesh and file tables derived from the shared test tables, by SQL both engines run.

Every table grows with its source: voxels and cells get one more set of models per 15000 orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

RESOLUTION = 32
ORDERS_PER_MODEL = 15_000

VOXELS = """
SELECT model_id, x, y, z, (CAST(x AS BIGINT) * 16 + y) * 32 + z AS vid,
       CAST(sum_dx % 256 AS INT) AS dx, CAST(sum_dy % 256 AS INT) AS dy, CAST(sum_dz % 256 AS INT) AS dz,
       CAST(sum_flags % 64 AS INT) AS flags,
       CASE WHEN flag = 'R' THEN NULL ELSE CAST(sum_qty % 4 AS INT) END AS ovoxel_type,
       CASE WHEN flag = 'N' THEN NULL ELSE CAST(sum_line % 4 AS INT) END AS qef_rank
FROM (
  SELECT l_returnflag AS flag,
         l_returnflag || CAST(l_orderkey // 15000 AS VARCHAR(20)) AS model_id,
         CAST(l_partkey % 16 AS INT) AS x, CAST(l_suppkey % 16 AS INT) AS y, CAST(l_orderkey % 32 AS INT) AS z,
         SUM(l_linenumber * 7 + CAST(l_quantity AS BIGINT)) AS sum_dx,
         SUM(l_linenumber * 13 + CAST(l_quantity AS BIGINT) * 3) AS sum_dy,
         SUM(l_linenumber * 29) AS sum_dz,
         SUM(l_linenumber + CAST(l_quantity AS BIGINT)) AS sum_flags,
         SUM(CAST(l_quantity AS BIGINT)) AS sum_qty,
         SUM(l_linenumber) AS sum_line
  FROM {lineitem}
  GROUP BY 1, 2, 3, 4, 5
) AS cells
"""

# The same voxels over several 64-cell blocks, up to the largest coordinate but one, with all eight flag bits.
FAR_VOXELS = (
    "SELECT model_id, x + CASE SUBSTR(model_id, 1, 1) WHEN 'R' THEN 2097135 WHEN 'A' THEN 56 ELSE 0 END AS x, "
    "y + CASE SUBSTR(model_id, 1, 1) WHEN 'R' THEN 2097135 WHEN 'A' THEN 60 ELSE 1000000 END AS y, "
    "z + CASE SUBSTR(model_id, 1, 1) WHEN 'R' THEN 2097119 WHEN 'A' THEN 40 ELSE 50 END AS z, "
    "vid, dx, dy, dz, flags + 64 * (dx % 4) AS flags, ovoxel_type, qef_rank FROM (" + VOXELS + ") AS near"
)

# Rows as a file scan would give them: chunk number, rank in the chunk, no vid yet. Chunks are 8 x 8 x 8 cells.
CHUNKED = (
    "SELECT v.*, (x // 8) * 8 + (y // 8) * 4 + (z // 8) AS chunk_no, "
    "ROW_NUMBER() OVER (PARTITION BY model_id, x // 8, y // 8, z // 8 ORDER BY vid) - 1 AS chunk_rank "
    "FROM (" + VOXELS + ") AS v"
)

CELLS = """
SELECT l_linestatus || CAST(l_orderkey // 15000 AS VARCHAR(20)) AS volume_id,
       l_linestatus AS status,
       CAST(l_partkey % 8 AS INT) AS i, CAST(l_suppkey % 8 AS INT) AS j, CAST(l_orderkey % 16 AS INT) AS k,
       CAST(SUM(l_linenumber * 3) % 9 AS INT) AS label,
       CAST(SUM(l_linenumber * 11) % 41 - 20 AS INT) AS scalar_hundredths
FROM {lineitem}
GROUP BY 1, 2, 3, 4, 5
"""

MANIFEST = """
SELECT DISTINCT l_linestatus || CAST(l_orderkey // 15000 AS VARCHAR(20)) AS volume_id,
       CAST(l_linenumber AS INT) AS code,
       'case ' || CAST(l_linenumber AS VARCHAR(10)) || ': detail' AS text
FROM {lineitem}
"""

PROBES = """
SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN 'y' ELSE 'z' END AS axis,
       CASE event_id % 7 % 3 WHEN 0 THEN 'R' WHEN 1 THEN 'A' ELSE 'N' END
         || CAST(event_id % (SELECT MAX(l_orderkey) // 15000 + 1 FROM {lineitem}) AS VARCHAR(20)) AS model_id,
       CAST(user_id % 16 AS INT) AS idx, CAST(event_id % 32 AS INT) AS px,
       CAST(((event_id - event_id % 32) / 32) % 32 AS INT) AS py
FROM {events}
"""

FILES = """
SELECT 'root' || CAST(p_size % 5 AS VARCHAR(10)) AS root, p_brand AS dir, p_partkey AS ordinal,
  CASE p_partkey % 17
    WHEN 0 THEN '000_original_boundary.npy'  WHEN 1 THEN '001_closed_boundary.npy'
    WHEN 2 THEN '002_free_space_labels.npy'  WHEN 3 THEN '003_pseudo_boundary_components.npy'
    WHEN 4 THEN '000_initial_ccl_labels.npy' WHEN 5 THEN '005_final_ccl_labels.npy'
    WHEN 6 THEN '005_final_ccl_components.npy' WHEN 7 THEN '005_Final_CCL_cases.npy'
    WHEN 8 THEN '006_inside_filtered_labels.npy' WHEN 9 THEN '007_surface_boundary_classification.npy'
    WHEN 10 THEN '999_scalar_field.npy' WHEN 11 THEN '999_linf_distance_cases.npy'
    WHEN 12 THEN 'mesh.ply' WHEN 13 THEN 'notes.txt' WHEN 14 THEN 'npy_labels.json'
    WHEN 15 THEN '008_final_ccl_labels.npy' ELSE 'part_' || CAST(p_size AS VARCHAR(10)) || '.OBJ' END AS name,
  CASE WHEN p_partkey % 10 = 0 THEN 'directory' ELSE 'file' END AS type,
  CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE CAST(p_size AS BIGINT) * 1024 END AS size,
  p_partkey * 1000 AS mtime_ms
FROM {part}
"""

ARTEFACTS = """
SELECT o_custkey AS job_id, CAST(o_orderkey % 9 AS INT) AS artefact_no,
       CASE CAST(o_orderkey % 9 AS INT)
         WHEN 0 THEN 'metadata.json' WHEN 1 THEN 'coords.npy' WHEN 2 THEN 'dual.npy' WHEN 3 THEN 'intersected.npy'
         WHEN 4 THEN 'ovoxel_type.npy' WHEN 5 THEN 'qef_rank.npy' WHEN 6 THEN 'voxels.bin' WHEN 7 THEN 'mesh.bin'
         ELSE 'scratch.tmp' END AS name,
       CASE WHEN o_custkey % 4 = 0 THEN 2 ELSE 3 END AS format_version,
       CASE WHEN o_custkey % 6 = 0 THEN 4 ELSE 5 END AS store_version
FROM {orders}
"""

CACHE = """
SELECT page_id, url || '#' || CAST(page_id AS VARCHAR(20)) AS path, LENGTH(html) AS list_size,
       page_id * 1000 AS list_mtime_ms,
       CASE WHEN page_id % 3 = 0 THEN NULL
            ELSE LENGTH(html) + CASE WHEN page_id % 5 = 0 THEN 1 ELSE 0 END END AS cached_size,
       CASE WHEN page_id % 7 = 0 THEN NULL ELSE page_id * 1000 END AS cached_mtime_ms,
       LENGTH(html) AS byte_length, page_id * 3600000 AS saved_at
FROM {pages}
"""

PROGRESS = """
SELECT user_id AS job, event_id AS line_no,
       CASE WHEN event_id % 11 = 0 THEN 'PROGRESS {{bad' WHEN event_id % 5 = 0 THEN 'plain log line'
            ELSE 'PROGRESS {{"stage":"' || event_type || '","fraction":' || CAST(event_id % 100 AS VARCHAR(10)) || '}}'
       END AS line
FROM {events}
"""

TABLES = ("lineitem", "events", "part", "orders", "pages", "embeddings", "documents")


def spark_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    used = {t: spark_table(spark, sf_dir, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql.replace("//", " div "), **used)


def duck(sql: str) -> str:
    """The SQL as DuckDB runs it: table names filled in."""
    return sql.format(**{t: t for t in TABLES})


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, VOXELS)


def far_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, FAR_VOXELS)


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_sql(spark, sf_dir, CELLS)


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_table(spark, sf_dir, "embeddings").selectExpr(
        "label AS mesh_id",
        "vec_id AS vertex_id",
        "CAST(embedding[0] AS DOUBLE) AS x",
        "CAST(embedding[1] AS DOUBLE) AS y",
        "CAST(embedding[2] AS DOUBLE) AS z",
    )


VERTICES_DUCK = """
SELECT label AS mesh_id, vec_id AS vertex_id, CAST(embedding[1] AS DOUBLE) AS x,
       CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z
FROM embeddings
"""
