"""File catalogs, folder selection, cache tables, job progress and input identities."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from voxspark.functions import names as n
from voxspark.operators import cache as c
from voxspark.operators import catalog as cat
from voxspark.streaming.progress import latest_progress

# Orders and roles of the file names the derived file table uses.
CLASSIFIED = """
classified AS (
  SELECT root, dir, ordinal, name, CASE WHEN name = 'npy_labels.json' THEN 'manifest'
      WHEN regexp_matches(name, '\\.(ply|obj|stl)$', 'i') THEN 'mesh' WHEN lower(name) LIKE '%.npy' THEN 'volume' END AS kind,
    CASE WHEN name = 'mesh.ply' THEN 1.0::DOUBLE WHEN regexp_matches(name, '\\.(ply|obj|stl)$', 'i') THEN 2.0::DOUBLE
      WHEN name LIKE '999_linf%' THEN 999.1::DOUBLE
      WHEN lower(name) LIKE '%_final_ccl_components.npy' THEN CAST(substr(name, 1, 3) AS DOUBLE) + 0.1::DOUBLE
      WHEN lower(name) LIKE '%_final_ccl_cases.npy' THEN CAST(substr(name, 1, 3) AS DOUBLE) + 0.2::DOUBLE
      WHEN lower(name) LIKE '%.npy' THEN CAST(substr(name, 1, 3) AS DOUBLE) END AS ord,
    CASE WHEN lower(name) LIKE '%_final_ccl_%' THEN substr(name, 1, 3) WHEN name LIKE '006_%' THEN '005'
      WHEN name LIKE '007_%' THEN '005' END AS prefix,
    CASE WHEN lower(name) LIKE '%_final_ccl_labels.npy' THEN 'label' WHEN lower(name) LIKE '%_final_ccl_components.npy'
      THEN 'components' WHEN lower(name) LIKE '%_final_ccl_cases.npy' THEN 'cases' WHEN name LIKE '006_%' THEN 'insideFiltered'
      WHEN name LIKE '007_%' THEN 'surfaceBoundary' END AS role
  FROM files WHERE type = 'file' AND name <> 'notes.txt')"""

SELECTED = (
    CLASSIFIED
    + """,
dirs AS (
  SELECT root, dir, COUNT(*) FILTER (kind = 'mesh') AS meshes, COUNT(*) FILTER (kind = 'volume') AS volumes,
    COUNT(*) FILTER (kind = 'volume' AND name <> '999_scalar_field.npy') AS non_scalar,
    max_by(name, ordinal) FILTER (kind = 'manifest') AS manifest
  FROM classified GROUP BY root, dir),
scored AS (SELECT *, CASE WHEN meshes > 0 THEN 10000 ELSE 0 END + non_scalar * 100 + volumes AS score FROM dirs),
grouped AS (
  SELECT root, dir, prefix, MIN(ordinal) AS first_ordinal,
    max_by(name, ordinal) FILTER (role = 'label') AS label, max_by(name, ordinal) FILTER (role = 'components') AS components,
    max_by(name, ordinal) FILTER (role = 'cases') AS cases,
    max_by(name, ordinal) FILTER (role = 'insideFiltered') AS "insideFiltered",
    max_by(name, ordinal) FILTER (role = 'surfaceBoundary') AS "surfaceBoundary"
  FROM classified WHERE role IS NOT NULL GROUP BY root, dir, prefix),
candidates AS (
  SELECT g.*, CAST(CASE WHEN s.meshes > 0 THEN 1000 ELSE 0 END + CASE WHEN label IS NULL THEN 0 ELSE 100 END
    + CASE WHEN components IS NULL THEN 0 ELSE 90 END + CASE WHEN cases IS NULL THEN 0 ELSE 90 END
    + CASE WHEN "insideFiltered" IS NULL THEN 0 ELSE 40 END + CASE WHEN "surfaceBoundary" IS NULL THEN 0 ELSE 40 END
    + CAST(prefix AS INT) AS INT) AS score, label IS NOT NULL AND components IS NOT NULL AND cases IS NOT NULL AS complete
  FROM grouped AS g JOIN scored AS s ON s.root = g.root AND s.dir = g.dir),
best AS (
  SELECT root, dir FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY root ORDER BY complete DESC, score DESC, first_ordinal)
    AS place FROM candidates) AS r WHERE place = 1),
spare AS (
  SELECT root, dir FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY root ORDER BY score DESC, dir) AS place
    FROM scored WHERE volumes > 0) AS r WHERE place = 1),
chosen AS (SELECT s.root, COALESCE(b.dir, s.dir) AS dir FROM spare AS s LEFT JOIN best AS b ON b.root = s.root),
selection AS (
  SELECT f.root, f.dir, f.kind, f.ord, f.name FROM classified AS f JOIN chosen AS x ON x.root = f.root AND x.dir = f.dir
  WHERE f.kind <> 'manifest'
  UNION ALL
  SELECT s.root, s.dir, 'manifest', NULL, s.manifest FROM scored AS s JOIN chosen AS x ON x.root = s.root AND x.dir = s.dir
  WHERE s.manifest IS NOT NULL)"""
)


def files(spark, sf):
    return d.spark_sql(spark, sf, d.FILES)


def cached(spark, sf):
    rows = d.spark_sql(spark, sf, d.CACHE)
    listing = rows.where("page_id % 11 <> 0").select(
        "path", F.when(F.col("page_id") % 2 == 0, F.col("list_size")).alias("size"), F.col("list_mtime_ms").alias("mtime_ms")
    )
    copies = rows.where("page_id % 4 <> 0").select("path", "cached_size", "cached_mtime_ms", "byte_length", "saved_at")
    return listing, copies


CACHED = """
listing AS (SELECT path, CASE WHEN page_id % 2 = 0 THEN list_size END AS size, list_mtime_ms AS mtime_ms FROM cache
            WHERE page_id % 11 <> 0),
copies AS (SELECT path, cached_size, cached_mtime_ms, byte_length, saved_at FROM cache WHERE page_id % 4 <> 0),
judged AS (
  SELECT l.*, CASE WHEN c.path IS NULL THEN 'miss'
    WHEN (size IS NOT NULL AND size IS DISTINCT FROM cached_size)
      OR (mtime_ms IS NOT NULL AND mtime_ms IS DISTINCT FROM cached_mtime_ms) THEN 'stale' ELSE 'hit' END AS status
  FROM listing AS l LEFT JOIN copies AS c ON c.path = l.path)"""


@query(
    "s7_listing_order",
    """SELECT dir, ordinal, name, type, size, mtime_ms,
       CAST(ROW_NUMBER() OVER (PARTITION BY dir ORDER BY type <> 'directory', lower(name), ordinal) AS INT) AS place FROM files""",
    ("files",),
)
def s7(spark, sf):
    # The place makes the order comparable; a listing itself only needs listing_order.
    order = Window.partitionBy("dir").orderBy(F.col("type") != "directory", F.lower("name"), "ordinal")
    listed = cat.listing_order(files(spark, sf))
    return listed.select("dir", "ordinal", "name", "type", "size", "mtime_ms", F.row_number().over(order).alias("place"))


@query("f10_file_kinds", "WITH " + CLASSIFIED + " SELECT root, dir, ordinal, name, kind FROM classified", ("files",))
def f10(spark, sf):
    return cat.classified_files(files(spark, sf)).select("root", "dir", "ordinal", "name", "kind")


@query(
    "x3_volume_kinds",
    """SELECT ordinal, name, CASE WHEN name LIKE '%_boundary.npy' THEN 'boundaryMask'
       WHEN name LIKE '003_%' THEN 'componentLabels' WHEN lower(name) LIKE '%_components.npy' THEN 'finalCclComponents'
       WHEN name LIKE '999_linf%' THEN 'linfinityDistanceCases' WHEN lower(name) LIKE '%_cases.npy' THEN 'finalCclCases'
       WHEN name LIKE '007_%' THEN 'surfaceBoundaryClassification' WHEN name LIKE '999_scalar%' THEN 'scalarField'
       WHEN name LIKE '%labels.npy' THEN 'pipelineLabels' END AS kind FROM files""",
    ("files",),
)
def x3(spark, sf):
    return files(spark, sf).select("ordinal", "name", n.volume_kind(F.concat(F.lit("a/b/"), "name")).alias("kind"))


@query(
    "x4_volume_roles",
    "WITH " + CLASSIFIED + " SELECT ordinal, name, prefix, role FROM classified",
    ("files",),
)
def x4(spark, sf):
    return cat.classified_files(files(spark, sf)).select("ordinal", "name", "prefix", "role")


@query(
    "a7_folder_candidates",
    "WITH " + SELECTED + """ SELECT root, dir, prefix, first_ordinal, label, components, cases, "insideFiltered",
      "surfaceBoundary", score, complete FROM candidates""",
    ("files",),
)
def a7(spark, sf):
    classified = cat.classified_files(files(spark, sf))
    return cat.candidates(classified, cat.directory_scores(classified))


@query("w6_selected_folders", "WITH " + SELECTED + " SELECT root, dir FROM chosen", ("files",))
def w6(spark, sf):
    classified = cat.classified_files(files(spark, sf))
    directories = cat.directory_scores(classified)
    return cat.selected_directories(cat.candidates(classified, directories), directories)


@query("w6_directory_scores", "WITH " + SELECTED + " SELECT * FROM scored", ("files",))
def w6_scores(spark, sf):
    return cat.directory_scores(cat.classified_files(files(spark, sf)))


@query("j10_folder_selection", "WITH " + SELECTED + " SELECT * FROM selection", ("files",))
def j10(spark, sf):
    return cat.folder_selection(files(spark, sf))


@query(
    "j10_roots_without_volumes",
    "WITH "
    + CLASSIFIED
    + """ SELECT 'r' || CAST(f.ordinal // 3 AS VARCHAR) AS root,
        CASE WHEN BOOL_OR(k.kind = 'mesh') THEN 'meshes without a loadable volume' ELSE 'no loadable volume' END AS reason
      FROM files AS f LEFT JOIN classified AS k ON k.ordinal = f.ordinal
      GROUP BY 1 HAVING NOT COALESCE(BOOL_OR(k.kind = 'volume'), false)""",
    ("files",),
)
def j10_left_out(spark, sf):
    return cat.roots_without_volumes(files(spark, sf).withColumn("root", F.expr("'r' || cast(ordinal div 3 AS STRING)")))


@query(
    "o2_volume_order",
    "WITH " + CLASSIFIED + " SELECT root, dir, ordinal, name, ord FROM classified WHERE kind = 'volume'",
    ("files",),
)
def o2(spark, sf):
    volumes = cat.classified_files(files(spark, sf)).where("kind = 'volume'")
    return cat.load_order(volumes).select("root", "dir", "ordinal", "name", "ord")


@query(
    "o3_mesh_order",
    "WITH " + CLASSIFIED + " SELECT root, dir, ordinal, name, ord FROM classified WHERE kind = 'mesh'",
    ("files",),
)
def o3(spark, sf):
    meshes = cat.classified_files(files(spark, sf)).where("kind = 'mesh'")
    return cat.load_order(meshes).select("root", "dir", "ordinal", "name", "ord")


@query(
    "o4_default_volumes",
    "WITH "
    + SELECTED
    + """ SELECT root, name FROM (SELECT root, name, ROW_NUMBER() OVER (PARTITION BY root
            ORDER BY lower(name) NOT LIKE '%cases%', ord, name) AS place FROM selection WHERE kind = 'volume') AS s
          WHERE place = 1""",
    ("files",),
)
def o4(spark, sf):
    return cat.default_volumes(cat.folder_selection(files(spark, sf)))


@query(
    "u1_load_set",
    "WITH " + SELECTED + " SELECT root, kind, COUNT(*) AS files FROM selection WHERE kind <> 'manifest' GROUP BY 1, 2",
    ("files",),
)
def u1(spark, sf):
    selection = cat.folder_selection(files(spark, sf))
    both = selection.where("kind = 'volume'").unionByName(selection.where("kind = 'mesh'"))
    return both.groupBy("root", "kind").agg(F.count("*").alias("files"))


@query("j9_cache_status", "WITH " + CACHED + " SELECT * FROM judged", ("cache",))
def j9(spark, sf):
    return c.cache_status(*cached(spark, sf))


@query("f9_files_to_fetch", "WITH " + CACHED + " SELECT path, size, mtime_ms FROM judged WHERE status <> 'hit'", ("cache",))
def f9(spark, sf):
    return c.files_to_fetch(*cached(spark, sf))


@query(
    "a8_cache_stats",
    """SELECT COUNT(*) AS file_count, CAST(COALESCE(SUM(byte_length) FILTER (byte_length > 0), 0) AS BIGINT) AS tracked_bytes,
       MIN(saved_at) AS oldest_saved_at FROM cache""",
    ("cache",),
)
def a8(spark, sf):
    return c.cache_stats(d.spark_sql(spark, sf, d.CACHE))


@query(
    "a9_evicted_files",
    """SELECT COUNT(*) AS deleted_count, CAST(COALESCE(SUM(byte_length), 0) AS BIGINT) AS deleted_bytes FROM cache
       WHERE saved_at <= 360000000""",
    ("cache",),
)
def a9(spark, sf):
    return c.evict_older_than(d.spark_sql(spark, sf, d.CACHE), 360_000_000)[1]


@query("a9_surviving_files", "SELECT page_id, path FROM cache WHERE saved_at > 360000000", ("cache",))
def a9_survivors(spark, sf):
    return c.evict_older_than(d.spark_sql(spark, sf, d.CACHE), 360_000_000)[0].select("page_id", "path")


IDENTIFIED = """
given AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 5 + 1 AS INT) END AS resolution FROM documents),
identified AS (SELECT doc_id, resolution, CASE WHEN resolution IS NULL THEN sha256(text)
  ELSE sha256(sha256(text) || ':r=' || resolution) END AS id FROM given)"""


def _identified(spark, sf):
    documents = d.spark_table(spark, sf, "documents")
    resolution = F.when(F.col("doc_id") % 3 == 0, (F.col("doc_id") % 5 + 1).cast("int"))
    return c.identified(documents.select("doc_id", F.col("text").alias("content"), resolution.alias("resolution")))


@query("s9_input_identities", "WITH " + IDENTIFIED + " SELECT doc_id, resolution, id FROM identified")
def s9(spark, sf):
    return _identified(spark, sf).select("doc_id", "resolution", "id")


@query(
    "d4_new_inputs",
    "WITH " + IDENTIFIED + """ SELECT DISTINCT id FROM identified
      WHERE id NOT IN (SELECT id FROM identified WHERE doc_id % 7 = 0)""",
)
def d4(spark, sf):
    inputs = _identified(spark, sf)
    return c.new_inputs(inputs, inputs.where("doc_id % 7 = 0")).select("id")


@query(
    "w7_latest_progress",
    """WITH parsed AS (
         SELECT job, line_no, regexp_extract(line, '"stage":"([a-z]+)"', 1) AS stage,
                CAST(regexp_extract(line, '"fraction":([0-9]+)', 1) AS DOUBLE) AS fraction
         FROM progress_lines WHERE line LIKE 'PROGRESS {"stage"%')
       SELECT job, max_by(stage, line_no) AS stage, max_by(fraction, line_no) AS progress, CAST(NULL AS VARCHAR) AS message
       FROM parsed GROUP BY job""",
    ("progress_lines",),
)
def w7(spark, sf):
    return latest_progress(d.spark_sql(spark, sf, d.PROGRESS))
