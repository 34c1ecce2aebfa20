"""Listings, volumes and folder selections over real files that tasks write from the whole tables."""

from __future__ import annotations

import io
import json
import os
import uuid

import numpy as np
import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from voxspark.operators import catalog as cat
from voxspark.operators import volumes as v
from voxspark.plans.folders import folder_categories, folder_labels, load_folders
from voxspark.session import checkpoint_dir
from voxspark.sources.files import resolve
from voxspark.sources.listing import list_tree
from voxspark.sources.npy import load_volumes


def save(path: str, content: bytes, mtime: int | None = None) -> None:
    filesystem, inner = resolve(path)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(inner, compression=None) as stream:
        stream.write(content)
    if mtime is not None and isinstance(filesystem, pafs.LocalFileSystem):
        os.utime(inner, (mtime, mtime))


def new_folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/voxspark-{uuid.uuid4().hex}"


# --- listings ------------------------------------------------------------------------------------------

# One file per root, folder and name; every tenth part also makes an empty folder.
TREE = """
SELECT root, dir, name, CAST(SUM(p_size) AS BIGINT) AS size, CAST(MAX(p_partkey) AS BIGINT) AS mtime
FROM (SELECT 'root' || CAST(p_size % 5 AS VARCHAR(10)) AS root, p_size, p_partkey,
        CASE WHEN p_size % 3 = 0 THEN p_brand WHEN p_size % 3 = 1 THEN p_brand || '/Size ' || CAST(p_size AS VARCHAR(10)) ELSE '' END AS dir,
        CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 4 = 0 THEN LOWER(p_type) ELSE p_type END AS name
      FROM {part}) AS t
GROUP BY root, dir, name
"""

LISTED = f"""
tree AS ({d.duck(TREE)}),
parents AS (
  SELECT DISTINCT root, dir FROM tree UNION SELECT DISTINCT root, dir || CASE WHEN dir = '' THEN '' ELSE '/' END || 'empty' FROM tree WHERE name IS NULL
  UNION SELECT DISTINCT root, split_part(dir, '/', 1) FROM tree WHERE dir LIKE '%/%'),
entries AS (
  SELECT root, dir, name, 'file' AS type, size, mtime * 1000 AS mtime_ms FROM tree WHERE name IS NOT NULL
  UNION ALL
  SELECT root, CASE WHEN dir LIKE '%/%' THEN regexp_replace(dir, '/[^/]*$', '') ELSE '' END, regexp_extract(dir, '[^/]*$'), 'directory', NULL, NULL
  FROM parents WHERE dir <> '')"""


def written_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path) of folders that hold the files and empty folders of ``TREE``."""
    base = new_folder(spark)

    def write(batches):
        for rows in batches:
            for row in rows.itertuples():
                folder = f"{base}/{row.root}/{row.dir}".rstrip("/")
                if row.name_ is None:
                    filesystem, inner = resolve(f"{folder}/empty")
                    filesystem.create_dir(inner, recursive=True)
                else:
                    save(f"{folder}/{row.name_}", b"x" * row.size, row.mtime)
            yield pd.DataFrame({"n": [len(rows)]})

    tree = d.spark_sql(spark, sf_dir, TREE)
    tree.withColumnRenamed("name", "name_").mapInPandas(write, "n long").write.format("noop").mode("overwrite").save()
    roots = tree.select("root").distinct()
    return roots.select("root", F.concat(F.lit(f"{base}/"), "root").alias("path"))


@query(
    "s7_listing",
    f"""WITH {LISTED} SELECT root, dir, name, type, size, mtime_ms,
          ROW_NUMBER() OVER (PARTITION BY root ORDER BY dir, type <> 'directory', lower(name), name) - 1 AS ordinal FROM entries""",
)
def s7(spark, sf):
    listed = list_tree(written_tree(spark, sf))
    mtime = F.when(F.col("type") == "file", F.col("mtime_ms")).alias("mtime_ms")
    return listed.select("root", "dir", "name", "type", "size", mtime, "ordinal")


# --- order in the engine -------------------------------------------------------------------------------

PLACED = """, numbered AS (
  SELECT root, dir, name, kind, ROW_NUMBER() OVER (PARTITION BY root, dir ORDER BY kind = 'mesh', ord, lower(name), name DESC, ordinal) - 1 AS place
  FROM classified WHERE kind <> 'manifest')
SELECT root, dir, kind, name, place FROM numbered"""


def _places(spark, sf, kind):
    classified = cat.classified_files(d.spark_sql(spark, sf, d.FILES)).where("kind <> 'manifest'")
    return cat.load_ordinals(classified).where(F.col("kind") == kind).select("root", "dir", "kind", "name", "place")


def _register_places() -> None:
    from checks.catalogs import CLASSIFIED

    for name, kind in (("o2_volume_places", "volume"), ("o3_mesh_places", "mesh")):
        query(name, f"WITH {CLASSIFIED}{PLACED} WHERE kind = '{kind}'", ("files",))(lambda spark, sf, kind=kind: _places(spark, sf, kind))


_register_places()


# --- volumes -------------------------------------------------------------------------------------------

SIDES = (8, 8, 16)
DTYPES = ("<i4", ">i2", "|i1", "<f4", ">f8", "<i8", "<f2", ">u8")

# Cells without a row are 0; the largest label of the 64-bit volumes is beyond what a DOUBLE holds exactly.
GRID = """
grid AS (
  SELECT v.volume_id, CAST(a.i AS INT) AS i, CAST(b.j AS INT) AS j, CAST(c.k AS INT) AS k, COALESCE(l.label, 0) AS label
  FROM (SELECT DISTINCT volume_id FROM cells) AS v, range(8) AS a(i), range(8) AS b(j), range(16) AS c(k)
  LEFT JOIN cells AS l ON l.volume_id = v.volume_id AND l.i = a.i AND l.j = b.j AND l.k = c.k)"""


def dense(rows: pd.DataFrame) -> np.ndarray:
    array = np.zeros(SIDES, np.int64)
    array[rows["i"], rows["j"], rows["k"]] = rows["label"]
    return array


def npy_bytes(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def written_volumes(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    """(volume_id, path) of a file per volume, in all dtypes and both orders; with ``broken``, also of unusable ones."""
    base = new_folder(spark)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        volume_id = rows["volume_id"].iloc[0]
        number = int(volume_id[1:]) * 2 + (volume_id[0] == "F")
        array = dense(rows).astype(DTYPES[number % len(DTYPES)])
        content = npy_bytes(np.asfortranarray(array) if number % 3 == 0 else array)
        files = {volume_id: (f"{number}/004_final_labels.npy", content)}
        if broken:
            wide = dense(rows).astype("<i8")
            wide[0, 0, 0] = (1 << 53) + 1
            files["wide-" + volume_id] = (f"w{number}/004_final_labels.npy", npy_bytes(wide))
            files["torn-" + volume_id] = (f"t{number}/004_final_labels.npy", content[:-1])
            files["junk-" + volume_id] = (f"j{number}/004_final_labels.npy", b"junk")
            files["flat-" + volume_id] = (f"f{number}/004_final_labels.npy", npy_bytes(array[0]))
            files["other-" + volume_id] = (f"o{number}/some_array.npy", content)
        for name, data in files.values():
            save(f"{base}/{name}", data)
        files["gone-" + volume_id] = (f"g{number}/004_final_labels.npy", b"")
        names = list(files) if broken else [volume_id]
        return pd.DataFrame({"volume_id": names, "path": [f"{base}/{files[n][0]}" for n in names]})

    from voxspark.session import settle

    return settle(d.cells(spark, sf_dir).groupBy("volume_id").applyInPandas(write, "volume_id string, path string"))


@query("s4_npy_cells", f"WITH {GRID} SELECT volume_id, i, j, k, CAST(label AS DOUBLE) AS value FROM grid", ("cells",))
def s4_cells(spark, sf):
    return load_volumes(written_volumes(spark, sf)).cells


@query(
    "s4_npy_slabs",
    f"""WITH {GRID} SELECT 'i' AS axis, volume_id, i, j, k, CAST(label AS DOUBLE) AS value FROM grid WHERE i = 3
        UNION ALL SELECT 'j', volume_id, i, j, k, label FROM grid WHERE j = 7 UNION ALL SELECT 'k', volume_id, i, j, k, label FROM grid WHERE k = 15
        UNION ALL SELECT 'all', volume_id, i, j, k, label FROM grid WHERE i >= 2 AND i < 5 AND j >= 1 AND j < 3 AND k >= 4 AND k < 9""",
    ("cells",),
)
def s4_slabs(spark, sf):
    files = written_volumes(spark, sf)
    boxes = {"i": {"i": (3, 4)}, "j": {"j": (7, 8)}, "k": {"k": (15, 99)}, "all": {"i": (2, 5), "j": (1, 3), "k": (4, 9)}}
    parts = [load_volumes(files, box).cells.withColumn("axis", F.lit(name)) for name, box in boxes.items()]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


@query(
    "s4_npy_statuses",
    """SELECT kind || volume_id AS volume_id, status, CASE WHEN kind = 'wide-' THEN 1 END AS warnings
       FROM (SELECT DISTINCT volume_id FROM cells) AS v, (VALUES ('', 'loaded'), ('wide-', 'loaded'), ('torn-', 'failed'),
         ('junk-', 'failed'), ('flat-', 'failed'), ('other-', 'failed'), ('gone-', 'failed')) AS t(kind, status)""",
    ("cells",),
)
def s4_statuses(spark, sf):
    loaded = load_volumes(written_volumes(spark, sf, broken=True))
    warnings = loaded.volumes.select("volume_id", F.size("warnings").alias("warnings"))
    return loaded.statuses.join(warnings, "volume_id", "left").select("volume_id", "status", "warnings")


@query(
    "s4_unsafe_labels",
    """SELECT 'wide-' || volume_id AS volume_id, CAST(1 AS BIGINT) AS unsafe_labels FROM (SELECT DISTINCT volume_id FROM cells) AS v""",
    ("cells",),
)
def s4_unsafe(spark, sf):
    loaded = load_volumes(written_volumes(spark, sf, broken=True))
    return v.unsafe_volumes(loaded.cells, loaded.volumes).where("unsafe_labels > 0")


# --- folders -------------------------------------------------------------------------------------------

STEP = "005"
CHOSEN = {"labels": f"{STEP}_final_ccl_labels.npy", "components": f"{STEP}_final_ccl_components.npy", "cases": f"{STEP}_final_ccl_cases.npy"}


def written_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(root, path): per volume a root with a complete step and a manifest in one folder, and volumes of no use in others."""
    base = new_folder(spark)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        volume_id = rows["volume_id"].iloc[0]
        array = dense(rows).astype("<i4")
        texts = {str(n): f"case {n}: detail" for n in range(1, 8)}
        files = {f"good/{CHOSEN['labels']}": npy_bytes(array), f"good/{CHOSEN['components']}": npy_bytes(array % 3)}
        files[f"good/{CHOSEN['cases']}"] = npy_bytes(np.asfortranarray(array))
        files["good/npy_labels.json"] = json.dumps({"files": {"x/" + CHOSEN["cases"]: {"labels": texts}}}).encode()
        files["good/other.txt"] = b"text"
        # Opening any of these would give a failed status.
        files["bad/004_final_labels.npy"] = files[f"bad/deep/{CHOSEN['labels']}"] = files["bad/mesh.ply"] = b"junk"
        for name, data in files.items():
            save(f"{base}/{volume_id}/{name}", data)
        return pd.DataFrame({"root": [volume_id], "path": [f"{base}/{volume_id}"]})

    from voxspark.session import settle

    return settle(d.cells(spark, sf_dir).groupBy("volume_id").applyInPandas(write, "root string, path string"))


FOLDERS = f"""{GRID},
files AS (
  SELECT volume_id AS root, name, CASE WHEN name LIKE '%components%' THEN label % 3 ELSE label END AS label
  FROM grid, (VALUES ('{CHOSEN["labels"]}'), ('{CHOSEN["components"]}'), ('{CHOSEN["cases"]}')) AS t(name))"""


@query(
    "j10_folder_histograms",
    f"""WITH {FOLDERS} SELECT root || '/good/' || name AS volume_id, CAST(label AS DOUBLE) AS label, COUNT(*) AS cells,
          CASE WHEN name LIKE '%cases%' AND label BETWEEN 1 AND 7 THEN 'case ' || label || ': detail' ELSE 'L-infinity case ' || label END AS text
        FROM files GROUP BY root, name, label""",
    ("cells",),
)
def j10_histograms(spark, sf):
    folders = load_folders(list_tree(written_folders(spark, sf)))
    return folder_labels(folders).select("volume_id", F.col("label").cast("double").alias("label"), "cells", "text")


@query(
    "j10_folder_legends",
    f"""WITH {FOLDERS} SELECT root || '/good/' || name AS volume_id, COUNT(*) AS cells FROM files
        GROUP BY root, name""",
    ("cells",),
)
def j10_legends(spark, sf):
    folders = load_folders(list_tree(written_folders(spark, sf)))
    counted = folder_categories(folders).groupBy("volume_id").agg(F.sum("cells").alias("cells"))
    return counted


@query(
    "j10_folder_statuses",
    f"""SELECT volume_id || '/good/' || name AS volume_id, 'loaded' AS status FROM (SELECT DISTINCT volume_id FROM cells) AS v,
        (VALUES ('{CHOSEN["labels"]}'), ('{CHOSEN["components"]}'), ('{CHOSEN["cases"]}')) AS t(name)""",
    ("cells",),
)
def j10_statuses(spark, sf):
    return load_folders(list_tree(written_folders(spark, sf))).volumes.statuses.select("volume_id", "status")
