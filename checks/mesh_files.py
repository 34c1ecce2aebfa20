"""Text meshes that tasks write from all embeddings, read back in several byte ranges a file."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as d
from checks.folders import new_folder, save
from checks.registry import query
from voxspark.session import settle
from voxspark.sources import register
from voxspark.sources.mesh_files import MeshSet, load_meshes

SPLIT = 1500

# Vertices of a mesh in order of their ids; every fourth ends a polygon of four corners.
NUMBERED = """
numbered AS (SELECT mesh_id, ROW_NUMBER() OVER (PARTITION BY mesh_id ORDER BY vertex_id) - 1 AS n, x, y, z FROM vertices),
sides AS (SELECT mesh_id, n FROM numbered WHERE n % 4 = 3),
fans AS (
  SELECT mesh_id, 2 * (n // 4) AS face_id, n - 3 AS a, n - 2 AS b, n - 1 AS c FROM sides
  UNION ALL SELECT mesh_id, 2 * (n // 4) + 1, n - 3, n - 1, n FROM sides)"""


def _texts(points: np.ndarray) -> dict[str, str]:
    words = [" ".join(repr(float(v)) for v in p) for p in points.astype(np.float32)]
    obj, faces = [], []
    for n, word in enumerate(words):
        obj.append("v " + word)
        if n % 4 == 3:
            # The last two corners count back from here, in every other polygon over a continued line.
            obj.append(f"f {n - 2}/1 {n - 1}/2 " + ("\\\n" if n % 8 == 3 else "") + "-2 -1")
            faces.append(f"4 {n - 3} {n - 2} {n - 1} {n}")
    ply = ["ply", "format ascii 1.0", f"element vertex {len(words)}", *[f"property float {c}" for c in "xyz"]]
    ply += [f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header", *words, *faces]
    stl = ["solid s"]
    for n in range(0, len(words) - 2, 3):
        stl += ["facet normal 0 0 1", "outer loop", *[f"vertex {w}" for w in words[n : n + 3]], "endloop", "endfacet"]
    return {"obj": "\n".join(obj), "ply": "\n".join(ply), "stl": "\n".join([*stl, "endsolid s"])}


def _written(spark: SparkSession, sf_dir: str, broken: bool = False) -> DataFrame:
    base = new_folder(spark)

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        mesh = rows["mesh_id"].iloc[0]
        points = rows.sort_values("vertex_id")[["x", "y", "z"]].to_numpy()
        files = {f"{mesh}.{suffix}": text.encode() for suffix, text in _texts(points).items()}
        if broken:
            files |= {f"{mesh}-torn.{s}": files[f"{mesh}.{s}"].replace(b"e", b"?", 1) + b"\nv 1 2 x\nvertex 1 2 x\n" for s in ("obj", "stl")}
            files[f"{mesh}-torn.ply"] = files[f"{mesh}.ply"][:-1].rsplit(b"\n", 1)[0]
            files[f"{mesh}-junk.ply"] = files[f"{mesh}-junk.stl"] = b"junk"
        for name, data in files.items():
            save(f"{base}/{name}", data)
        return pd.DataFrame({"mesh_id": list(files), "path": [f"{base}/{name}" for name in files]})

    vertices = d.vertices(spark, sf_dir)
    return settle(vertices.groupBy("mesh_id").applyInPandas(write, "mesh_id string, path string"))


def _loaded(spark: SparkSession, sf_dir: str, suffix: str) -> MeshSet:
    return load_meshes(_written(spark, sf_dir).where(F.col("mesh_id").endswith(f".{suffix}")), SPLIT)


FANS = "SELECT mesh_id || '.{}' AS mesh_id, CAST(face_id AS BIGINT) AS face_id, CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, CAST(c AS BIGINT) AS c FROM fans"


@query("s5_obj", f"WITH {NUMBERED} {FANS.format('obj')}", ("vertices",))
def s5_obj(spark, sf):
    return _loaded(spark, sf, "obj").faces


@query("s5_ascii_ply", f"WITH {NUMBERED} {FANS.format('ply')}", ("vertices",))
def s5_ascii_ply(spark, sf):
    return _loaded(spark, sf, "ply").faces


@query(
    "s5_stl",
    f"""WITH {NUMBERED}, whole AS (SELECT mesh_id, COUNT(*) // 3 * 3 AS used FROM numbered GROUP BY mesh_id)
        SELECT p.mesh_id || '.stl' AS mesh_id, CAST(p.n // 3 AS BIGINT) AS face_id, CAST(p.n AS BIGINT) AS a, CAST(p.n + 1 AS BIGINT) AS b,
          CAST(p.n + 2 AS BIGINT) AS c FROM numbered AS p JOIN whole AS w ON w.mesh_id = p.mesh_id WHERE p.n % 3 = 0 AND p.n < w.used""",
    ("vertices",),
)
def s5_stl(spark, sf):
    return _loaded(spark, sf, "stl").faces


@query(
    "s5_text_vertices",
    f"""WITH {NUMBERED}, whole AS (SELECT mesh_id, COUNT(*) // 3 * 3 AS used FROM numbered GROUP BY mesh_id)
        SELECT p.mesh_id || '.' || kind AS mesh_id, CAST(n AS BIGINT) AS vertex_id, CAST(CAST(x AS FLOAT) AS DOUBLE) AS x,
          CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z
        FROM numbered AS p JOIN whole AS w ON w.mesh_id = p.mesh_id, (VALUES ('obj'), ('ply'), ('stl')) AS t(kind) WHERE kind <> 'stl' OR n < used""",
    ("vertices",),
)
def s5_vertices(spark, sf):
    vertices = load_meshes(_written(spark, sf), SPLIT).vertices
    return vertices.select("mesh_id", "vertex_id", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@query(
    "s5_mesh_statuses",
    """SELECT m.mesh_id || name AS mesh_id, status FROM (SELECT DISTINCT mesh_id FROM vertices) AS m,
         (VALUES ('.obj', 'loaded'), ('.ply', 'loaded'), ('.stl', 'loaded'), ('-torn.obj', 'failed'), ('-torn.ply', 'failed'),
          ('-torn.stl', 'failed'), ('-junk.ply', 'failed'), ('-junk.stl', 'failed')) AS t(name, status)""",
    ("vertices",),
)
def s5_statuses(spark, sf):
    return load_meshes(_written(spark, sf, broken=True), SPLIT).statuses.select("mesh_id", "status")


@query(
    "s5_format_vertices",
    f"""WITH {NUMBERED} SELECT mesh_id || '.obj' AS mesh_id, COUNT(*) AS n, MAX(n) AS last FROM numbered GROUP BY mesh_id""",
    ("vertices",),
)
def s5_format(spark, sf):
    folder = register(spark) and _written(spark, sf).first()["path"].rsplit("/", 1)[0]
    rows = spark.read.format("mesh").load(folder).where(F.col("mesh_id").endswith(".obj"))
    return rows.groupBy("mesh_id").agg(F.count(F.lit(1)).alias("n"), F.max("vertex_id").alias("last"))
