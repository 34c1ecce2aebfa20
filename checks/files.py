"""Round trips through voxel files that tasks write from the whole derived tables, broken files among them."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import derived as d
from checks.registry import query
from checks.topology import QUADS
from checks.voxel_files import vxz_bytes
from voxspark.operators.cache import fetch_counts, fetched
from voxspark.plans.decode import decode_corpus
from voxspark.session import checkpoint_dir, settle
from voxspark.sources import register
from voxspark.sources.files import resolve
from voxspark.sources.vxz import corpus_files, decode, listed_files, read_directory, read_headers
from voxspark.streaming.ingest import ingest

CHUNK = 8
LAYOUTS, CODECS = ("all", "as_is", "none"), ("none", "deflate", "lzma", "zstd")


def _save(path: str, content: bytes) -> None:
    filesystem, inner = resolve(path)
    filesystem.create_dir(inner.rsplit("/", 1)[0], recursive=True)
    with filesystem.open_output_stream(inner) as stream:
        stream.write(content)


def _written(spark: SparkSession, sf_dir: str, broken: bool) -> str:
    """A folder with a file per model; with ``broken``, also files of four kinds that cannot be decoded."""
    register(spark)
    folder = f"{checkpoint_dir(spark).rstrip('/')}/voxspark-{uuid.uuid4().hex}"

    def write(rows: pd.DataFrame) -> pd.DataFrame:
        model = rows["model_id"].iloc[0]
        number = int(model[1:])
        layout, codec = LAYOUTS[(number + ord(model[0])) % len(LAYOUTS)], CODECS[number % len(CODECS)]
        optional = [None if rows[c].isna().any() else rows[c].to_numpy(int) for c in ("ovoxel_type", "qef_rank")]
        arguments = (rows[["x", "y", "z"]].to_numpy(int), rows[["dx", "dy", "dz"]].to_numpy(int), rows["flags"].to_numpy(int), *optional)
        content, _ = vxz_bytes(*arguments, chunk_size=CHUNK, compression=codec, layout=layout)
        files = {model: content}
        if broken:
            files["torn-" + model] = content[:-1]
            files["hollow-" + model] = vxz_bytes(*arguments, chunk_size=CHUNK, changes={"num_voxel": len(rows) + 1})[0]
            files["junk-" + model] = b"junk of " + model.encode()
            files["huge-" + model] = vxz_bytes(*arguments, chunk_size=CHUNK, changes={"num_voxel": 1 << 70})[0]
        for name, data in files.items():
            _save(f"{folder}/{name}.vxz", data)
        return pd.DataFrame({"model_id": list(files)})

    voxels = d.voxels(spark, sf_dir)
    voxels.groupBy("model_id").applyInPandas(write, "model_id string").write.format("noop").mode("overwrite").save()
    return folder


@query(
    "s3_vxz_voxels",
    """SELECT model_id, x, y, z, dx, dy, dz, flags, ovoxel_type, qef_rank,
         ROW_NUMBER() OVER (PARTITION BY model_id, chunk_no ORDER BY (x & 4) * 64 + (x & 2) * 16 + (x & 1) * 4
           + (y & 4) * 32 + (y & 2) * 8 + (y & 1) * 2 + (z & 4) * 16 + (z & 2) * 4 + (z & 1)) - 1 AS chunk_rank
       FROM chunked""",
    ("chunked",),
)
def s3(spark, sf):
    return spark.read.format("vxz").load(_written(spark, sf, False)).drop("chunk_no")


@query(
    "f1_file_slice",
    """SELECT 'z' AS axis, model_id, x, y, z, dx, dy, dz, flags FROM voxels WHERE z = 17
       UNION ALL SELECT 'x', model_id, x, y, z, dx, dy, dz, flags FROM voxels WHERE x = 3 AND y >= 4 AND y < 13""",
    ("voxels",),
)
def f1_files(spark, sf) -> DataFrame:
    files = corpus_files(spark, _written(spark, sf, False))
    directory = settle(read_directory(files))
    boxes = {"z": {"z": (17, 18)}, "x": {"x": (3, 4), "y": (4, 13)}}
    parts = [decode(files, directory, box).where("error IS NULL").withColumn("axis", F.lit(axis)) for axis, box in boxes.items()]
    return parts[0].unionByName(parts[1]).select("axis", "model_id", "x", "y", "z", "dx", "dy", "dz", "flags")


@query(
    "s2_vxz_headers",
    f"""SELECT model_id, COUNT(*) AS num_voxel, {CHUNK} AS chunk_size, COUNT(DISTINCT chunk_no) AS chunk_count,
        2 + MAX(CASE WHEN ovoxel_type IS NULL THEN 0 ELSE 1 END) + MAX(CASE WHEN qef_rank IS NULL THEN 0 ELSE 1 END) AS attributes,
        false AS failed FROM chunked GROUP BY model_id
        UNION ALL SELECT DISTINCT kind || model_id, NULL, NULL, NULL, NULL, true FROM chunked, (VALUES ('junk-'), ('huge-')) AS t(kind)
        UNION ALL SELECT kind || model_id, COUNT(*) + more, {CHUNK}, COUNT(DISTINCT chunk_no),
        2 + MAX(CASE WHEN ovoxel_type IS NULL THEN 0 ELSE 1 END) + MAX(CASE WHEN qef_rank IS NULL THEN 0 ELSE 1 END), false
        FROM chunked, (VALUES ('torn-', 0), ('hollow-', 1)) AS t(kind, more) GROUP BY model_id, kind, more""",
    ("chunked",),
)
def s2(spark, sf):
    headers = read_headers(corpus_files(spark, _written(spark, sf, True)))
    known = F.when(F.col("attributes").isNotNull(), F.size("attributes"))
    return headers.select("model_id", "num_voxel", "chunk_size", "chunk_count", known.alias("attributes"), F.col("error").isNotNull().alias("failed"))


STATUSES = (
    QUADS
    + """,
statuses AS (
  SELECT model_id, CASE WHEN model_id IN (SELECT model_id FROM quads) THEN 'good' ELSE 'failed' END AS status
  FROM (SELECT DISTINCT model_id FROM voxels) AS m
  UNION ALL SELECT kind || model_id, 'failed' FROM (SELECT DISTINCT model_id FROM voxels) AS m,
    (VALUES ('torn-'), ('hollow-'), ('junk-'), ('huge-')) AS t(kind))"""
)


@query(
    "a13_decode_statuses",
    f"WITH {STATUSES} SELECT model_id, CASE status WHEN 'good' THEN 'decoded' ELSE status END AS status FROM statuses",
    ("voxels",),
)
def a13(spark, sf) -> DataFrame:
    source = _written(spark, sf, True)
    return decode_corpus(corpus_files(spark, source), source + "-ply").select("model_id", "status")


@query(
    "t1_ingest_statuses",
    f"WITH {STATUSES} SELECT CASE status WHEN 'good' THEN 'ready' ELSE status END AS status, COUNT(*) AS files FROM statuses GROUP BY 1",
    ("voxels",),
)
def t1(spark, sf) -> DataFrame:
    source = _written(spark, sf, True)
    ingest(spark, source, source + "-store", source + "-checkpoint").awaitTermination()
    return spark.read.parquet(source + "-store/jobs").groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@query(
    "t1_job_states",
    f"""WITH {STATUSES}
       SELECT 1 AS round, CASE status WHEN 'good' THEN 'ready' ELSE status END AS status, COUNT(*) AS contents FROM statuses GROUP BY 2
       UNION ALL SELECT 2, CASE status WHEN 'good' THEN 'kept' ELSE status END, COUNT(*) FROM statuses GROUP BY 2""",
    ("voxels",),
)
def t1_states(spark, sf) -> DataFrame:
    """All files, and in a second run two copies of each: ready contents are kept, failed ones are tried again, once each."""
    source = _written(spark, sf, True)
    arguments = spark, source, source + "-store", source + "-checkpoint"
    ingest(*arguments).awaitTermination()
    first = spark.read.parquet(source + "-store/jobs").agg(F.max("batch")).first()[0]

    def copy(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                filesystem, inner = resolve(path)
                with filesystem.open_input_stream(inner) as stream:
                    content = stream.read()
                for again in ("second", "third"):
                    _save(path.removesuffix(".vxz") + f"-{again}.vxz", content)
            yield batch

    settle(corpus_files(spark, source).select("path")).mapInArrow(copy, "path string").write.format("noop").mode("overwrite").save()
    ingest(*arguments).awaitTermination()
    number = F.when(F.col("batch") <= first, 1).otherwise(2).alias("round")
    return spark.read.parquet(source + "-store/jobs").groupBy(number, "status").agg(F.count(F.lit(1)).alias("contents"))


@query(
    "s1_listed_models",
    """WITH m AS (SELECT DISTINCT model_id FROM voxels)
       SELECT model_id, CASE WHEN model_id LIKE 'R%' THEN 'duplicate stem' END AS problem, kind
       FROM m, (VALUES ('relative'), ('absolute')) AS t(kind) WHERE kind = 'relative' OR model_id LIKE 'R%'
       UNION ALL SELECT model_id || '-note', 'not a .vxz path', 'relative' FROM m""",
    ("voxels",),
)
def s1(spark, sf) -> DataFrame:
    folder = f"{checkpoint_dir(spark).rstrip('/')}/voxspark-{uuid.uuid4().hex}"
    model = F.col("model_id")
    entries = d.voxels(spark, sf).select("model_id").distinct().select(
        F.explode(
            F.array_compact(
                F.array(
                    F.concat(F.lit("  in/"), model, F.lit(".vxz # first")),
                    F.when(model.startswith("R"), F.concat(F.lit("/data/"), model, F.lit(".VXZ"))),
                    F.concat(F.lit("in/"), model, F.lit("-note.txt")),
                    F.concat(F.lit("# "), model),
                )
            )
        ).alias("value")
    )
    entries.write.text(folder)
    kind = F.when(F.col("path").startswith("/data/"), "absolute").when(F.col("path").startswith("/root/in/"), "relative").alias("kind")
    return listed_files(spark, folder, "/root").select("model_id", "problem", kind)


@query(
    "a14_fetch_outcome",
    """SELECT COUNT(*) AS succeeded, COUNT(*) AS failed FROM (SELECT DISTINCT model_id FROM voxels) AS m""",
    ("voxels",),
)
def a14(spark, sf) -> DataFrame:
    present = corpus_files(spark, _written(spark, sf, False)).select("path", "length")
    missing = present.withColumn("path", F.concat("path", F.lit(".missing")))
    return fetch_counts(fetched(present.unionByName(missing)))
