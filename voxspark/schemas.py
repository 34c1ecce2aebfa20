"""Schemas of the tables that flow between sources, operators and sinks."""

from __future__ import annotations

from pyspark.sql import types as T

VOXELS = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("chunk_no", T.IntegerType(), False),
        T.StructField("chunk_rank", T.IntegerType(), False),
        T.StructField("x", T.IntegerType(), False),
        T.StructField("y", T.IntegerType(), False),
        T.StructField("z", T.IntegerType(), False),
        T.StructField("dx", T.ShortType(), False),
        T.StructField("dy", T.ShortType(), False),
        T.StructField("dz", T.ShortType(), False),
        T.StructField("flags", T.ShortType(), False),
        T.StructField("ovoxel_type", T.ShortType(), True),
        T.StructField("qef_rank", T.ShortType(), True),
    ]
)

VXZ_HEADERS = T.StructType(
    [
        T.StructField("model_id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("binary_start", T.LongType(), True),
        T.StructField("num_voxel", T.LongType(), True),
        T.StructField("chunk_size", T.IntegerType(), True),
        T.StructField("filter", T.StringType(), True),
        T.StructField("compression", T.StringType(), True),
        T.StructField("compression_level", T.IntegerType(), True),
        T.StructField("attr_interleave", T.StringType(), True),
        T.StructField(
            "attributes",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("channels", T.IntegerType()),
                    ]
                )
            ),
            True,
        ),
        T.StructField("chunk_count", T.IntegerType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

#: The header of a file (chunk_no is NULL) and its chunks with all that reading one takes.
VXZ_DIRECTORY = T.StructType(
    [
        *VXZ_HEADERS.fields,
        T.StructField("chunk_no", T.IntegerType(), True),
        T.StructField("origin", T.ArrayType(T.IntegerType()), True),
        T.StructField(
            "streams",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("name", T.StringType()),
                        T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()),
                    ]
                )
            ),
            True,
        ),
    ]
)

#: Entries of folder trees; ``walked`` marks folders whose own entries are listed next.
LISTING = T.StructType(
    [
        T.StructField("root", T.StringType(), True),
        T.StructField("dir", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("path", T.StringType(), True),
        T.StructField("type", T.StringType(), False),
        T.StructField("size", T.LongType(), True),
        T.StructField("mtime_ms", T.LongType(), True),
        T.StructField("walked", T.BooleanType(), False),
        T.StructField("error", T.StringType(), True),
    ]
)

VOLUMES = T.StructType(
    [
        T.StructField("volume_id", T.StringType(), False),
        T.StructField("name", T.StringType(), False),
        T.StructField("nx", T.IntegerType(), True),
        T.StructField("ny", T.IntegerType(), True),
        T.StructField("nz", T.IntegerType(), True),
        T.StructField("dtype", T.StringType(), True),
        T.StructField("fortran_order", T.BooleanType(), True),
        T.StructField("visualization", T.StringType(), True),
        T.StructField("error", T.StringType(), True),
    ]
)

#: Listed volume files: what reading their cells takes.
VOLUME_FILES = T.StructType(
    [
        *VOLUMES.fields,
        T.StructField("path", T.StringType(), False),
        T.StructField("size", T.LongType(), True),
        T.StructField("data_offset", T.LongType(), True),
    ]
)

VOLUME_CELLS = T.StructType(
    [
        T.StructField("volume_id", T.StringType(), False),
        T.StructField("i", T.IntegerType(), False),
        T.StructField("j", T.IntegerType(), False),
        T.StructField("k", T.IntegerType(), False),
        T.StructField("value", T.DoubleType(), False),
    ]
)

MESH_VERTICES = T.StructType(
    [
        T.StructField("mesh_id", T.StringType(), False),
        T.StructField("vertex_id", T.LongType(), False),
        T.StructField("x", T.FloatType(), False),
        T.StructField("y", T.FloatType(), False),
        T.StructField("z", T.FloatType(), False),
    ]
)

MESH_FACES = T.StructType(
    [
        T.StructField("mesh_id", T.StringType(), False),
        T.StructField("face_id", T.LongType(), False),
        T.StructField("a", T.LongType(), False),
        T.StructField("b", T.LongType(), False),
        T.StructField("c", T.LongType(), False),
    ]
)

MESHES = T.StructType(
    [
        T.StructField("mesh_id", T.StringType(), False),
        T.StructField("size", T.LongType(), False),
        T.StructField("error", T.StringType(), True),
    ]
)
