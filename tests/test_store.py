from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from voxspark.plans import store as s


def generation(spark, mark, models):
    metadata = spark.createDataFrame([(m, mark) for m in models], "model_id string, mark string")
    voxels = metadata.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("chunk_rank", F.lit(0))
    return {"metadata": metadata, "voxels": voxels}


def marks(table):
    return {r.model_id: r.mark for r in table.collect()}


def test_a_reader_of_one_version_never_sees_another(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    assert s.current_version(spark, store) is None
    with pytest.raises(ValueError, match="no store"):
        s.store_table(spark, store, "metadata")
    first = s.write_generation(spark, store, generation(spark, "old", ["0012", "b", "c"]))
    before = s.store_table(spark, store, "voxels", first)
    second = s.write_generation(spark, store, generation(spark, "new", ["b", "d"]))
    assert (first.number, second.number) == (1, 2) and not first.replacing and second.replacing
    # A table of the first version, made before the second was written, and one made after it.
    for table in (before, s.store_table(spark, store, "voxels", first)):
        assert marks(table) == {"0012": "old", "b": "old", "c": "old"} and table.count() == 9
    assert marks(s.store_table(spark, store, "metadata")) == {"0012": "old", "b": "new", "c": "old", "d": "new"}
    assert s.store_table(spark, store, "voxels").count() == 12
    assert marks(s.store_table(spark, store, "voxels", model_id="b")) == {"b": "new"}
    compacted = s.compact(spark, store)
    assert len(compacted.generations) == 1 and not compacted.replacing
    assert marks(s.store_table(spark, store, "voxels")) == {"0012": "old", "b": "new", "c": "old", "d": "new"}
    assert marks(s.store_table(spark, store, "metadata", first)) == {"0012": "old", "b": "old", "c": "old"}
    third = s.write_generation(spark, store, generation(spark, "more", ["e"]))
    assert not third.replacing and len(third.generations) == 2 and s.store_table(spark, store, "voxels").count() == 15


def test_tables_that_are_not_published_are_not_seen(spark, tmp_path, monkeypatch):
    store = f"file://{tmp_path}/store"
    s.write_generation(spark, store, generation(spark, "old", ["a"]))
    publish = s._commit

    def broken(*arguments):
        raise OSError("the writer died")

    monkeypatch.setattr(s, "_commit", broken)
    with pytest.raises(OSError):
        s.write_generation(spark, store, generation(spark, "lost", ["a", "b"]))
    assert marks(s.store_table(spark, store, "voxels")) == {"a": "old"}
    monkeypatch.setattr(s, "_commit", publish)
    held = s.current_version(spark, store)
    s.write_generation(spark, store, generation(spark, "new", ["b"]))
    with pytest.raises(RuntimeError, match="another writer"):
        s._commit(spark, store, s.Version(held.number + 1, held.generations, False, held.buckets, held.schemas))
    assert marks(s.store_table(spark, store, "metadata")) == {"a": "old", "b": "new"}


def test_many_models_make_few_folders_and_one_model_reads_one_bucket(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    models = spark.range(10_000).select(F.format_string("%05d", "id").alias("model_id"), F.lit("m").alias("mark"))
    s.write_generation(spark, store, {"metadata": models, "voxels": models.withColumn("chunk_no", F.lit(0)).withColumn("chunk_rank", F.lit(0))}, buckets=16)
    (folder,) = (tmp_path / "store/metadata").glob("generation=*")
    assert len(list(folder.glob("bucket=*"))) == 16
    one = s.store_table(spark, store, "voxels", model_id="00017")
    assert one.count() == 1 and len({f.rsplit("/", 2)[1] for f in one.inputFiles()}) == 16
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_empty_tables_have_their_columns(spark, tmp_path):
    store = f"file://{tmp_path}/store"
    tables = generation(spark, "x", ["a"])
    s.write_generation(spark, store, {**tables, "lod_faces": spark.createDataFrame([], "model_id string, face_key long, a long")})
    faces = s.store_table(spark, store, "lod_faces")
    assert faces.columns == ["model_id", "face_key", "a"] and faces.count() == 0
