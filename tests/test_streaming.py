from __future__ import annotations

import json

import numpy as np

from checks.voxel_files import vxz_bytes
from voxspark.plans import prepare as prepared
from voxspark.plans.store import store_table
from voxspark.streaming.ingest import ingest
from voxspark.streaming.progress import follow_progress, latest_progress, progress_of


def cube(number):
    cells = np.array([(x, y, z) for x in range(2) for y in range(2) for z in range(2)]) + number
    return vxz_bytes(cells, np.full_like(cells, 7), np.full(len(cells), 7), chunk_size=8)[0]


def statuses(spark, store, after=-1):
    rows = spark.read.parquet(f"{store}/jobs").where(f"batch > {after}").collect()
    return sorted((r.status for r in rows)), max((r.batch for r in rows), default=after)


def test_job_states_over_triggers(spark, tmp_path, monkeypatch):
    def asked(*_):
        raise AssertionError("the store is asked what it holds")

    monkeypatch.setattr(prepared, "current_models", asked)
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()

    def run(checkpoint="checkpoint"):
        query = ingest(spark, str(source), store, str(tmp_path / checkpoint))
        query.awaitTermination(120)
        assert query.exception() is None

    for name, content in {"a": cube(1), "a2": cube(1), "b": cube(2), "junk": b"junk"}.items():
        (source / f"{name}.vxz").write_bytes(content)
    run()
    found, batch = statuses(spark, store)
    assert found == ["failed", "ready", "ready"]
    for name, content in {"a3": cube(1), "junk2": b"junk", "junk3": b"junk", "c": cube(3)}.items():
        (source / f"{name}.vxz").write_bytes(content)
    run()
    found, batch = statuses(spark, store, batch)
    assert found == ["failed", "kept", "ready"]
    run()
    assert statuses(spark, store, batch)[0] == []
    assert store_table(spark, store, "metadata").count() == 3
    # A new checkpoint learns what is ready from the statuses that are there.
    for path in source.glob("*unk*.vxz"):
        path.unlink()
    run("another")
    rows = spark.read.parquet(f"{store}/jobs").where("status = 'kept'").count()
    assert rows >= 3 and store_table(spark, store, "metadata").count() == 3


def test_progress_keeps_few_files_and_the_last_state(spark, tmp_path):
    lines, folder = tmp_path / "lines", tmp_path / "state"
    lines.mkdir()
    schema = "job string, line_no long, line string"
    told = []
    for number in range(11):
        own = [(f"job{k}", number * 10 + k, "PROGRESS " + json.dumps({"stage": f"s{number}", "fraction": number / 10})) for k in range(number % 4 + 1)]
        own.append((f"once{number}", number, 'PROGRESS {"message": "m"}'))
        told += own
        (lines / f"{number:02d}.json").write_text("\n".join(json.dumps(dict(zip(("job", "line_no", "line"), row))) for row in own))
    # Runs that stop and go on from the checkpoint, with a batch a file.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(lines))
    follow_progress(stream, str(folder), str(tmp_path / "checkpoint"), available_now=True, every=3, buckets=2).awaitTermination()
    wanted = {tuple(r) for r in latest_progress(spark.createDataFrame(told, schema)).collect()}
    assert {tuple(r) for r in progress_of(spark, str(folder)).collect()} == wanted
    full, changes = sorted(folder.glob("kind=full/batch=*")), sorted(folder.glob("kind=change/batch=*"))
    assert [p.name for p in full] == ["batch=5", "batch=8"] and len(changes) <= 6
    assert all(len(list(p.glob("*.parquet"))) <= 2 for p in full)
    # A repeated batch finds its full state written, and changes nothing.
    from voxspark.streaming import progress

    progress._compact(spark, str(folder), 8, 2)
    assert {tuple(r) for r in progress_of(spark, str(folder)).collect()} == wanted
