"""The log-structured state: equal to the newest edits whatever the batches, few folders, restarts in mid-batch."""

import datetime
import os
import random

import pytest

from strataloom.streaming import upkeep

T0 = datetime.datetime(2024, 1, 1)


def edits(seed, batches, rows=20, keys=60):
    rnd = random.Random(seed)
    return [[("m", f"k{rnd.randrange(keys)}", rnd.choice(["put", "put", "put", "delete"]), f"v{b}.{i}", T0 + datetime.timedelta(seconds=rnd.randrange(100) + 10 * b), 1000 * b + i) for i in range(rows if b % 7 else 1)] for b in range(batches)]


def expected(batches):
    last = {}
    for row in (r for b in batches for r in b):
        if row[1] not in last or row[4:] > last[row[1]][4:]:
            last[row[1]] = row
    return {k: r[3] for k, r in last.items() if r[2] != "delete"}


def state(spark, path):
    return {r.id: r.value for r in upkeep.current(upkeep.latest(spark, path)).collect()}


def test_many_batches_keep_few_folders(spark, tmp_path):
    path, batches, counts = f"{tmp_path}/state", edits(1, 40), []
    for i, rows in enumerate(batches):
        upkeep.apply_batch(spark.createDataFrame(rows, upkeep.SCHEMA).coalesce(1), i, path)
        counts.append(len(os.listdir(f"{path}/runs")))
    assert state(spark, path) == expected(batches)
    assert max(counts) <= 16 and sorted(os.listdir(path)) == [".CURRENT.crc", "CURRENT", "runs"]
    manifest = upkeep.manifest(spark, path)
    assert manifest["batch"] == 39 and set(os.listdir(f"{path}/runs")) == set(manifest["runs"]) | set(manifest["retired"])
    upkeep.apply_batch(spark.createDataFrame(batches[0][:1], upkeep.SCHEMA), 39, path)  # counts already
    assert upkeep.manifest(spark, path) == manifest


def test_a_merge_writes_only_what_is_due():
    assert upkeep._due({"a": 100, "b": 3, "c": 2, "d": 1}) == []
    assert upkeep._due({"a": 100, "b": 3, "c": 2, "d": 1, "e": 2}) == ["b", "c", "d", "e"]
    assert upkeep._due({"a": 70, "b": 80, "c": 90, "d": 100, "e": 1}) == ["a", "b", "c", "d"]
    assert upkeep._due({"a": 0}) == []


def test_restart_in_mid_batch(spark, tmp_path):
    """The stream fails after a batch's run is written and before it counts; the next start takes it again."""
    batches = edits(2, 12)
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, upkeep.SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in/{i:02}")
    for i in range(len(batches)):
        os.utime(next(f"{tmp_path}/in/{i:02}/{f}" for f in os.listdir(f"{tmp_path}/in/{i:02}") if f.endswith(".parquet")), (i, i))
    path, failed = f"{tmp_path}/state", []

    def check(now):
        if len(failed) < 3 and upkeep.manifest(spark, path)["batch"] in (2, 5, 8) and upkeep.manifest(spark, path)["batch"] not in failed:
            failed.append(upkeep.manifest(spark, path)["batch"])
            raise RuntimeError("lost")
        return now.filter("value LIKE '%.3'").select("model_id", "id")

    def run():
        stream = spark.readStream.schema(upkeep.SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        upkeep.start(stream, path, f"{tmp_path}/progress", interval=None, check=check).awaitTermination()

    for _ in range(3):
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    assert failed == [2, 5, 8] and upkeep.manifest(spark, path)["batch"] == 11
    assert state(spark, path) == expected(batches)
    assert spark.read.parquet(f"{path}-violations").count() > 0


def test_empty_batches_and_no_state(spark, tmp_path):
    path = f"{tmp_path}/none"
    assert state(spark, path) == {}
    upkeep.apply_batch(spark.createDataFrame([], upkeep.SCHEMA), 0, path)
    assert state(spark, path) == {} and upkeep.manifest(spark, path)["batch"] == 0
    upkeep.apply_batch(spark.createDataFrame([("m", "k", "put", "v", T0, 1)], upkeep.SCHEMA), 1, path)
    assert state(spark, path) == {"k": "v"}
