"""Keeping model state current from a stream of edits: the newest edit of each key wins, writes are serial and whole.

State is a log of runs, tables of the newest edits of some batches. A batch adds one run of its own edits and reads
nothing; when FANOUT runs of about one size have come together they are merged into one of the next size, so that an
edit is written again a logarithmic number of times, and there are never more than a few runs a size. Which edit of a key
is newest doesn't depend on the order in which runs are merged.

`<path>/CURRENT` names the runs that count and the last batch in them. It is replaced by one rename, after the runs are
written: a reader has the state before a batch or after it, and a batch that comes again after a restart is skipped if it
counts already, else written anew under the same names. Runs that a merge replaced are deleted a batch later, so that
readers of the manifest before it can finish. Only names in the manifest are ever read; nothing is listed.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "model_id string, id string, op string, value string, ts timestamp, event_id long"
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]
FANOUT = 4


def newest(edits: DataFrame) -> DataFrame:
    """The last edit of each key, by time and then by event id."""
    return edits.groupBy("model_id", "id").agg(F.max_by(F.struct("op", "value", "ts", "event_id"), F.struct("ts", "event_id")).alias("x")).select("model_id", "id", "x.*")


def merge(state: DataFrame, edits: DataFrame) -> DataFrame:
    """state and edits together: late edits, older than what is stored, are dropped. Deleted keys stay as marks, so that
    an edit that comes late doesn't bring them back."""
    return newest(state.unionByName(edits))


def current(state: DataFrame) -> DataFrame:
    return state.filter("op <> 'delete'").drop("op")


def manifest(spark: SparkSession, path: str) -> dict:
    """What CURRENT says: batch (-1 if there is none), runs ({name: rows}), retired (names)."""
    jvm = spark._jvm
    file = jvm.org.apache.hadoop.fs.Path(f"{path}/CURRENT")
    files = file.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(file):
        return {"batch": -1, "runs": {}, "retired": []}
    stream = files.open(file)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _publish(spark: SparkSession, path: str, state: dict) -> None:
    """Write the manifest beside CURRENT and rename it over that."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    new, place = hadoop.Path(f"{path}/_next"), hadoop.Path(f"{path}/CURRENT")
    out = new.getFileSystem(conf).create(new, True)
    try:
        out.write(json.dumps(state).encode())
    finally:
        out.close()
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    hadoop.FileContext.getFileContext(new.getFileSystem(conf).getUri(), conf).rename(new, place, how)


def _read(spark: SparkSession, path: str, runs: list[str]) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(*[f"{path}/runs/{r}" for r in runs]) if runs else spark.createDataFrame([], SCHEMA)


def _write(df: DataFrame, path: str, name: str) -> int:
    """Write a run and count its rows."""
    df.select(*COLUMNS).write.mode("overwrite").parquet(f"{path}/runs/{name}")
    return _read(df.sparkSession, path, [name]).count()


def _due(runs: dict[str, int]) -> list[str]:
    """FANOUT runs of one size or more, the smallest such size first; empty if there are none."""
    sizes: dict[int, list[str]] = {}
    for name, rows in runs.items():
        sizes.setdefault(int(math.log(max(rows, 1), FANOUT) + 1e-9), []).append(name)
    return next((sizes[s] for s in sorted(sizes) if len(sizes[s]) >= FANOUT), [])


def apply_batch(edits: DataFrame, batch_id: int, path: str, check: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Add a batch's edits to the state at path, unless it counts already."""
    spark = edits.sparkSession
    state = manifest(spark, path)
    if state["batch"] >= batch_id:
        return
    runs, retired, name = dict(state["runs"]), [], f"{batch_id}"
    rows = _write(newest(edits.select(*COLUMNS)), path, name)
    if rows:
        runs[name] = rows
    else:
        retired.append(name)
    if check is not None and rows:
        keys = _read(spark, path, [name]).select("model_id", "id")
        now = newest(_read(spark, path, list(runs)).join(keys, ["model_id", "id"], "left_semi"))
        check(current(now)).write.mode("overwrite").parquet(f"{path}-violations/v={batch_id}")
    merges = 0
    while due := _due(runs):
        merges += 1
        name = f"{batch_id}-{merges}"
        merged = _write(newest(_read(spark, path, due)), path, name)
        runs = {r: n for r, n in runs.items() if r not in due} | {name: merged}
        retired += due
    _publish(spark, path, {"batch": batch_id, "runs": runs, "retired": retired})
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for old in state["retired"]:
        files.delete(hadoop.Path(f"{path}/runs/{old}"), True)


def start(edits: DataFrame, path: str, checkpoint: str, interval: str | None = "2 seconds", check: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """edits: a stream with the columns of SCHEMA. With interval None all that is there is taken, and the query ends.
    check(state of the keys that a batch has changed) -> violations, which are written to `<path>-violations/v=<batch id>`."""
    stream = edits.writeStream.foreachBatch(lambda batch, batch_id: apply_batch(batch, batch_id, path, check)).option("checkpointLocation", checkpoint)
    return stream.trigger(availableNow=True).start() if interval is None else stream.trigger(processingTime=interval).start()


def latest(spark: SparkSession, path: str) -> DataFrame:
    """The newest edit of each key, as of the last whole batch."""
    return newest(_read(spark, path, list(manifest(spark, path)["runs"])))
