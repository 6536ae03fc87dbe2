"""The folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the bitmaps that are broadcast.
BITS = 1 << 26


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, set as checkpoint folder if it isn't yet. Only where neither is set
    and Spark runs in this process, as in tests, a local folder is made and set; on a cluster that is an error."""
    context = spark.sparkContext
    known = context._jsc.sc().getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None) or (known.get() if known.isDefined() else None)
    if not path:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="strataloom-")
    if not known.isDefined():
        context.setCheckpointDir(path)
    return path.rstrip("/")


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage: df as a table in the shared folder, read back. Unlike a checkpoint its size is known to the planner,
    so that joins with it broadcast it where it is small."""
    path = f"{shared_dir(df.sparkSession)}/strataloom/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that kept has made and nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_kept_at", None):
            where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def likely(df: DataFrame, on: list[str], keys: DataFrame) -> DataFrame:
    """The rows of df whose columns named may be those of a row of keys, and a few others: a filter before a join that
    would shuffle all of df. Hashes of keys are bits of a bitmap of fixed size, which is broadcast."""
    bit = F.pmod(F.xxhash64(*on), F.lit(BITS))
    part, at = F.bitmap_bucket_number(bit).alias("_part"), F.bitmap_bit_position(bit)
    bitmaps = keys.select(part, at.alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_at", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    rows = df.withColumns({"_part": F.bitmap_bucket_number(bit), "_at": at}).join(F.broadcast(bitmaps), "_part")
    return rows.filter(F.getbit(byte, F.col("_at").bitwiseAND(F.lit(7)).cast("int")) == 1).select(*df.columns)
