"""Exact dedup by a heavy-hitter split, in native expressions only.

Two texts are equal when their bytes agree after lower-casing A-Z; a null text counts as empty. Of equal texts
the row with the largest doc_id stays (nulls count as the smallest id; of repeated rows with that id exactly one
stays, any of them, as they don't differ in what decides).

A frequent-items sketch of the Misra-Gries family (approx_top_k_accumulate, merged in two levels) finds every
digest whose share of the rows is above about 1/tracked. Their counts and winners are then verified exactly and
broadcast: at most `heavy` rows, whatever the input. Copies of frequent texts are settled on the map side; only
the remaining digests, none of which can be hot, meet in an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, lower_ascii, shared_dir


#: Of texts with copies, so many at most are broadcast.
BROADCAST_GROUPS = 500_000


def digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the normalised text in UTF-8."""
    return F.sha2(F.encode(lower_ascii(text), "UTF-8"), 256)


def frequent_digests(digests: DataFrame, column: str, heavy: int = 256, tracked: int = 1024, groups: int = 64) -> DataFrame:
    """Candidates for the heavy hitters of `column`: at most `heavy` rows. Sketches merge in `groups` tasks before one."""
    part = digests.groupBy((F.spark_partition_id() % groups).alias("g")).agg(F.expr(f"approx_top_k_accumulate(`{column}`, {tracked})").alias("s"))
    # By a key, though there is one group: a combining task without any sketch would fail.
    whole = part.groupBy((F.col("g") < 0).alias("one")).agg(F.expr(f"approx_top_k_combine(s, {tracked})").alias("s"))
    items = whole.select(F.explode(F.expr(f"approx_top_k_estimate(s, {heavy})")).alias("x"))
    return items.filter("x.count > 1").select(F.col("x.item").alias(column))


def duplicate_groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, tracked: int = 1024) -> DataFrame:
    """A row per document: doc_id, keep_id, group_size, kept, text_sha256. An empty table gives an empty result."""
    shared_dir(docs.sparkSession)
    digests = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest(F.col(text_col)).alias("text_sha256")).withColumn("row", F.monotonically_increasing_id()).checkpoint()
    rank = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row")
    winners = (
        digests.join(F.broadcast(frequent_digests(digests, "text_sha256", heavy, tracked)), "text_sha256", "left_semi")
        .groupBy("text_sha256").agg(F.max(rank).alias("best"), F.count("*").alias("group_size")).checkpoint()
    )
    hot = digests.join(F.broadcast(winners), "text_sha256")
    same = Window.partitionBy("text_sha256")
    cold = digests.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti").withColumns({"best": F.max(rank).over(same), "group_size": F.count("*").over(same)})
    return hot.unionByName(cold).select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", heavy: int = 256, tracked: int = 1024) -> DataFrame:
    """The rows of docs that stay, all columns as they were (also such as clash with names used here).

    Digests and ids alone are shuffled. Of texts that have copies, digest and best id are joined back to the rows: by a
    broadcast of at most BROADCAST_GROUPS groups, of more by a shuffle. Rows that repeat text and id of a winner are
    combined before they are shuffled."""
    shared_dir(docs.sparkSession)
    sha, group = free_name(docs, "text_sha256", "group")
    digests = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("sha")).checkpoint()

    def groups(rows: DataFrame) -> DataFrame:
        """sha, the best id with the number of its rows, for texts that occur twice or more."""
        by_id = rows.groupBy("sha", "id").agg(F.count("*").alias("rows"))
        top = F.max(F.struct(F.col("id").isNotNull().alias("known"), "id", "rows")).alias("best")
        return by_id.groupBy("sha").agg(top, F.sum("rows").alias("size")).filter("size > 1").drop("size").checkpoint()

    hot = groups(digests.join(F.broadcast(frequent_digests(digests, "sha", heavy, tracked)), "sha", "left_semi"))
    cold = groups(digests.join(F.broadcast(hot.select("sha")), "sha", "left_anti"))

    def settled(rows: DataFrame, found: DataFrame) -> DataFrame:
        """Without the losers of the groups found; winners get their group."""
        own = found.select(F.struct("*").alias(group))
        rows = rows.join(own, rows[sha] == own[f"{group}.sha"], "left")
        return rows.filter(F.col(group).isNull() | F.col(id_col).eqNullSafe(F.col(f"{group}.best.id")))

    rows = docs.withColumn(sha, digest(F.col(text_col)))
    if cold.count() <= BROADCAST_GROUPS:
        rows = settled(rows, F.broadcast(hot.unionByName(cold)))
    else:
        rows = settled(settled(rows, F.broadcast(hot)).drop(group), cold)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if not hot.unionByName(cold).filter("best.rows > 1").limit(1).count():
        return rows.select(*columns)
    repeated = F.coalesce(F.col(f"{group}.best.rows") > 1, F.lit(False))
    once = rows.filter(repeated).groupBy(sha).agg(F.first(F.struct(*columns)).alias(group)).select(f"{group}.*")
    return rows.filter(~repeated).select(*columns).unionByName(once)
