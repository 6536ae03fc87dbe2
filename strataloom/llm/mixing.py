"""Mixing sources to target weights by hierarchical budgeting.

Sources form a tree domain - language - source. A budget of tokens goes down from the root: siblings share what their
parent has in proportion to their weights, none more than it can supply (its tokens times max_epochs). What a node
can't use goes to its siblings by their weights; only what all siblings together can't use stays unspent at the
parent, whose own siblings have taken it before, since capacities are added up the tree first. Shares are rounded
down to whole tokens. Windows run over the nodes of the tree alone (over all domains, over the children of a node) and over
the hash ranges of a leaf: what they bring into one task is bounded by the tree and by 4,096 ranges, not by the rows.

A leaf draws whole epochs first, then a token-prefix of the next one: its documents in the order of a hash of seed,
epoch and id, as long as the running token count stays within what is left. The running count is distributed: token
sums of 4,096 hash ranges a leaf give the range in which the cut falls, and only that range is ordered row by row, as
order key, id and tokens. What it gives is the last row that is drawn; no row carries its text through a shuffle.

Tokens are words here, unless a column is named. Null levels count as an empty name; a null id hashes as empty text;
leaves with weight 0 or without tokens draw nothing. Repeated rows count and are drawn as often as they occur; at the cut
they are drawn or left together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, free_name, shared_dir

LEVELS = ("domain", "lang", "source")
#: Leaves up to this many are broadcast; beyond, the join is a shuffle with AQE's splitting of skewed parts.
BROADCAST_LEAVES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _weight(level: str, weights: Mapping[str, Mapping[str, int]]) -> Column:
    """The weight of a node among its siblings; 1 where none is given."""
    given = weights.get(level) or {}
    if any(w < 0 for w in given.values()):
        raise ValueError("weights can't be negative")
    out = F.lit(1)
    for name, w in given.items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def fill(nodes: DataFrame, parent: Sequence[str], key: str) -> DataFrame:
    """nodes(parent..., key, capacity, weight, budget of the parent) -> the same with budget the node's own.

    The level up to which siblings fill is found in closed form: in order of capacity over weight, a node is full
    if an equal share of what the fuller ones leave would exceed it."""
    per = F.col("capacity") / F.col("weight")
    before = Window.partitionBy(*parent).orderBy(per, key).rowsBetween(Window.unboundedPreceding, -1)
    family = Window.partitionBy(*parent)
    left = F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))
    open_weight = F.sum("weight").over(family) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    weighed = nodes.filter("weight > 0").withColumn("_level", left / open_weight).withColumn("_full", F.col("_level") > per)
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(family)
    own = F.when(F.col("_full"), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.floor(F.greatest(level, F.lit(0.0)) * F.col("weight"))))
    return weighed.withColumn("_own", own.cast("long")).withColumn("budget", F.col("_own")).drop("_level", "_full", "_own")


def leaf_budgets(leaves: DataFrame, budget: int | Column, *, levels: Sequence[str] = LEVELS, weights: Mapping[str, Mapping[str, int]] | None = None, max_epochs: int = 1) -> DataFrame:
    """leaves(levels..., tokens) -> levels..., tokens, budget, full_epochs, rest (tokens of the epoch after those)."""
    weights, above = weights or {}, None
    for depth in range(1, len(levels) + 1):
        parent, key = list(levels[: depth - 1]), levels[depth - 1]
        nodes = leaves.groupBy(*levels[:depth]).agg((F.sum("tokens") * max_epochs).alias("capacity")).withColumn("weight", _weight(key, weights))
        if above is None:
            nodes = nodes.withColumn("budget", (budget if isinstance(budget, Column) else F.lit(budget)).cast("long"))
        else:
            nodes = nodes.join(above.select(*parent, "budget"), parent)
        above = fill(nodes, parent, key)
    out = leaves.join(above.select(*levels, "budget"), list(levels))
    epochs = F.when(F.col("tokens") > 0, F.floor(F.col("budget") / F.col("tokens"))).otherwise(0).cast("long")
    return out.withColumn("full_epochs", epochs).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))


def _named(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit("")


def mix(docs: DataFrame, *, domain: Column | None = None, fraction: float | None = None, budget: int | None = None, weights: Mapping[str, Mapping[str, int]] | None = None, max_epochs: int = 1, seed: int = 1, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None) -> DataFrame:
    """The drawn rows: all columns of docs as they were, then `mix`, a struct of domain, lang, source, tokens, epoch,
    order_key (the seeded order within the leaf and epoch) and leaf_budget. The name gets `_` in front if docs has it.

    Either `budget` tokens are drawn, or `fraction` of all tokens that docs have."""
    shared_dir(docs.sparkSession)
    leaf, info, (mixed,) = F.struct((domain if domain is not None else _named("domain", docs)).alias("domain"), _named("lang", docs).alias("lang"), _named("source", docs).alias("source")), ["tokens", "budget", "full_epochs", "rest"], free_name(docs, "mix")
    tokens = tokens if tokens is not None else word_count(F.col(text_col))
    name = F.coalesce(F.col("id").cast("string"), F.lit(""))
    order = lambda epoch: F.md5(F.encode(F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), name), "UTF-8"))
    narrow = docs.select(leaf.alias("leaf"), F.col(id_col).alias("id"), tokens.alias("n")).select("leaf.*", "id", "n").checkpoint()
    leaves = narrow.groupBy(*LEVELS).agg(F.sum("n").alias("tokens")).checkpoint()
    if budget is None:
        total = leaves.agg(F.sum("tokens").alias("t")).first()["t"] or 0
        budget = int((fraction if fraction is not None else 1.0) * total)
    plan = leaf_budgets(leaves, budget, weights=weights, max_epochs=max_epochs).checkpoint()
    small = plan.count() <= BROADCAST_LEAVES
    hint = F.broadcast if small else (lambda x: x)
    # Token sums of the hash ranges of each leaf's last, partial epoch.
    part = narrow.join(hint(plan.filter("rest > 0").select(*LEVELS, "full_epochs", "rest")), list(LEVELS))
    ranges = part.groupBy(*LEVELS, "rest", F.substring(order(F.col("full_epochs") + 1), 1, 3).alias("range")).agg(F.sum("n").alias("n"))
    to = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cut = ranges.withColumn("upto", F.sum("n").over(to)).filter("upto > rest").groupBy(*LEVELS).agg(F.min_by(F.struct("range", (F.col("upto") - F.col("n")).alias("before")), "range").alias("cut"))
    cuts = plan.join(cut, list(LEVELS), "left").select(*LEVELS, *info, F.col("cut.range").alias("range"), F.col("cut.before").alias("before")).checkpoint()
    # The last row drawn of the range in which the cut falls.
    place = lambda key: F.struct(key.alias("key"), "id", "n")
    near = narrow.join(hint(cuts.filter("rest > 0 AND range IS NOT NULL")), list(LEVELS)).withColumn("place", place(order(F.col("full_epochs") + 1))).filter(F.substring("place.key", 1, 3) == F.col("range"))
    run = Window.partitionBy(*LEVELS).orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    last = near.withColumn("upto", F.col("before") + F.sum("n").over(run)).filter("upto <= rest").groupBy(*LEVELS).agg(F.max("place").alias("last"))
    cuts = cuts.join(last, list(LEVELS), "left").select(F.struct("*").alias("p")).checkpoint()
    # Whole rows: what is drawn needs no shuffle.
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), leaf.alias("leaf"), F.col(id_col).alias("id"), tokens.alias("n"))
    same = F.col("leaf.domain") == F.col("p.domain")
    for x in LEVELS[1:]:
        same &= F.col(f"leaf.{x}") == F.col(f"p.{x}")
    held = held.join(hint(cuts), same).withColumn("key", order(F.col("p.full_epochs") + 1)).withColumn("range", F.substring("key", 1, 3))
    whole = held.filter("p.full_epochs > 0").withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), F.col("p.full_epochs")))).withColumn("key", order(F.col("epoch")))
    partial = held.filter("p.rest > 0").withColumn("epoch", F.col("p.full_epochs") + 1)
    partial = partial.filter(F.col("p.range").isNull() | (F.col("range") < F.col("p.range")) | ((F.col("range") == F.col("p.range")) & (place(F.col("key")) <= F.col("p.last"))))
    out = whole.unionByName(partial)
    return out.select("row.*", F.struct("leaf.domain", "leaf.lang", "leaf.source", F.col("n").alias("tokens"), "epoch", F.col("key").alias("order_key"), F.col("p.budget").alias("leaf_budget")).alias(mixed))
