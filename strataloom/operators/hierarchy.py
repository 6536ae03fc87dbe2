"""Ancestors, descendants, paths and cycles of elements in a parent hierarchy, for any number of models at once.

Elements that are somebody's parent are few beside all elements. What is asked of their ways to the top is found first, by
pointer doubling: depth d takes log2(d) rounds. All elements then join their parent's row once. `nearest` keeps of a way
its nearest stops alone (visible, system, to be deleted), in narrow rows at any depth; `chains` keeps all of it as an
array, for results that hold whole ways (paths, closure, order). An element with very many children is a skewed key of
that one join, which adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.durable import discard, kept

KEY = ["model_id", "id"]
#: A table of ids up to this many rows is broadcast; its size is checked first.
BROADCAST_IDS = 100_000


def last_by_id(elements: DataFrame, *columns: str) -> DataFrame:
    """One row per (model, id): of equal ids the last in document order counts. An empty parent id is no parent."""
    picked = [c for c in columns if c not in KEY]
    row = F.max_by(F.struct(*picked), "ord").alias("row")
    return elements.groupBy(*KEY).agg(row).select(*KEY, *[(F.nullif(F.col(f"row.{c}"), F.lit("")) if c == "parent_id" else F.col(f"row.{c}")).alias(c) for c in picked])


def parents(elements: DataFrame) -> DataFrame:
    return last_by_id(elements, "parent_id")


def chains(elements: DataFrame, *columns: str, marked: DataFrame | None = None, own: tuple[str, ...] = (), rounds: int = 64) -> DataFrame:
    """(model_id, id, path, loop, and the columns in own of the element itself): path is the element and its ancestors up to the top, as structs of id, found (false for a
    parent that doesn't exist, which ends the way), the columns named, and is_marked (whether the id is among
    marked(model_id, id)). On a cycle everything stands once, and loop is the id at which the way meets itself: the
    element's own if it is on the cycle, another's if it is below one."""
    up = last_by_id(elements, "parent_id", *columns, *own).withColumn("found", F.lit(True))
    if marked is not None:
        ids = kept(marked.select(*KEY).distinct().withColumn("is_marked", F.lit(True)))
        few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    with_marks = lambda df: df.join(few, KEY, "left").withColumn("is_marked", F.col("is_marked").isNotNull()) if marked is not None else df.withColumn("is_marked", F.lit(False))
    up = kept(with_marks(up))
    node = F.struct("id", "found", "is_marked", *columns)
    # Ways of parents, those that don't exist among them.
    inner = up.filter("parent_id IS NOT NULL").select("model_id", F.col("parent_id").alias("id")).distinct()
    known = inner.join(up, KEY)
    lost = with_marks(inner.join(up, KEY, "left_anti").withColumns({"parent_id": F.lit(None).cast("string"), "found": F.lit(False)} | {c: F.lit(None).cast(up.schema[c].dataType) for c in (*columns, *own)}))
    way = kept(known.select(*up.columns).unionByName(lost.select(*up.columns)).select(*KEY, F.array(node).alias("path"), F.col("parent_id").alias("next"), F.lit(None).cast("string").alias("loop")))
    for _ in range(rounds):
        if not way.filter("next IS NOT NULL").limit(1).count():
            break
        onward = way.select("model_id", F.col("id").alias("next"), F.col("path").alias("tail"), F.col("next").alias("after"), F.col("loop").alias("tail_loop"))
        both = way.join(onward, ["model_id", "next"], "left")
        again = F.filter("tail", lambda x: F.array_contains(F.col("seen"), x["id"]))
        both = both.withColumn("seen", F.transform("path", lambda x: x["id"])).withColumn("again", again)
        met = F.col("tail").isNotNull() & (F.size("again") > 0)
        path = F.when(F.col("tail").isNull(), F.col("path")).otherwise(F.concat("path", F.filter("tail", lambda x: ~F.array_contains(F.col("seen"), x["id"]))))
        before, way = way, kept(both.select(*KEY, path.alias("path"), F.when(~met, F.col("after")).alias("next"), F.when(met, F.col("again")[0]["id"]).otherwise(F.coalesce("loop", "tail_loop")).alias("loop")))
        discard(before)
    else:
        raise RuntimeError(f"ways to the top don't end in {rounds} rounds")
    above = way.select("model_id", F.col("id").alias("parent_id"), F.col("path").alias("above"), F.col("loop").alias("above_loop"))
    rows = up.join(above, ["model_id", "parent_id"], "left")
    itself = F.col("above").isNotNull() & F.exists("above", lambda x: x["id"] == F.col("id"))
    path = F.when(F.col("above").isNull(), F.array(node)).otherwise(F.concat(F.array(node), F.filter("above", lambda x: x["id"] != F.col("id"))))
    return rows.select(*KEY, path.alias("path"), F.when(itself, F.col("id")).otherwise(F.col("above_loop")).alias("loop"), *own)


def _jumped(ways: DataFrame, values: dict[str, Callable[[Column, Column], Column]], summed: tuple[str, ...] = ()) -> DataFrame:
    """ways(model_id, id, next, values) of the elements that are somebody's parent, each value joined by its function with
    that of what lies further up, for all of the way. next is where the way goes on from there: null at its end, else
    on a cycle. Each round doubles what a row has seen, so that a way of d steps takes log2(d) rounds; rows stay narrow.
    Columns in summed go the other way: each ends as the sum over a row and all rows below it (of rows that reach no cycle).
    The table given is deleted if there is a round.

    Ways that end have ended when a round leaves as many open as before, since of a longer one some part would have ended
    in it; the open ones then all lead into cycles, and have gone all round when they have seen as many elements as are
    open."""
    seen, before = 1, -1
    while (left := ways.filter("next IS NOT NULL").count()) and not (left == before and seen >= left):
        onward = ways.select("model_id", F.col("id").alias("next"), F.col("next").alias("after"), *[F.col(v).alias(f"{v}_after") for v in values])
        both = ways.join(onward, ["model_id", "next"], "left")
        if summed:
            below = ways.filter("next IS NOT NULL").groupBy("model_id", F.col("next").alias("id")).agg(*[F.sum(v).alias(f"{v}_below") for v in summed])
            both = both.join(below, KEY, "left")
        sums = [(F.col(v) + F.coalesce(f"{v}_below", F.lit(0))).alias(v) for v in summed]
        done, ways = ways, kept(both.select(*KEY, F.col("after").alias("next"), *[join(F.col(v), F.col(f"{v}_after")).alias(v) for v, join in values.items()], *sums))
        discard(done)
        seen, before = 2 * seen, left
    return ways


def nearest(elements: DataFrame, stops: dict[str, DataFrame | Column], *columns: str, marked: DataFrame | None = None, beside: DataFrame | None = None, merge: dict[str, Callable[[Column, Column], Column]] | None = None, itself: bool = True) -> DataFrame:
    """(model_id, id, and for each of stops the value of the nearest ancestor that is one, itself included unless told
    otherwise; null where there is none). A stop is a table of ids, whose value is the id, or an expression over an
    element's id, found, parent_id, the columns named, is_marked (whether its id is in marked) and the columns of beside (a
    table with one row for an id) that is null where it isn't one. Parents that don't exist can be stops. With a function
    in merge, of the nearer value and the farther, a stop's values are joined by it instead of the nearest being taken.

    Nothing is kept of a way but its nearest stops."""
    tables = {name: s for name, s in stops.items() if isinstance(s, DataFrame)} | ({"is_marked": marked} if marked is not None else {})
    flags = {}
    for name, ids in tables.items():
        known = kept(ids.select(*KEY).distinct())
        flags[f"at_{name}"] = F.broadcast(known) if known.count() <= BROADCAST_IDS else known
    names = {name: (merge or {}).get(name, F.coalesce) for name in stops}

    def valued(nodes: DataFrame) -> DataFrame:
        for flag, ids in flags.items():
            nodes = nodes.join(ids.withColumn(flag, F.lit(True)), KEY, "left").withColumn(flag, F.col(flag).isNotNull())
        nodes = nodes.withColumn("is_marked", F.col("at_is_marked") if marked is not None else F.lit(False))
        if beside is not None:
            nodes = nodes.join(beside, KEY, "left")
        return nodes.select(*KEY, "parent_id", *[(F.when(F.col(f"at_{n}"), F.col("id")) if isinstance(s, DataFrame) else s).alias(n) for n, s in stops.items()])

    every = kept(last_by_id(elements, "parent_id", *columns).withColumn("found", F.lit(True)))
    inner = kept(every.filter("parent_id IS NOT NULL").select("model_id", F.col("parent_id").alias("id")).distinct())
    lost = inner.join(every, KEY, "left_anti").withColumns({"parent_id": F.lit(None).cast("string"), "found": F.lit(False)} | {c: F.lit(None).cast(every.schema[c].dataType) for c in columns})
    start = valued(every.join(inner, KEY, "left_semi").unionByName(lost.select(*every.columns)))
    ways = _jumped(kept(start.withColumnRenamed("parent_id", "next")), names)
    above = ways.select("model_id", F.col("id").alias("parent_id"), *[F.col(n).alias(f"{n}_above") for n in names])
    rows = valued(every).join(above, ["model_id", "parent_id"], "left")
    return rows.select(*KEY, *[(join(F.col(n), F.col(f"{n}_above")) if itself else F.col(f"{n}_above")).alias(n) for n, join in names.items()])


def ancestor_closure(elements: DataFrame) -> DataFrame:
    """(model_id, id, anc, depth): each element with itself at depth 0 and all its ancestors, at any depth. A parent that
    doesn't exist is an ancestor, and ends the way. On a cycle each pair stands once, at its least depth."""
    return chains(elements).select(*KEY, F.posexplode(F.transform("path", lambda x: x["id"])).alias("depth", "anc")).select(*KEY, "anc", "depth")


def cycles(elements: DataFrame) -> DataFrame:
    """(model_id, id, on_cycle): elements on a parent cycle, or below one. Where open ways have come to after at least as
    many steps as there are of them is on a cycle, and every element of a cycle is come to from another."""
    up = kept(parents(elements))
    inner = up.select("model_id", F.col("parent_id").alias("id")).filter("id IS NOT NULL").distinct()
    ways = _jumped(kept(up.join(inner, KEY, "left_semi").withColumnRenamed("parent_id", "next")), {})
    open_ways = ways.filter("next IS NOT NULL")
    on = open_ways.select("model_id", F.col("next").alias("id")).distinct().withColumn("on_cycle", F.lit(True))
    below = up.join(open_ways.select("model_id", F.col("id").alias("parent_id")), ["model_id", "parent_id"], "left_semi").select(*KEY)
    return below.join(on, KEY, "left").select(*KEY, F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def nearest_visible(elements: DataFrame, visible: DataFrame) -> DataFrame:
    """(model_id, id, visible_id). A visible id that no element has is its own nearest visible ancestor."""
    rows = nearest(elements, {"visible_id": visible}).filter("visible_id IS NOT NULL")
    return rows.unionByName(_alone(elements, visible).withColumn("visible_id", F.col("id")))


def _alone(elements: DataFrame, visible: DataFrame) -> DataFrame:
    return visible.select(*KEY).distinct().join(elements.select(*KEY), KEY, "left_anti")


def ends(elements: DataFrame, visible: DataFrame) -> DataFrame:
    """(model_id, id, visible_id, system_id, shown, system_shown): the nearest visible ancestor-or-self and the nearest
    that is a system or a person, and whether the element and that system are visible themselves."""
    system = F.when(F.col("kind").isin("system", "person"), F.struct("id", "is_marked"))
    rows = nearest(elements, {"visible_id": F.when(F.col("is_marked"), F.col("id")), "system": system}, "kind", marked=visible)
    rows = rows.select(*KEY, "visible_id", F.col("system.id").alias("system_id"), F.coalesce(F.col("visible_id") == F.col("id"), F.lit(False)).alias("shown"), F.coalesce("system.is_marked", F.lit(False)).alias("system_shown"))
    return rows.unionByName(_alone(elements, visible).select(*KEY, F.col("id").alias("visible_id"), F.lit(None).cast("string").alias("system_id"), F.lit(True).alias("shown"), F.lit(False).alias("system_shown")))


def system_ancestor(elements: DataFrame) -> DataFrame:
    """(model_id, id, system_id): the nearest ancestor-or-self that is a system or a person."""
    return nearest(elements, {"system_id": F.when(F.col("kind").isin("system", "person"), F.col("id"))}, "kind").filter("system_id IS NOT NULL")


def found_names(path: str, field: str = "name") -> Column:
    """A field of a way's nodes from the root down; ancestors that don't exist have none."""
    return F.transform(F.reverse(F.filter(path, lambda x: x["found"])), lambda x: x[field])


def element_path(elements: DataFrame) -> DataFrame:
    """(model_id, id, path): names from the root down, joined by ` > `. An ancestor that doesn't exist has no name."""
    return chains(elements, "name").select(*KEY, F.array_join(found_names("path"), " > ").alias("path"))


def breadcrumbs(elements: DataFrame, foci: DataFrame) -> DataFrame:
    """foci(model_id, focus_id, level) -> (model_id, focus_id, level, crumbs array<struct<label, level>>): the landscape
    first; then, but for a missing focus or at landscape level, the ancestors from the top that are neither landscape
    nor person, each with the level that it opens. The walk stops at a landscape."""
    asked = foci.select("model_id", F.col("focus_id").alias("id")).distinct()
    ways = chains(elements, "name", "kind").join(asked, KEY, "left_semi")
    below = F.aggregate("path", F.struct(F.lit(False).alias("ended"), F.array().cast("array<struct<label:string,level:string>>").alias("steps")), lambda s, x: F.when(s["ended"] | F.coalesce(x["kind"] == "landscape", F.lit(False)), F.struct(F.lit(True).alias("ended"), s["steps"].alias("steps"))).when(~x["found"] | F.coalesce(x["kind"] == "person", F.lit(False)), s).otherwise(F.struct(F.lit(False).alias("ended"), F.concat(F.array(F.struct(x["name"].alias("label"), x["kind"].alias("level"))), s["steps"]).alias("steps"))))
    lists = ways.select("model_id", F.col("id").alias("focus_id"), below["steps"].alias("steps"))
    first = F.array(F.struct(F.lit("System Landscape").alias("label"), F.lit("landscape").alias("level")))
    plain = F.col("focus_id").isNull() | (F.col("level") == "landscape")
    rest = F.coalesce("steps", F.array().cast("array<struct<label:string,level:string>>"))
    return foci.join(lists, ["model_id", "focus_id"], "left").select("model_id", "focus_id", "level", F.when(plain, first).otherwise(F.concat(first, rest)).alias("crumbs"))


def descendants(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """(model_id, root_id, id): all strict descendants of ids(model_id, id). Bounded on cycles, too. Each element takes the
    nearest root above it, and that root's roots from the roots' own hierarchy, so that the work is that of the result."""
    roots = ids.select(*KEY).distinct()
    direct = kept(nearest(elements, {"up": roots}, itself=False).filter("up IS NOT NULL"))
    of_roots = roots.join(direct, KEY, "left").select(*KEY, F.col("up").alias("parent_id"), F.lit(0).alias("ord"))
    above = ancestor_closure(of_roots).select("model_id", F.col("id").alias("up"), F.col("anc").alias("root_id"))
    return direct.join(above, ["model_id", "up"]).filter("root_id <> id").select("model_id", "root_id", "id")


def below(elements: DataFrame, ids: DataFrame) -> DataFrame:
    """(model_id, id) of elements that have one of ids above them."""
    return nearest(elements, {"up": ids}, itself=False).filter("up IS NOT NULL").select(*KEY)


def _sum_before(rows: DataFrame, family: tuple[str, ...], order: tuple[str, ...], value: str, name: str) -> tuple[DataFrame, DataFrame]:
    """rows with the sum of value over the rows of their family that come before them. Rows are sorted by range, summed per
    range, and summed again within it from the ranges' offsets: no family ever meets in one task, however large. The table
    that they are read from comes with them."""
    ranged = kept(rows.repartitionByRange(*family, *order).withColumn("range", F.spark_partition_id()))
    ranges = Window.partitionBy(*family).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    within = Window.partitionBy(*family, "range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*family, "range").agg(F.sum(value).alias("s"))
    offsets = sums.withColumn("offset", F.coalesce(F.sum("s").over(ranges), F.lit(0))).drop("s")
    inside = ranged.withColumn("inside", F.coalesce(F.sum(value).over(within), F.lit(0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*family, "range")]
    return inside.alias("a").join(offsets.alias("b"), reduce(lambda x, y: x & y, same)).select("a.*", "offset").withColumn(name, F.col("inside") + F.col("offset")).drop("range", "inside", "offset"), ranged


def intervals(elements: DataFrame) -> DataFrame:
    """(model_id, id, depth, entry, exit): entry numbers a model's elements from 0 depth first, children in the order of the
    document, and exit is the number of the last one below, so that y is x or below it exactly when
    x.entry <= y.entry <= x.exit, and exit - entry elements are below x. A missing parent is none; what is on a cycle or
    below one has no number and no row.

    Sizes go up and places come down by doubling over elements that are somebody's parent, log2(depth) rounds each; an
    element's place is the sum of its own and its ancestors' places among their siblings."""
    every = kept(last_by_id(elements, "parent_id", "ord"))
    inner = every.filter("parent_id IS NOT NULL").select("model_id", F.col("parent_id").alias("id")).distinct()
    inner = kept(inner.join(every, KEY, "left_semi").withColumn("opens", F.lit(True)))
    up = inner.select("model_id", F.col("id").alias("parent_id"), F.lit(True).alias("has"))
    rows = every.join(up, ["model_id", "parent_id"], "left").withColumn("parent_id", F.when(F.col("has"), F.col("parent_id"))).drop("has").join(inner, KEY, "left")
    rows = kept(rows)
    discard(every, inner)
    leaves = rows.filter("opens IS NULL AND parent_id IS NOT NULL").groupBy("model_id", F.col("parent_id").alias("id")).agg(F.count("*").alias("leaves"))
    start = rows.filter("opens").join(leaves, KEY, "left").select(*KEY, F.col("parent_id").alias("next"), (F.coalesce("leaves", F.lit(0)) + 1).alias("size"))
    sizes = _jumped(kept(start), {}, ("size",))
    looped = sizes.filter("next IS NOT NULL")
    sized = rows.join(sizes.select(*KEY, "size"), KEY, "left").withColumn("size", F.coalesce("size", F.lit(1)))
    sized = sized.join(looped.select(*KEY), KEY, "left_anti").join(looped.select("model_id", F.col("id").alias("parent_id")), ["model_id", "parent_id"], "left_anti")
    placed, ranged = _sum_before(sized, ("model_id", "parent_id"), ("ord", "id"), "size", "before")
    step = F.col("parent_id").isNotNull().cast("int")
    placed = kept(placed.select(*KEY, "parent_id", "opens", "size", (F.col("before") + step).alias("entry"), step.alias("depth")))
    discard(rows, sizes, ranged)
    add = lambda near, far: near + F.coalesce(far, F.lit(0))
    ways = _jumped(kept(placed.filter("opens").select(*KEY, F.col("parent_id").alias("next"), "entry", "depth")), {"entry": add, "depth": add})
    above = ways.select("model_id", F.col("id").alias("parent_id"), F.col("entry").alias("entry_above"), F.col("depth").alias("depth_above"))
    out = placed.join(above, ["model_id", "parent_id"], "left").withColumns({"entry": add(F.col("entry"), F.col("entry_above")), "depth": add(F.col("depth"), F.col("depth_above"))})
    return out.select(*KEY, "depth", "entry", (F.col("entry") + F.col("size") - 1).alias("exit"))


def nesting(pairs: DataFrame, numbered: DataFrame) -> DataFrame:
    """pairs with model_id, source_id and target_id, and the rows of `intervals` -> pairs with nesting: `same`, `source` where
    the source has the target below it, `target` the other way round, `apart`, or null where an end has no number. An
    answer costs the two look-ups at any depth."""
    numbered = kept(numbered.select(*KEY, "entry", "exit"))
    end = lambda s: numbered.select("model_id", F.col("id").alias(f"{s}_id"), F.struct("entry", "exit").alias(f"{s}_at"))
    both = pairs.join(end("source"), ["model_id", "source_id"], "left").join(end("target"), ["model_id", "target_id"], "left")
    holds = lambda x, y: F.col(f"{y}_at.entry").between(F.col(f"{x}_at.entry"), F.col(f"{x}_at.exit"))
    known = F.col("source_at").isNotNull() & F.col("target_at").isNotNull()
    found = F.when(F.col("source_at.entry") == F.col("target_at.entry"), "same").when(holds("source", "target"), "source").when(holds("target", "source"), "target").otherwise("apart")
    return both.select(*pairs.columns, F.when(known, found).alias("nesting"))
