"""Nearest stops, cycles and descendants against plain walks, and at a depth of 100,000."""

import random
import time

import pytest
from pyspark.sql import functions as F

from strataloom.operators import hierarchy

SCHEMA = "model_id string, ord int, id string, kind string, name string, parent_id string"


def way(up, x):
    out = []
    while x is not None and x not in out:
        out.append(x)
        x = up.get(x)
    return out, x


@pytest.mark.parametrize("seed", range(2))
def test_random_hierarchies(spark, seed):
    """Forests, cycles with tails, missing parents, ids of ones that don't exist among those marked."""
    rnd = random.Random(seed)
    rows, up, kinds = [], {}, {}
    for i in range(120):
        for model in ("m", "n"):
            parent = rnd.choice([None, "", f"e{rnd.randrange(120)}", f"e{max(0, i - rnd.randrange(1, 4))}", f"g{rnd.randrange(5)}"])
            kind = rnd.choice(["system", "container", "component", None])
            rows.append((model, i, f"e{i}", kind, "x", parent))
            up[model, f"e{i}"] = (model, parent) if parent else None
            kinds[model, f"e{i}"] = kind
    elements = spark.createDataFrame(rows, SCHEMA)
    marked = [(m, f"e{i}") for m in ("m", "n") for i in range(0, 120, 7)] + [("m", "g1"), ("n", "nobody")]
    ids = spark.createDataFrame(marked, "model_id string, id string")
    ends = {(r.model_id, r.id): (r.visible_id, r.system_id, r.shown, r.system_shown) for r in hierarchy.ends(elements, ids).collect()}
    for x in up:
        above = way(up, x)[0]
        visible = next((a[1] for a in above if a in marked), None)
        system = next((a for a in above if kinds.get(a) == "system"), None)
        assert ends[x] == (visible, system and system[1], x in marked, system in marked)
    assert ends["n", "nobody"] == ("nobody", None, True, False) and len(ends) == len(up) + 2
    looped = {x for x in up if way(up, x)[1] is not None}
    assert {(r.model_id, r.id): r.on_cycle for r in hierarchy.cycles(elements).collect()} == {x: way(up, x)[1] == x for x in looped}
    want = {(x[0], a[1], x[1]) for x in up for a in way(up, x)[0][1:] if a in marked}
    got = [tuple(r) for r in hierarchy.descendants(elements, ids).collect()]
    assert set(got) == want and len(got) == len(want)
    strict = {x for x in up if any(a in marked for a in way(up, up[x])[0])} if up else set()
    assert {tuple(r) for r in hierarchy.below(elements, ids).collect()} == strict


@pytest.mark.parametrize("seed", range(2))
def test_numbers_depth_first(spark, seed):
    """Forests with cycles and tails, missing parents, a parent with very many children; ids repeated."""
    rnd = random.Random(seed)
    rows = [("m", 500 - i, f"e{i}", rnd.choice([None, "", f"e{rnd.randrange(150)}", f"e{max(0, i - rnd.randrange(1, 4))}", "gone", "e3"])) for i in range(150)]
    rows += [("n", i, f"e{i}", "e0" if i else None) for i in range(300)] + [("n", 1000, "e7", "e5"), ("o", 0, "a", "a")]
    elements = spark.createDataFrame(rows, "model_id string, ord int, id string, parent_id string")
    last = {}
    for model, place, x, parent in sorted(rows, key=lambda r: r[1]):
        last[model, x] = (place, parent)
    children, tops = {}, {}
    for (model, x), (place, parent) in last.items():
        up = (model, parent) if (model, parent) in last else None
        (children.setdefault(up, []) if up else tops.setdefault(model, [])).append((place, x))
    want = set()

    def number(model, x, depth, at):
        entry, at = at, at + 1
        for _, child in sorted(children.get((model, x), [])):
            at = number(model, child, depth + 1, at)
        want.add((model, x, depth, entry, at - 1))
        return at

    for model, found in tops.items():
        at = 0
        for _, x in sorted(found):
            at = number(model, x, 0, at)
    numbered = hierarchy.intervals(elements)
    got = [tuple(r) for r in numbered.collect()]
    assert set(got) == want and len(got) == len(want)
    at = {(m, x): (a, b) for m, x, _, a, b in want}
    pairs = [("m", f"e{rnd.randrange(150)}", rnd.choice([f"e{rnd.randrange(150)}", "gone", None])) for _ in range(300)] + [("n", "e5", "e7"), ("n", "e7", "e0"), ("n", "e7", "e7")]

    def answer(m, x, y):
        a, b = at.get((m, x)), at.get((m, y))
        return None if not a or not b else "same" if a == b else "source" if a[0] < b[0] <= a[1] else "target" if b[0] < a[0] <= b[1] else "apart"

    out = hierarchy.nesting(spark.createDataFrame(pairs, "model_id string, source_id string, target_id string"), numbered).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(repr((*p, answer(*p))) for p in pairs)
    assert {r.nesting for r in out} >= {"same", "source", "target", "apart", None}
    assert hierarchy.intervals(elements.limit(0)).collect() == []


def test_repeated_ids_and_empty_tables(spark):
    rows = [("m", 0, "a", "system", "A", None), ("m", 1, "a", "container", "B", "b"), ("m", 2, "b", "system", "C", None)]
    elements = spark.createDataFrame(rows, SCHEMA)
    assert {r.id: r.system_id for r in hierarchy.system_ancestor(elements).collect()} == {"a": "b", "b": "b"}
    assert hierarchy.cycles(elements.limit(0)).collect() == [] and hierarchy.system_ancestor(elements.limit(0)).collect() == []


def test_a_chain_of_100_000(spark):
    """Every row of the state is narrow, so that memory is linear in the depth."""
    n = 100_000
    chain = spark.range(n).select(F.lit("m").alias("model_id"), F.col("id").cast("int").alias("ord"), F.concat(F.lit("e"), "id").alias("id"), F.when(F.col("id") % 1000 == 0, "system").otherwise("container").alias("kind"), F.lit("x").alias("name"), F.when(F.col("id") > 0, F.concat(F.lit("e"), (F.col("id") - 1).cast("string"))).alias("parent_id"))
    began = time.time()
    wrong = hierarchy.system_ancestor(chain).filter(F.substring("system_id", 2, 9).cast("int") != F.floor(F.substring("id", 2, 9).cast("int") / 1000) * 1000)
    assert wrong.count() == 0
    assert hierarchy.cycles(chain).count() == 0
    numbers = hierarchy.intervals(chain).filter(f"entry <> CAST(substring(id, 2) AS INT) OR depth <> entry OR exit <> {n - 1}")
    assert numbers.count() == 0
    ring = chain.withColumn("parent_id", F.coalesce("parent_id", F.lit("e70000")))
    assert {r.on_cycle: r["count"] for r in hierarchy.cycles(ring).groupBy("on_cycle").count().collect()} == {True: 70_001, False: 29_999}
    assert time.time() - began < 300
