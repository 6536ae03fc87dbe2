"""All views at once against one run per view, hits by levels and search for tables of queries against brute force."""

import random

from pyspark.sql import functions as F

from strataloom.operators import all_views, layout, views

ELEMENT = "model_id string, ord int, id string, kind string, name string, parent_id string"
REL = "model_id string, ord int, id string, source_id string, target_id string, type string"


def rows(df):
    return sorted((str(tuple(r)) for r in df.collect()))


def estate(spark, seed=4):
    rnd = random.Random(seed)
    kinds = ["landscape", "system", "person", "container", "component", "code"]
    elements = [(m, i, f"e{i}", rnd.choice(kinds), f"N{i}", f"e{rnd.randrange(i)}" if i and rnd.random() < 0.8 else None) for m in ("m", "n") for i in range(40)]
    rels = [(m, i, f"r{i}", f"e{rnd.randrange(44)}", f"e{rnd.randrange(44)}", rnd.choice("xy")) for m in ("m", "n") for i in range(120)]
    shown = [(m, v, f"e{rnd.randrange(43)}") for m in ("m", "n") for v in ("v1", "v2", "v3") for _ in range(9)]
    return spark.createDataFrame(elements, ELEMENT), spark.createDataFrame(rels, REL), spark.createDataFrame(shown, "model_id string, view_id string, id string").distinct()


def test_all_views_equal_one_run_per_view(spark):
    elements, rels, shown = estate(spark)
    lifted = all_views.lifted(rels, elements, shown).checkpoint()
    columns = ["model_id", "id", "source_id", "target_id", "type", "original_id"]
    related, derived, external = all_views.view_relationships(lifted, "type"), all_views.derived_relationships(lifted, "type"), all_views.external_elements(lifted, elements)
    for v in ("v1", "v2", "v3"):
        own = shown.filter(F.col("view_id") == v).drop("view_id")
        assert rows(related.filter(F.col("view_id") == v).select(columns)) == rows(views.view_relationships(rels, elements, own).select(columns))
        assert rows(derived.filter(F.col("view_id") == v).select(columns)) == rows(views.derived_relationships(rels, elements, own).select(columns))
        known = ["model_id", "id", "first_ord", "name", "kind"]
        assert rows(external.filter(F.col("view_id") == v).select(known)) == rows(views.external_elements(rels, elements, own).select(known))


def test_positions_of_all_views_equal_one_run_per_view(spark):
    elements, rels, shown = estate(spark, 5)
    nodes = shown.select("model_id", "view_id", F.col("id").alias("element_id"), (F.length("view_id") * 7 + F.substring("id", 2, 3).cast("int") * 11).cast("double").alias("x"), F.lit(1.0).alias("y"), F.lit(None).cast("double").alias("w"), F.lit(None).cast("double").alias("h"))
    external = all_views.external_elements(all_views.lifted(rels, elements, shown), elements).checkpoint()
    stored = external.filter("id IN ('e1', 'e2')").select("model_id", "view_id", F.col("id").alias("element_id"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"))
    placed = all_views.external_positions(nodes, external, stored, shown)
    assert external.count() > 0
    for v in ("v1", "v2", "v3"):
        one = lambda df: df.filter(F.col("view_id") == v)  # noqa: B023, E731
        want = views.external_positions(one(nodes), one(external).drop("view_id"), one(stored), one(shown).drop("view_id"))
        assert rows(one(placed)) == rows(want)
        assert rows(one(all_views.view_nodes(nodes, shown, placed))) == rows(views.view_nodes(one(nodes), one(shown).drop("view_id"), want))


def test_hits_of_rectangles_of_any_size(spark):
    rnd = random.Random(6)
    nodes = [("m", "v", f"n{i}", i, rnd.uniform(-1e4, 1e4), rnd.uniform(-1e4, 1e4), rnd.choice([None, 1.0, 120.0, 256.0, 5e3, 1e6, 0.0, -5.0]), rnd.choice([None, 2.0, 512.0, 1e5])) for i in range(120)]
    nodes += [("m", "v", "all", 500, -1e300, -1e300, float("inf"), 2e300), ("m", "v", "grid", -1, 0.0, 0.0, 256.0, 256.0), ("m", "w", "other", 0, -1e9, -1e9, 2e9, 2e9)]
    points = [("m", "v", i, rnd.uniform(-2e4, 2e4), rnd.uniform(-2e4, 2e4), rnd.choice([None, "n3", "grid"])) for i in range(300)] + [("m", "v", 900, 256.0, 256.0, None), ("m", "v", 901, 0.0, 0.0, "grid"), ("m", "v", 902, 1e200, -1e299, None)]
    want = {}
    for m, v, p, px, py, out in points:
        hit = [(o, e) for nm, nv, e, o, x, y, w, h in nodes if (nm, nv) == (m, v) and e != out and x <= px <= x + (120.0 if w is None else w) and y <= py <= y + (80.0 if h is None else h)]
        if hit:
            want[p] = min(hit)[1]
    frame = spark.createDataFrame(nodes, "model_id string, view_id string, element_id string, ord int, x double, y double, w double, h double")
    asked = spark.createDataFrame(points, "model_id string, view_id string, point_id int, px double, py double, exclude_id string")
    assert {r.point_id: r.element_id for r in layout.point_hits(asked, frame).collect()} == want
    assert want[902] == "all" and want[900] == "grid"


def test_search_for_a_table_of_queries(spark):
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choices("aAbB éÉ.7", k=n))
    options = [(m, f"o{i}", text(rnd.randrange(0, 12)), rnd.choice([None, text(6)])) for m in ("m", "n") for i in range(60)]
    queries = [(i, rnd.choice("mn"), text(rnd.randrange(0, 5))) for i in range(80)] + [(100, "m", " \t"), (101, "n", None), (102, "m", "no such text"), (103, "x", "a"), (104, "m", "")]
    want = []
    for q, m, t in queries:
        want += [(q, m, o) for om, o, label, sub in options if om == m and t is not None and (not t.strip() or t.lower() in label.lower() or t.lower() in (sub or "").lower())]
    frame = spark.createDataFrame(options, "model_id string, id string, label string, sublabel string")
    got = views.search_many(frame, spark.createDataFrame(queries, "query_id int, model_id string, query string"))
    assert rows(got.select("query_id", "model_id", "id")) == sorted(str(x) for x in want) and len(want) > 500


def test_equal_queries_and_texts_are_searched_once(spark, monkeypatch):
    """no table grows with what is asked again, nor with the runs of texts."""
    sizes = []
    monkeypatch.setattr(views, "kept", lambda df, keep=views.kept: sizes.append((out := keep(df)).count()) or out)
    options = spark.createDataFrame([("m", f"o{i}", f"Order {i % 5}00", "Europe > Customer 000017") for i in range(300)] + [("m", "x", None, "CUSTOMER 000017"), ("m", "y", "000017", None)], "model_id string, id string, label string, sublabel string")
    queries = spark.createDataFrame([(i, "m", "000017") for i in range(40)] + [(40, "m", "er 100"), (41, "m", "er 10"), (42, "m", "q"), (43, "m", "")], "query_id int, model_id string, query string")
    got = sorted((r.query_id, r.id) for r in views.search_many(options, queries).select("query_id", "id").collect())
    every = [f"o{i}" for i in range(300)] + ["x", "y"]
    assert got == sorted([(q, x) for q in range(40) for x in every] + [(q, f"o{i}") for q in (40, 41) for i in range(1, 300, 5)] + [(43, x) for x in every])
    assert max(sizes) == len(every) and sum(sizes) - len(every) < 60
