"""What operators keep, shuffle and compare beside their results."""

import os

import pytest
from pyspark.sql import functions as F

from strataloom.functions import durable
from strataloom.operators import hierarchy, layout, rules, text
from strataloom.plans import queries
from strataloom.sources import models

from .test_text_plans import exchanges

ELEMENT = "model_id string, ord string, id string, kind string, name string, parent_id string"


@pytest.fixture
def no_checkpoint(spark, monkeypatch):
    def fail(self, *a, **b):
        raise AssertionError("checkpoints are neither compressed nor deleted on the way")

    monkeypatch.setattr(type(spark.range(1)), "checkpoint", fail)


def shop(spark, n=40):
    rows = [("m", "0", "top", "landscape", "Top", None)] + [("m", f"1{i:04}", f"s{i}", "system", f"S {i % 7}", "top") for i in range(n)] + [("m", f"2{i:04}", f"c{i}", "container", f"C {i % 3}", f"s{i % n}") for i in range(3 * n)]
    return spark.createDataFrame(rows, ELEMENT)


def test_likely_keeps_what_a_join_would(spark):
    """F5, F8: the bitmap loses no row, and lets few others through."""
    rows = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("a"), (F.col("id") % 7).alias("b"), "id")
    keys = rows.filter("id % 50 = 3").select("a", "b")
    got = {r.id for r in durable.likely(rows, ["a", "b"], keys).collect()}
    assert got >= set(range(3, 20_000, 50)) and len(got) < 420
    assert durable.likely(rows, ["a", "b"], keys.limit(0)).count() == 0


def test_revalidation_keeps_small_tables(spark, no_checkpoint, monkeypatch):
    """changed ids beyond the broadcast are found by the bitmap, with equal results."""
    e = shop(spark).withColumns({"has_code_ref": F.lit(False), "is_external": F.lit(None).cast("boolean"), "present": F.array().cast("array<string>"), "formatting": F.struct(*[F.lit(None).cast("string").alias(c) for c in ("background_color", "border_color", "font_color")])})
    r = spark.createDataFrame([("m", f"{i:04}", f"r{i}", f"c{i % 120}", f"s{i % 50}", "t") for i in range(200)], "model_id string, ord string, id string, source_id string, target_id string, type string")
    none = spark.createDataFrame([], "model_id string, ord string, id string, has_layout boolean"), spark.createDataFrame([], "model_id string, view_id string, view_ord string, ord string, element_id string"), spark.createDataFrame([], "model_id string, view_id string, view_ord string, ord string, relationship_id string")
    after = (e.filter("id NOT IN ('s3', 'c7', 'c8')"), r.filter("id <> 'r5'").withColumn("id", F.when(F.col("id") == "r6", "r9").otherwise(F.col("id"))), *none)
    changed = spark.createDataFrame([("m", x) for x in ("s3", "c7", "c8", "r5", "r6", "r9")], "model_id string, id string")
    want = sorted(map(str, rules.violations(*after).collect()))
    for most in (rules.BROADCAST_IDS, 1):
        monkeypatch.setattr(rules, "BROADCAST_IDS", most)
        assert sorted(map(str, rules.revalidate(rules.violations(e, r, *none), (e, r, *none), after, changed).collect())) == want


def test_nodes_of_one_rectangle_meet_points_twice_at_most(spark, monkeypatch):
    """hits of many nodes on one spot."""
    kept = []
    monkeypatch.setattr(layout, "kept", lambda df, keep=layout.kept: kept.append(out := keep(df)) or out)
    nodes = spark.createDataFrame([("m", "v", f"n{i % 200}", 500 - i, float(i % 2), 0.0, None, 80.0 if i % 3 else None) for i in range(500)], "model_id string, view_id string, element_id string, ord int, x double, y double, w double, h double")
    points = spark.createDataFrame([("m", "v", i, float(i % 130), 10.0, f"n{i % 200}" if i % 5 else None) for i in range(400)], "model_id string, view_id string, point_id int, px double, py double, exclude_id string")
    want = {}
    for i in range(400):
        hit = [(500 - j, f"n{j % 200}") for j in range(500) if j % 2 <= i % 130 <= j % 2 + 120 and (i % 5 == 0 or f"n{j % 200}" != f"n{i % 200}")]
        if hit:
            want[i] = min(hit)[1]
    for most in (layout.BROADCAST_IDS, 1):
        monkeypatch.setattr(layout, "BROADCAST_IDS", most)
        assert {r.point_id: r.element_id for r in layout.point_hits(points, nodes).collect()} == want
    assert [x.count() for x in kept] == [4, 4]


def test_duplicate_names_keep_small_tables(spark, no_checkpoint):
    """F8: tables between rounds are compressed, and deleted when nothing reads them any more."""
    e = spark.createDataFrame([("m", f"{i:03}", f"e{i}", "system", n, None) for i, n in enumerate(["A", "a::X", "B", "A", "A"])] + [("m", "9", "x", "container", "X", "e0"), ("m", "91", "y", "container", "X", "e2"), ("m", "92", "z", "container", "X", "e2")], ELEMENT)
    folder = f"{durable.shared_dir(spark)}/strataloom".removeprefix("file:")
    before = len(os.listdir(folder)) if os.path.isdir(folder) else 0
    assert sorted((r.id, r.name, r.scope) for r in text.duplicate_names(e).collect()) == [("e3", "A", None), ("e4", "A", None), ("x", "X", "a"), ("z", "X", "b")]
    assert len(os.listdir(folder)) - before <= 10


def test_audit_reads_a_document_once(spark, no_checkpoint):
    """one scan, no table between."""
    docs = spark.createDataFrame([("a", '{"elements": [{"id": ""}, 3], "views": [{"layout": {"nodes": [{"x": "1"}]}}]}'), ("b", "[]"), ("c", None)], "model_id string, text string")
    found = models.schema_audit(docs)
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString() and exchanges(found) == 0
    rows = {(r.model_id, r.entity, r.path, r.code) for r in found.collect()}
    assert {("a", "element", "elements[0].id", "MIN_LENGTH"), ("a", "element", "elements[1]", "TYPE"), ("a", "node", "views[0].layout.nodes[0].x", "TYPE"), ("a", "node", "views[0].layout.nodes[0].elementId", "REQUIRED"), ("b", "document", "", "TYPE"), ("c", "document", "", "TYPE")} <= rows


def test_external_elements_are_found_once(spark, sf_dir, no_checkpoint):
    """what edges reach from views is a table of its own, read twice, not found twice."""
    assert "l_suppkey" not in queries.every_view_nodes(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()


def test_names_nobody_asks_for_are_left_alone(spark):
    """of elements only those with a name that is asked for are looked at, and no edge is moved."""
    e = shop(spark)
    rels = spark.createDataFrame([("m", "0", "r0", "S 3", "Top"), ("m", "1", "r1", "top.s-3::C 0", "S 1"), ("m", "2", "r2", "x::C 0", "C 1"), ("m", "3", "r3", "::C 0", None)], "model_id string, ord string, id string, source string, target string")
    found, missing = text.resolve_names(e, rels)
    assert exchanges(found) == 0
    assert sorted((r.id, r.source_id, r.target_id) for r in found.collect()) == [("r0", "s3", "top"), ("r1", "c3", "s1")]
    assert sorted((r.id, r.side, r.name) for r in missing.collect()) == [("r2", "source", "x::C 0"), ("r3", "source", "::C 0"), ("r3", "target", None)]


def test_numbers_leave_two_tables(spark):
    """tables of the steps are deleted on the way, and both ends look up one table of numbers."""
    folder = f"{durable.shared_dir(spark)}/strataloom".removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    numbered = hierarchy.intervals(shop(spark))
    assert len(set(os.listdir(folder)) - before) == 2
    pairs = spark.createDataFrame([("m", "s1", "c1"), ("m", "c1", "s1"), ("m", "c1", "c1"), ("m", "s1", "s2"), ("m", "s1", "no")], "model_id string, source_id string, target_id string")
    out = hierarchy.nesting(pairs, numbered)
    assert len(set(os.listdir(folder)) - before) == 3
    assert sorted((r.source_id, r.target_id, r.nesting) for r in out.collect()) == [("c1", "c1", "same"), ("c1", "s1", "target"), ("s1", "c1", "source"), ("s1", "no", None), ("s1", "s2", "apart")]
