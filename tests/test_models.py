"""Hand-written scenarios of lifting, rules, edits, layout, text and import."""

import json
import math

from pyspark.sql import functions as F

from strataloom.operators import edits, hierarchy, layout, rules, text, views
from strataloom.sources import models
from strataloom.streaming import upkeep

ELEMENT = "model_id string, ord string, id string, kind string, name string, parent_id string, container_subtype string, is_external boolean"
REL = "model_id string, ord string, id string, source_id string, target_id string, type string, action string, integration_mode string"


def elements(spark, *rows):
    return spark.createDataFrame([("m", f"{i:03}", r[0], r[1], r[0].upper(), r[2] if len(r) > 2 else None, None, r[3] if len(r) > 3 else None) for i, r in enumerate(rows)], ELEMENT)


def rels(spark, *rows):
    return spark.createDataFrame([("m", f"{i:03}", r[0], r[1], r[2], "uses", None, None) for i, r in enumerate(rows)], REL)


def shop(spark):
    return elements(spark, ("top", "landscape"), ("a", "system", "top"), ("b", "system", "top"), ("p", "person", "top"), ("a1", "container", "a"), ("a2", "container", "a"), ("a11", "component", "a1"), ("a21", "component", "a2"), ("b1", "container", "b"))


def visible(df, *ids):
    return df.filter(F.col("id").isin(*ids))


def ends(df):
    return sorted((r.source_id, r.target_id) for r in df.collect())


def test_lifting(spark):
    e = shop(spark)
    inside = visible(e, "a1", "a2")
    r = rels(spark, ("r1", "a1", "a2"), ("r2", "a11", "a21"), ("r3", "a11", "b1"), ("r4", "a11", "b1"), ("r5", "b1", "a21"), ("r6", "a11", "a1"), ("r7", "b1", "p"), ("r8", "p", "a1"), ("r9", "a11", "nowhere"))
    derived = views.derived_relationships(r, e, inside)
    assert ends(derived) == [("a1", "a2"), ("a1", "b"), ("b", "a2"), ("p", "a1")]
    assert {x.original_id for x in derived.collect() if x.target_id == "b"} == {"r3"}
    assert sorted(x.id for x in views.external_elements(r, e, inside).collect()) == ["b", "p"]
    assert sorted(x.id for x in views.view_relationships(r, e, inside).collect()) == ["derived-a1-b", "derived-b-a2", "derived-p-a1", "r1"]
    again = views.derived_relationships(derived.withColumn("ord", F.col("id")).select(*r.columns), e, inside)
    assert again.filter("source_id = 'a1' AND target_id = 'a2'").count() == 0  # lifted once is direct


def test_unknown_ids(spark):
    e = shop(spark)
    ghost = spark.createDataFrame([("m", "ghost")], "model_id string, id string")
    assert hierarchy.nearest_visible(e, ghost).collect()[0].visible_id == "ghost"
    assert hierarchy.system_ancestor(e).filter("id = 'ghost'").count() == 0
    orphan = elements(spark, ("x", "component", "missing"))
    assert hierarchy.element_path(orphan).first().path == "X"


def test_deep_and_cyclic_hierarchies(spark):
    chain = elements(spark, *[(f"n{i}", "code", f"n{i - 1}" if i else None) for i in range(20)])
    assert hierarchy.ancestor_closure(chain).filter("id = 'n19'").count() == 20
    loop = elements(spark, ("x", "code", "z"), ("y", "code", "x"), ("z", "code", "y"), ("below", "code", "x"), ("free", "code"))
    assert {(r.id, r.on_cycle) for r in hierarchy.cycles(loop).collect()} == {("x", True), ("y", True), ("z", True), ("below", False)}
    gone = spark.createDataFrame([("m", "x")], "model_id string, id string")
    assert {r.id for r in hierarchy.descendants(loop, gone).collect()} == {"y", "z", "below"}


def test_closure_goes_to_any_depth(spark):
    chain = elements(spark, *[(f"n{i}", "code", f"n{i - 1}" if i else None) for i in range(11)], ("far", "code", "gone"))
    pairs = sorted((r.id, r.anc, r.depth) for r in hierarchy.ancestor_closure(chain).collect())
    assert pairs == sorted([(f"n{i}", f"n{j}", i - j) for i in range(11) for j in range(i + 1)] + [("far", "far", 0), ("far", "gone", 1)])
    top = spark.createDataFrame([("m", "n0")], "model_id string, id string")
    assert {r.id for r in hierarchy.descendants(chain, top).collect()} == {f"n{i}" for i in range(1, 11)}
    nodes = spark.createDataFrame([], "model_id string, view_id string, ord string, element_id string, x double, y double, w double, h double")
    drawn = spark.createDataFrame([], "model_id string, view_id string, ord string, relationship_id string")
    left = edits.cascade_delete(chain, rels(spark, ("r", "n10", "far")), nodes, drawn, top)
    assert [r.id for r in left[0].collect()] == ["far"] and left[1].count() == 0
    loop = elements(spark, ("x", "code", "z"), ("y", "code", "x"), ("z", "code", "y"), ("below", "code", "x"))
    assert sorted((r.anc, r.depth) for r in hierarchy.ancestor_closure(loop).filter("id = 'below'").collect()) == [("below", 0), ("x", 1), ("y", 3), ("z", 2)]


def test_rules(spark):
    e = elements(spark, ("top", "landscape", "a"), ("a", "system", "top", True), ("a", "system"), ("k", "container", "a"), ("odd", "thing", "a")).withColumns({"has_code_ref": F.col("kind") == "container", "present": F.when(F.col("is_external"), F.array(F.lit("isExternal"), F.lit("formatting"))).otherwise(F.array(F.lit("isExternal"))), "formatting": F.struct(F.lit("#12345G").alias("background_color"), F.lit("#abcdef").alias("border_color"), F.lit(None).cast("string").alias("font_color"))})
    found = {(r.code, r.path) for r in rules.hierarchy_violations(e).collect()}
    assert found == {("INVALID_HIERARCHY", "elements[000].parentId"), ("INVALID_HIERARCHY", "elements[002].parentId"), ("INVALID_CODE_REF", "elements[003].codeRef"), ("INVALID_HIERARCHY", "elements[004].parentId")}
    assert [r.path for r in rules.duplicate_ids(e, rels(spark, ("k", "a", "a"))).orderBy("path").collect()] == ["elements[002].id", "relationships[000].id"]
    attributes = rules.attribute_violations(e).collect()
    assert sum(r.severity == "warning" for r in attributes) == 1 and any("backgroundColor" in r.message for r in attributes)
    assert rules.children_of_external(e).count() == 3


def test_edits(spark):
    e, r = shop(spark), rels(spark, ("r1", "a1", "a2"), ("r2", "a11", "b1"), ("r3", "p", "b"))
    nodes = spark.createDataFrame([("m", "v", "0", x, 1.0, 2.0, None, None) for x in ("a1", "b", "a11")], "model_id string, view_id string, ord string, element_id string, x double, y double, w double, h double")
    drawn = spark.createDataFrame([("m", "v", "0", x) for x in ("r1", "r3", "stray")], "model_id string, view_id string, ord string, relationship_id string")
    ids = spark.createDataFrame([("m", "a")], "model_id string, id string")
    left = edits.cascade_delete(e, r, nodes, drawn, ids)
    assert [sorted(x[0] for x in df.select(c).collect()) for df, c in zip(left, ("id", "id", "element_id", "relationship_id"))] == [["b", "b1", "p", "top"], ["r3"], ["b"], ["r3"]]
    marked = edits.mark_external(e, r, nodes, drawn, ids)
    assert marked[0].filter("id = 'a'").first().is_external and marked[0].count() == 5
    assert not edits.unmark_external(marked[0], ids).filter("id = 'a'").first().is_external
    renamed = edits.upsert_elements(e, e.filter("id = 'b'").withColumns({"name": F.lit("new"), "ord": F.lit("999")}))
    assert [tuple(x) for x in renamed.filter("id = 'b'").select("name", "ord").collect()] == [("new", "002")] and renamed.count() == e.count()


def test_layout(spark):
    z = spark.createDataFrame([(x,) for x in (-1.0, 0.2, 0.4, 0.41, 0.8, 0.81, 7.0, math.nan)], "z double")
    assert [r[0] for r in z.select(layout.semantic_zoom(F.col("z"))).collect()] == ["landscape", "landscape", "system", "container", "component", "code", "code", "landscape"]
    nodes = spark.createDataFrame([("m", "v", "0", "a", 0.0, 0.0, 100.0, 100.0), ("m", "v", "1", "b", 300.0, 0.0, 100.0, 100.0), ("m", "v", "2", "c", 0.0, 0.0, 100.0, 100.0)], "model_id string, view_id string, ord string, element_id string, x double, y double, w double, h double")
    e = elements(spark, ("a", "system"), ("b", "system"), ("c", "system"))
    route = {r.id: r for r in layout.edge_route(rels(spark, ("r1", "a", "b"), ("r2", "a", "c")), nodes, e).collect()}
    assert (route["r1"].from_x, route["r1"].to_x, route["r1"].mid_x, route["r1"].angle, route["r1"].label) == (100.0, 300.0, 200.0, 0.0, None)
    assert (route["r2"].from_x, route["r2"].from_y) == (50.0, 50.0)
    points = spark.createDataFrame([("m", "v", 1, 100.0, 100.0, None), ("m", "v", 2, 50.0, 50.0, "a"), ("m", "v", 3, 200.0, 50.0, None)], "model_id string, view_id string, point_id long, px double, py double, exclude_id string")
    assert {(r.point_id, r.element_id) for r in layout.point_hits(points, nodes).collect()} == {(1, "a"), (2, "c")}
    placed = layout.place_in_model(e).select("id", "nth").collect()
    assert {(r.id, r.nth) for r in placed} == {("a", 0), ("b", 1), ("c", 2)}


def test_text_round_trip(spark):
    e = shop(spark)
    r = rels(spark, ("r1", "a1", "b1"), ("r2", "p", "a"))
    found = text.statements(text.render_text(e, r).withColumnRenamed("model_id", "doc_id")).collect()
    names = {x.pos: x.name for x in found}
    assert {(x.kind, x.name, names.get(x.parent_pos)) for x in found if x.type == "element"} == {(x.kind, x.name, (x.parent_id or "").upper() or None) for x in e.collect()}
    assert {(x.name, x.target, x.attributes["type"]) for x in found if x.type == "relationship"} == {("A1", "B1", "uses"), ("P", "A", "uses")}
    bad = text.tokenise(spark.createDataFrame([("d", 'System "open\n# note\nPERSON "TRUE" €')], "doc_id string, text string")).collect()
    assert [(t.kind, t.value, t.line) for t in bad] == [("kind", "system", 1), ("error", '"open', 1), ("kind", "person", 3), ("boolean", "true", 3), ("error", "€", 3)]


def test_import_policy(spark, tmp_path):
    good = {"schemaVersion": "0.1.0", "metadata": {"title": "T"}, "elements": [{"id": "a", "kind": "system", "name": "A", "isExternal": None}], "relationships": [], "constraints": [], "views": [{"id": "v", "level": "system", "title": "V"}]}
    docs = {"ok": json.dumps(good), "broken": "{{not json", "none": json.dumps(good | {"schemaVersion": ""}), "new": json.dumps(good | {"schemaVersion": "9.9.9"}), "drive": '{"nodes": [], "edges": [], "version": 1}', "extra": json.dumps(good | {"more": 1})}
    for name, body in docs.items():
        (tmp_path / f"{name}.arch.json").write_text(body)
    read = models.read_models(spark, str(tmp_path)).select(F.regexp_extract("file", r"(\w+)\.arch\.json", 1).alias("model_id"), "text")
    accepted, quarantined = models.strict_import(read)
    assert {r.model_id: r.reason for r in quarantined.collect()} == {"broken": "Invalid JSON", "none": "Missing schemaVersion", "drive": "Missing schemaVersion", "new": "Unknown schemaVersion: 9.9.9", "extra": "Unknown fields: more"}
    tables = models.normalise(accepted)
    assert tables["elements"].first().present == ["id", "kind", "name", "isExternal"]
    assert not tables["views"].first().has_layout and tables["models"].first().title == "T"


def test_newest_edit_wins(spark):
    row = lambda i, op, ts: ("m", "k", op, f"v{i}", ts, i)
    import datetime

    t = [datetime.datetime(2024, 1, 1, 0, 0, s) for s in range(5)]
    state = upkeep.merge(spark.createDataFrame([], upkeep.SCHEMA), spark.createDataFrame([row(1, "put", t[1]), row(2, "put", t[3]), row(3, "put", t[2])], upkeep.SCHEMA))
    assert state.first().value == "v2"
    state = upkeep.merge(state, spark.createDataFrame([row(4, "delete", t[4])], upkeep.SCHEMA))
    state = upkeep.merge(state, spark.createDataFrame([row(5, "put", t[0])], upkeep.SCHEMA))
    assert upkeep.current(state).count() == 0


def codes(spark, *texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")
    out = {str(i): [] for i in range(len(texts))}
    for r in text.document_checks(docs).orderBy("doc_id", "line").collect():
        out[r.doc_id].append((r.error_code, r.line))
    return list(out.values())


def test_document_errors(spark):
    found = codes(
        spark, 'System "Web App"', "system {", 'system "A"\n"A" -> ', "@@@ $$$ !!! ???", 'blob "A"', 'system "open', 'system "A"\n}', '"A" "B"', 'system "A" ["x"]', "", "# only a note",
        'version "2"\nsystem "A"', 'system "A"\nsystem "A"', 'system "A" { container "B" }\n"A" -> "a::B" [type="uses"]\n"a::C" -> "B"', 'PERSON "Alice"\n\n  system   "App" [tags="x, y" external="true"\n',
    )
    assert found == [
        [], [("MISSING_REQUIRED_FIELD", 1)], [("MISSING_REQUIRED_FIELD", 2)], [("UNTERMINATED_STRING", 1)] * 12, [("UNKNOWN_ELEMENT_KIND", 1), ("UNEXPECTED_TOKEN", 1)], [("MISSING_REQUIRED_FIELD", 1)], [("UNEXPECTED_TOKEN", 2)],
        [("UNEXPECTED_TOKEN", 1)] * 2, [("UNEXPECTED_TOKEN", 1)], [("EMPTY_DOCUMENT", None)], [("EMPTY_DOCUMENT", None)], [("UNSUPPORTED_VERSION", 1)], [("DUPLICATE_NAME", None)], [("UNRESOLVED_REFERENCE", 3)], [],
    ]


def test_rendered_attributes_come_back(spark):
    more = {"description": F.lit("does things"), "technology": F.when(F.col("id") == "a1", "Spark"), "is_external": F.col("id") == "b", "tags": F.when(F.col("id") == "a", F.array(F.lit("x"), F.lit("y"))), "container_subtype": F.when(F.col("id") == "a2", "database").when(F.col("id") == "a1", "default")}
    e = shop(spark).withColumns(more).withColumn("formatting", F.when(F.col("id") == "a", F.struct(F.lit("#112233").alias("background_color"), F.lit(None).cast("string").alias("border_color"), F.lit("#445566").alias("font_color"))))
    r = rels(spark, ("r1", "a11", "b1"), ("r2", "p", "nobody")).withColumns({"label": F.lit("calls"), "tags": F.array(F.lit("fast"))})
    written = text.render_text(e, r).withColumnRenamed("model_id", "doc_id")
    assert '"P" -> "nobody" [type="uses", label="calls", tags="fast"]' in written.first().text
    back, edges = text.assemble(text.statements(written))
    got = {x.name: x for x in back.collect()}
    assert got["A"].tags == ["x", "y"] and got["A"].formatting.background_color == "#112233" and got["A"].formatting.border_color is None
    assert got["A1"].technology == "Spark" and got["A2"].container_subtype == "database" and got["A1"].container_subtype is None
    assert got["B"].is_external and got["A"].is_external is None and all(x.description == "does things" for x in got.values())
    assert got["A11"].parent_id == "top.a.a1" and got["TOP"].parent_id is None
    assert [(x.source_id, x.target_id, x.label, x.tags) for x in edges.collect()] == [("top.a.a1.a11", "top.b.b1", "calls", ["fast"])]
    deep = elements(spark, *[(f"n{i}", "code", f"n{i - 1}" if i else None) for i in range(9)])
    chain = text.statements(text.render_text(deep, rels(spark)).withColumnRenamed("model_id", "doc_id")).filter("type = 'element'").orderBy("pos").collect()
    assert [(x.name, x.parent_pos) for x in chain] == [(f"N{i}", chain[i - 1].pos if i else None) for i in range(9)]


def test_saved_relationships_place_their_ends(spark):
    e, r = shop(spark), rels(spark, ("r1", "a1", "a2"))
    r = r.withColumn("description", F.lit("old"))
    nodes = spark.createDataFrame([("m", "v", "0", "a1", 1.0, 2.0, None, None)], "model_id string, view_id string, ord string, element_id string, x double, y double, w double, h double")
    views_ = spark.createDataFrame([("m", "v")], "model_id string, view_id string")
    fresh = rels(spark, ("n1", "a1", "b1"), ("n2", "b1", "p"), ("n3", "a11", "a1")).withColumns({"description": F.lit("new"), "original_id": F.lit(None).cast("string")})
    back = r.withColumns({"original_id": F.col("id"), "id": F.lit("derived-x"), "description": F.lit("written back")})
    out, placed = edits.save_relationships(r, nodes, fresh.unionByName(back), views_)
    # A target stands at 850 even if it is the only end that is missing; later edits find it there.
    assert sorted((x.element_id, x.x, x.y, x.w, x.h) for x in placed.filter("element_id <> 'a1'").collect()) == [("a11", 600.0, 80.0, 200.0, 130.0), ("b1", 850.0, 80.0, 200.0, 130.0), ("p", 850.0, 80.0, 200.0, 130.0)]
    assert {x.id: x.description for x in out.collect()} == {"r1": "written back", "n1": "new", "n2": "new", "n3": "new"}
    assert e.count() == 9


def test_import_reasons_by_type(spark):
    texts = {"[]": "Missing schemaVersion", "5": "Missing schemaVersion", "null": "Invalid JSON", "": "Invalid JSON", '{"schemaVersion": "0"}': "Unknown schemaVersion: 0", '{"schemaVersion": "false"}': "Unknown schemaVersion: false", '{"schemaVersion": 0}': "Missing schemaVersion", '{"schemaVersion": false}': "Missing schemaVersion", '{"schemaVersion": 9}': "Unknown schemaVersion: 9", '{"schemaVersion": "1", "schemaVersion": "0.1.0"}': None}
    docs = spark.createDataFrame([(t, t) for t in texts], "model_id string, text string")
    accepted, quarantined = models.strict_import(docs)
    assert {r.text: r.reason for r in quarantined.collect()} | {r.text: None for r in accepted.collect()} == texts


def test_documents_come_back_whole(spark):
    doc = {
        "schemaVersion": "0.1.0", "metadata": {"title": "T x", "createdAt": "now"},
        "elements": [{"id": "a", "kind": "system", "name": "A", "tags": ["x"], "attributes": {"k": [1, {"z": None}]}, "codeRef": {"kind": "file", "ref": "r"}, "formatting": {"fontColor": "#112233"}}, {"id": "b", "kind": "code", "name": "B", "isExternal": False}],
        "relationships": [{"id": "r", "sourceId": "a", "targetId": "b", "type": "uses", "label": "L"}], "constraints": [{"id": "c", "type": "t", "scope": {"all": True}, "severity": "error"}],
        "views": [{"id": "v", "level": "system", "title": "V", "filter": {"f": 1}, "layout": {"algorithm": "grid", "nodes": [{"elementId": "a", "x": 1.5, "y": 2.0, "collapsed": True}], "edges": [{"relationshipId": "r", "path": {"p": [1, 2]}}], "viewport": {"zoom": 2}}}, {"id": "w", "level": "code", "title": "W", "layout": {"algorithm": "g", "nodes": [], "edges": []}}],
    }
    bad = {"schemaVersion": "0.1.0", "metadata": {"titel": "x"}, "elements": [{"id": "", "kind": "box", "name": 1, "formatting": {"fontColor": "red"}, "tags": ["a", 1]}, 5], "relationships": {}, "views": []}
    docs = spark.createDataFrame([("ok", json.dumps(doc)), ("bad", json.dumps(bad)), ("none", "{{x")], "model_id string, text string")
    t = models.normalise(docs.filter("model_id = 'ok'"))
    out = models.export_models(t["models"], t["elements"], t["relationships"], t["constraints"], t["views"], t["layout_nodes"], t["layout_edges"]).first()
    assert json.loads(out.text) == doc and out.file_name == "t-x.arch.json"
    found = {(r.path, r.code) for r in models.schema_audit(docs).filter("model_id <> 'ok'").collect()}
    assert found == {("", "TYPE"), ("relationships", "TYPE"), ("metadata.title", "REQUIRED"), ("metadata.titel", "UNKNOWN_KEY"), ("elements[1]", "TYPE"), ("elements[0].id", "MIN_LENGTH"), ("elements[0].kind", "ENUM"), ("elements[0].name", "TYPE"), ("elements[0].tags", "TYPE"), ("elements[0].formatting.fontColor", "PATTERN")}
    assert models.schema_audit(docs.filter("model_id = 'ok'")).count() == 0
