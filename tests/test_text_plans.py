"""What text documents cost: how often their rows are moved and read, and what is read in a document against the tables' operators."""

import random
import re

from pyspark.sql import functions as F

from strataloom.functions import documents
from strataloom.operators import text
from strataloom.plans import edit_queries, queries

ELEMENT = "model_id string, ord int, id string, kind string, name string, parent_id string"
REL = "model_id string, ord int, id string, source_id string, target_id string, type string"


def exchanges(df) -> int:
    """Exchanges of the plan, reused ones left aside."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return sum(bool(re.search(r"\bExchange (?:hash|range|single|round)", line)) for line in plan.splitlines() if "ReusedExchange" not in line)


def tables(spark):
    return spark.createDataFrame([("m", 0, "a", "system", "A", None)], ELEMENT), spark.createDataFrame([("m", 0, "r", "a", "a", "t")], REL)


def bodies():
    rnd = random.Random(3)
    names = ["A", "a", "B", "A B", "a-b", "a::B", "C", "!", "a.b", "K", "İx", " D ", "E　F"]

    def block(depth):
        out = []
        for _ in range(rnd.randrange(1, 5)):
            inner = "{ " + block(depth + 1) + " }" if depth < 4 and rnd.random() < 0.5 else ""
            out.append(f'container "{rnd.choice(names)}" {inner}')
            out.append(f'"{rnd.choice(names)}" -> "{rnd.choice(names)}"')
        return "\n".join(out)

    return {f"d{i}": block(0) for i in range(40)}


def test_render_text_moves_rows_once(spark):
    """rows of a model are brought together once."""
    assert exchanges(text.render_text(*tables(spark))) == 1


def test_lines_of_both_tables_are_shuffled_once(spark, sf_dir):
    """beside that, lines and orders once each by order."""
    for name in ("render_text", "tokenise"):
        df = queries.QUERIES[name](spark, sf_dir)
        df.collect()
        assert exchanges(df) == 3, name


def test_rows_of_equal_places_are_written_by_line(spark):
    elements = [("m", i, x, "system", x.upper(), None) for i, x in enumerate("abc")]
    rels = [("m", 0, "r1", "b", "a", "t"), ("m", 0, "r2", "a", "b", "t"), ("m", 0, "r3", None, "b", "t"), ("n", 0, "r", "x", "y", "t")]
    got = {r.model_id: r.text for r in text.render_text(spark.createDataFrame(elements, ELEMENT), spark.createDataFrame(rels, REL)).collect()}
    assert got == {"m": 'version "1"\n\nsystem "A"\nsystem "B"\nsystem "C"\n\n"A" -> "B" [type="t"]\n"B" -> "A" [type="t"]', "n": 'version "1"\n\n\n"x" -> "y" [type="t"]'}


def test_slugs_are_those_of_tables(spark):
    names = ["A B", " a b　", "Kelvin", "İx", "Ångström", "", "!!", "x\x85", "x \x85", "Σ", "a\tb\n", "A-B_c.9", "﻿q r"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", text.slugify(F.col("n")).alias("s")).collect()
    assert {r.n: r.s for r in rows} == {n: documents.slug(n) for n in names}


def declared(spark):
    docs = spark.createDataFrame(list(bodies().items()), "doc_id string, text string")
    found = text.statements(docs).localCheckpoint()
    e = found.filter("type = 'element'").select(F.col("doc_id").alias("model_id"), F.col("pos").alias("ord"), F.col("pos").cast("string").alias("id"), "kind", "name", F.col("parent_pos").cast("string").alias("parent_id"))
    r = found.filter("type = 'relationship' AND parent_pos IS NULL").select(F.col("doc_id").alias("model_id"), F.col("pos").alias("ord"), F.col("pos").cast("string").alias("id"), F.col("name").alias("source"), "target")
    return found, e, r


def test_assembled_elements_are_those_of_the_tables(spark):
    """no row is moved, and ids are those that the hierarchy's operator gives."""
    found, e, _ = declared(spark)
    got, _ = text.assemble(found)
    assert exchanges(got) == 0
    want = {(r.model_id, r.id): r.slug_id for r in text.slug_ids(e).collect()}
    up = {(r.model_id, r.id): r.parent_id for r in e.collect()}
    assert {(r.model_id, str(r.ord)): (r.id, r.parent_id) for r in got.collect()} == {k: (v, want.get((k[0], up[k]))) for k, v in want.items()}


def test_assembled_relationships_are_those_of_the_tables(spark):
    """no row is moved, and ends are those that names stand for in the tables."""
    found, e, r = declared(spark)
    _, got = text.assemble(found)
    assert exchanges(got) == 0
    slugs = {(x.model_id, x.id): x.slug_id for x in text.slug_ids(e).collect()}
    want = {(x.model_id, x.ord): (slugs[x.model_id, x.source_id], slugs[x.model_id, x.target_id]) for x in text.resolve_names(e, r)[0].collect()}
    assert want and {(x.model_id, x.ord): (x.source_id, x.target_id) for x in got.collect()} == want


def test_documents_are_checked_where_they_are_read(spark):
    """one pass, and duplicates are those of the tables' operator."""
    docs = spark.createDataFrame(list(bodies().items()), "doc_id string, text string")
    checks = text.document_checks(docs)
    assert exchanges(checks) == 0
    _, e, _ = declared(spark)
    want = sorted((r.model_id, r.name, r.scope or "root") for r in text.duplicate_names(e).collect() if r.scope != "")
    got = sorted((r.doc_id, r.element_name, re.search(r"in scope '(.*)'$", r.message)[1]) for r in checks.collect() if r.error_code == "DUPLICATE_NAME")
    assert want and [x for x in got if x[2]] == want


def test_statements_know_the_element_around_them(spark, sf_dir):
    """the enclosing element's name comes with a statement, without a join."""
    rows = text.statements(spark.createDataFrame([("d", 'system "A" {\n container "B"\n "B" -> "A"\n}\n"A" -> "a::B"')], "doc_id string, text string")).collect()
    assert [(r.name, r.parent, r.scope, r.slug_id, r.source_id, r.target_id) for r in rows] == [("A", None, None, "a", None, None), ("B", "A", "a", "a.b", None, None), ("B", "A", "a", None, "a.b", "a"), ("A", None, None, None, "a", "a.b")]
    assert "Join" not in edit_queries.statements(spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[0]
