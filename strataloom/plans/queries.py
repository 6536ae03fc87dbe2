"""Model queries over the supplied tables, each with the same computation as plain SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dimensions
from ..functions.durable import kept
from ..operators import all_views, hierarchy, layout, rules, views
from . import adapters as a

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def estate(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return a.load(spark, sf_dir, a.ELEMENTS), a.load(spark, sf_dir, a.RELATIONSHIPS)


#: The view that most queries take: inside one system.
FOCUS = "n:7"


def focus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("estate", FOCUS)], "model_id string, focus_id string")


def focus_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    elements, rels = estate(spark, sf_dir)
    return elements, rels, views.visible_elements(elements, "system", focus(spark))


PRE = f"""WITH RECURSIVE elements AS ({a.select_sql(a.ELEMENTS)}), relationships AS ({a.select_sql(a.RELATIONSHIPS)}), nodes AS ({a.select_sql(a.LAYOUT_NODES)}),
uniq AS (SELECT * FROM elements QUALIFY row_number() OVER (PARTITION BY model_id, id ORDER BY ord DESC) = 1),
closure AS (SELECT model_id, id, id AS anc, 0 AS depth, parent_id AS next FROM uniq
  UNION ALL SELECT c.model_id, c.id, c.next, c.depth + 1, u.parent_id FROM closure c LEFT JOIN uniq u ON u.model_id = c.model_id AND u.id = c.next WHERE c.next IS NOT NULL)"""
VISIBLE = f", visible AS (SELECT * FROM elements WHERE parent_id = '{FOCUS}')"
TOP = ", visible AS (SELECT * FROM elements WHERE kind IN ('system', 'person'))"
LIFT = """,
nv AS (SELECT c.id, arg_min(c.anc, c.depth) AS v FROM closure c JOIN (SELECT DISTINCT id FROM visible) s ON s.id = c.anc GROUP BY c.id),
sa AS (SELECT c.id, arg_min(c.anc, c.depth) AS s FROM closure c JOIN uniq u ON u.id = c.anc AND u.kind IN ('system', 'person') GROUP BY c.id),
shown AS (SELECT DISTINCT id FROM visible),
lifted AS (
  SELECT r.*, coalesce(nv1.v, CASE WHEN nv2.v IS NOT NULL AND s1.s NOT IN (SELECT id FROM shown) THEN s1.s END) AS src, coalesce(nv2.v, CASE WHEN nv1.v IS NOT NULL AND s2.s NOT IN (SELECT id FROM shown) THEN s2.s END) AS tgt,
         CASE WHEN nv1.v IS NULL AND nv2.v IS NOT NULL AND s1.s NOT IN (SELECT id FROM shown) THEN s1.s WHEN nv2.v IS NULL AND nv1.v IS NOT NULL AND s2.s NOT IN (SELECT id FROM shown) THEN s2.s END AS ext
  FROM relationships r LEFT JOIN nv nv1 ON nv1.id = r.source_id LEFT JOIN nv nv2 ON nv2.id = r.target_id LEFT JOIN sa s1 ON s1.id = r.source_id LEFT JOIN sa s2 ON s2.id = r.target_id
  WHERE NOT (r.source_id IN (SELECT id FROM shown) AND r.target_id IN (SELECT id FROM shown))),
derived AS (
  SELECT model_id, 'derived-' || src || '-' || tgt AS id, src AS source_id, tgt AS target_id, type, action, integration_mode, ord, id AS original_id FROM lifted WHERE src IS NOT NULL AND tgt IS NOT NULL AND src <> tgt
  QUALIFY row_number() OVER (PARTITION BY model_id, src, tgt ORDER BY ord, id) = 1),
externals AS (SELECT l.model_id, l.ext AS id, min(l.ord) AS first_ord, any_value(u.name) AS name, any_value(u.kind) AS kind FROM lifted l JOIN uniq u ON u.id = l.ext WHERE src IS NOT NULL AND tgt IS NOT NULL AND src <> tgt GROUP BY l.model_id, l.ext)"""


@query(PRE + VISIBLE + LIFT + " SELECT model_id, id, source_id, target_id, type, action, integration_mode, original_id FROM derived UNION ALL SELECT * FROM (" + (PRE + TOP + LIFT + " SELECT model_id, id, source_id, target_id, type, action, integration_mode, original_id FROM derived") + ")")
def derived_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estate lifted to systems and persons, and to the inside of one system: two views in one pass."""
    elements, rels, inside = focus_view(spark, sf_dir)
    shown = lambda df, view: df.select("model_id", F.lit(view).alias("view_id"), "id")
    both = shown(inside, "inside").unionByName(shown(views.visible_elements(elements, "landscape"), "top"))
    return all_views.derived_relationships(all_views.lifted(rels, elements, both), "type", "action", "integration_mode").drop("view_id")


@query(PRE + " SELECT model_id, id, anc, depth FROM closure")
def ancestor_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.ancestor_closure(estate(spark, sf_dir)[0])


@query(PRE + VISIBLE + LIFT + " SELECT 'estate' AS model_id, id, v AS visible_id FROM nv")
def nearest_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _, visible = focus_view(spark, sf_dir)
    return hierarchy.nearest_visible(elements, visible)


@query(PRE + VISIBLE + LIFT + " SELECT 'estate' AS model_id, id, s AS system_id FROM sa")
def system_ancestor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.system_ancestor(estate(spark, sf_dir)[0])


@query(PRE + VISIBLE + " SELECT model_id, id, kind, name, parent_id, 'focus' AS shown_by FROM visible UNION ALL SELECT model_id, id, kind, name, parent_id, 'landscape' FROM elements WHERE kind IN ('system', 'person') UNION ALL SELECT model_id, id, kind, name, parent_id, 'system' FROM elements WHERE kind = 'container' AND parent_id IS NULL")
def visible_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _, inside = focus_view(spark, sf_dir)
    parts = [(inside, "focus"), (views.visible_elements(elements, "landscape"), "landscape"), (views.visible_elements(elements, "system"), "system")]
    rows = [p.select("model_id", "id", "kind", "name", "parent_id", F.lit(n).alias("shown_by")) for p, n in parts]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query(PRE + " SELECT model_id, id, source_id, target_id, type FROM relationships WHERE source_id IN (SELECT id FROM elements WHERE kind IN ('person', 'container')) AND target_id IN (SELECT id FROM elements WHERE kind IN ('person', 'container'))")
def direct_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, rels = estate(spark, sf_dir)
    return views.direct_relationships(rels, elements.filter(F.col("kind").isin("person", "container"))).select("model_id", "id", "source_id", "target_id", "type")


@query(PRE + VISIBLE + LIFT + " SELECT * FROM externals")
def external_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, rels, visible = focus_view(spark, sf_dir)
    return views.external_elements(rels, elements, visible)


MIXED = f", visible AS (SELECT * FROM elements WHERE parent_id = '{FOCUS}' OR kind = 'person')"


def mixed_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Inside one system, and all persons: some edges are direct, others lifted, others leave the view."""
    elements, rels = estate(spark, sf_dir)
    return elements, rels, elements.filter((F.col("parent_id") == FOCUS) | (F.col("kind") == "person"))


@query(PRE + MIXED + LIFT + """ SELECT model_id, id, source_id, target_id, type, CAST(NULL AS STRING) AS original_id FROM relationships WHERE source_id IN (SELECT id FROM shown) AND target_id IN (SELECT id FROM shown)
UNION ALL SELECT model_id, id, source_id, target_id, type, original_id FROM derived d WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE r.source_id = d.source_id AND r.target_id = d.target_id AND r.source_id IN (SELECT id FROM shown) AND r.target_id IN (SELECT id FROM shown))""")
def view_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, rels, visible = mixed_view(spark, sf_dir)
    return views.view_relationships(rels, elements, visible).select("model_id", "id", "source_id", "target_id", "type", "original_id")


PATHS = ", paths AS (SELECT c.model_id, c.id, string_agg(u.name, ' > ' ORDER BY c.depth DESC) AS path FROM closure c JOIN uniq u ON u.id = c.anc GROUP BY c.model_id, c.id)"


@query(PRE + PATHS + " SELECT * FROM paths")
def element_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.element_path(estate(spark, sf_dir)[0])


OPTIONS = PATHS + ", options AS (SELECT e.model_id, e.id, e.name AS label, CASE WHEN e.parent_id IS NOT NULL THEN coalesce(p.path, '') END AS sublabel FROM elements e LEFT JOIN paths p ON p.id = e.parent_id WHERE e.kind IN ('system', 'person', 'container', 'component'))"


@query(PRE + OPTIONS + " SELECT * FROM options")
def element_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.element_options(estate(spark, sf_dir)[0])


@query(PRE + OPTIONS + " SELECT * FROM options WHERE contains(lower(label), 'nation_7') OR contains(lower(coalesce(sublabel, '')), 'nation_7') OR contains(lower(label), '42') OR contains(lower(coalesce(sublabel, '')), '42')")
def search_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    options = views.element_options(estate(spark, sf_dir)[0])
    return views.search_options(options, "NATION_7").unionByName(views.search_options(options, "42")).distinct()


@query(PRE + " SELECT model_id, anc AS root_id, id FROM closure WHERE depth > 0 AND anc IN (SELECT id FROM elements WHERE kind IN ('system', 'container'))")
def descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is below each system and each container."""
    elements, _ = estate(spark, sf_dir)
    return hierarchy.descendants(elements, elements.filter("kind IN ('system', 'container')").select("model_id", "id"))


@query(PRE + """, crumbs AS (SELECT c.id, string_agg(u.name || '/' || u.kind, '|' ORDER BY c.depth DESC) AS steps FROM closure c JOIN uniq u ON u.id = c.anc WHERE u.kind NOT IN ('landscape', 'person') GROUP BY c.id)
SELECT e.model_id, e.id AS focus_id, e.kind AS level, 'System Landscape/landscape' || coalesce('|' || steps, '') AS crumbs FROM (SELECT DISTINCT model_id, id, kind FROM elements WHERE kind IN ('system', 'container', 'component')) e LEFT JOIN crumbs c ON c.id = e.id""")
def breadcrumbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, _ = estate(spark, sf_dir)
    foci = elements.filter(F.col("kind").isin("system", "container", "component")).select("model_id", F.col("id").alias("focus_id"), F.col("kind").alias("level")).distinct()
    out = hierarchy.breadcrumbs(elements, foci)
    return out.withColumn("crumbs", F.array_join(F.transform("crumbs", lambda c: F.concat(c["label"], F.lit("/"), c["level"])), "|"))


@query(PRE + """, e2 AS (SELECT model_id, source_id AS element_id, id AS relationship_id, 'outgoing' AS direction, target_id AS other_id FROM relationships UNION ALL SELECT model_id, target_id, id, 'incoming', source_id FROM relationships WHERE source_id <> target_id)
SELECT e2.*, u.name AS other_name FROM e2 LEFT JOIN uniq u ON u.id = e2.other_id WHERE element_id IN (SELECT id FROM elements)""")
def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.connections(*estate(spark, sf_dir))


@query(PRE + """, looped AS (SELECT id, CASE WHEN id = 'r:1' THEN 'n:' || (SELECT min(n_nationkey) FROM nation WHERE n_regionkey = 1)::VARCHAR ELSE parent_id END AS parent_id FROM uniq),
walk AS (SELECT id, id AS anc, parent_id AS next, 0 AS d FROM looped UNION ALL SELECT w.id, w.next, l.parent_id, d + 1 FROM walk w JOIN looped l ON l.id = w.next WHERE d < 12 AND w.next IS NOT NULL),
onc AS (SELECT DISTINCT id FROM walk WHERE d > 0 AND id = anc)
SELECT DISTINCT 'estate' AS model_id, w.id, w.id IN (SELECT id FROM onc) AS on_cycle FROM walk w WHERE w.anc IN (SELECT id FROM onc)""")
def cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every element of the estate that is on a cycle or leads into one."""
    return hierarchy.cycles(looped(spark, sf_dir))


def looped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A region that is put under one of its nations closes a loop, and all below it lead into that."""
    elements, _ = estate(spark, sf_dir)
    first = spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey = 1").agg(F.min("n_nationkey")).first()[0]
    return elements.withColumn("parent_id", F.when(F.col("id") == "r:1", F.lit(f"n:{first}")).otherwise(F.col("parent_id")))


# Rules, over one model for each nation.


def corpus(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    elements = a.load(spark, sf_dir, a.FAULTY_ELEMENTS)
    present = F.array_compact(F.array(F.when(F.col("is_external").isNotNull(), "isExternal"), F.when(F.col("container_subtype").isNotNull(), "containerSubtype"), F.when(F.col("background_color").isNotNull(), "formatting")))
    null = F.lit(None).cast("string")
    elements = elements.withColumns({"present": present, "formatting": F.struct("background_color", null.alias("border_color"), null.alias("font_color"))})
    return elements, a.load(spark, sf_dir, a.FAULTY_RELATIONSHIPS), a.load(spark, sf_dir, a.FAULTY_VIEWS), a.load(spark, sf_dir, a.FAULTY_NODES), a.load(spark, sf_dir, a.FAULTY_EDGES)


CORPUS = f"WITH elements AS ({a.select_sql(a.FAULTY_ELEMENTS)}), relationships AS ({a.select_sql(a.FAULTY_RELATIONSHIPS)}), views AS ({a.select_sql(a.FAULTY_VIEWS)}), nodes AS ({a.select_sql(a.FAULTY_NODES)}), edges AS ({a.select_sql(a.FAULTY_EDGES)}), kinds(kind, expected, lvl) AS ({dimensions.values_sql(dimensions.KINDS)})"
_IDS = """SELECT model_id, 'ids' AS rule, 'DUPLICATE_ID' AS code, (CASE rank WHEN 0 THEN 'Element' ELSE 'Relationship' END) || ' ID "' || id || '" is not unique' AS message, (CASE rank WHEN 0 THEN 'elements[' ELSE 'relationships[' END) || ord || '].id' AS path, 'error' AS severity
FROM (SELECT model_id, id, 0 AS rank, ord FROM elements UNION ALL SELECT model_id, id, 1, ord FROM relationships) QUALIFY row_number() OVER (PARTITION BY model_id, id ORDER BY rank, ord) > 1"""
_REFS = """SELECT model_id, 'references' AS rule, 'INVALID_REFERENCE' AS code, message, path, 'error' AS severity FROM (
SELECT model_id, source_id AS ref, 'Relationship source "' || source_id || '" does not exist' AS message, 'relationships[' || ord || '].sourceId' AS path FROM relationships
UNION ALL SELECT model_id, target_id, 'Relationship target "' || target_id || '" does not exist', 'relationships[' || ord || '].targetId' FROM relationships
UNION ALL SELECT model_id, parent_id, 'Parent "' || parent_id || '" does not exist', 'elements[' || ord || '].parentId' FROM elements WHERE parent_id <> ''
UNION ALL SELECT model_id, element_id, 'Layout node references missing element "' || element_id || '"', 'views[' || view_ord || '].layout.nodes[' || ord || '].elementId' FROM nodes) q
WHERE NOT EXISTS (SELECT 1 FROM elements e WHERE e.model_id = q.model_id AND e.id = q.ref)
UNION ALL SELECT model_id, 'references', 'INVALID_REFERENCE', 'Layout edge references missing relationship "' || relationship_id || '"', 'views[' || view_ord || '].layout.edges[' || ord || '].relationshipId', 'error' FROM edges g WHERE NOT EXISTS (SELECT 1 FROM relationships r WHERE r.model_id = g.model_id AND r.id = g.relationship_id)"""
_H = """SELECT model_id, 'hierarchy' AS rule, code, message, 'elements[' || ord || '].' || field AS path, 'error' AS severity FROM (
WITH j AS (SELECT e.*, k.expected, p.kind AS parent_kind FROM elements e LEFT JOIN kinds k ON k.kind = e.kind LEFT JOIN (SELECT model_id, id, arg_max(kind, ord) AS kind FROM elements GROUP BY ALL) p ON p.model_id = e.model_id AND p.id = e.parent_id)
SELECT model_id, ord, 'INVALID_HIERARCHY' AS code, kind || ' element "' || id || '" should not have a parent' AS message, 'parentId' AS field FROM j WHERE kind = 'landscape' AND parent_id IS NOT NULL
UNION ALL SELECT model_id, ord, 'MISSING_CODE_REF', 'Code element "' || id || '" must have a codeRef', 'codeRef' FROM j WHERE kind = 'code' AND NOT has_code_ref
UNION ALL SELECT model_id, ord, 'INVALID_CODE_REF', kind || ' element "' || id || '" should not have a codeRef', 'codeRef' FROM j WHERE kind NOT IN ('code', 'landscape') AND has_code_ref
UNION ALL SELECT model_id, ord, 'INVALID_HIERARCHY', kind || ' element "' || id || '" must have a parent of kind "' || expected || '"', 'parentId' FROM j WHERE kind <> 'landscape' AND parent_id IS NULL
UNION ALL SELECT model_id, ord, 'INVALID_HIERARCHY', kind || ' element "' || id || '" parent must be ' || expected || ', but got ' || parent_kind, 'parentId' FROM j WHERE kind <> 'landscape' AND parent_kind <> expected)"""
_L = """SELECT model_id, 'layout' AS rule, 'MISSING_LAYOUT' AS code, 'View "' || id || '" is missing required layout. Add a layout object with algorithm, nodes, and edges.' AS message, 'views[' || ord || '].layout' AS path, 'error' AS severity FROM views WHERE NOT has_layout"""
_A = """SELECT model_id, 'attributes' AS rule, 'INVALID_ATTRIBUTE' AS code, message, 'elements[' || ord || '].' || field AS path, severity FROM (
SELECT model_id, ord, '"isExternal" is only valid on system elements, but element "' || id || '" has kind "' || kind || '"' AS message, 'isExternal' AS field, 'error' AS severity FROM elements WHERE is_external IS NOT NULL AND kind <> 'system'
UNION ALL SELECT model_id, ord, '"containerSubtype" is only valid on container elements, but element "' || id || '" has kind "' || kind || '"', 'containerSubtype', 'error' FROM elements WHERE container_subtype IS NOT NULL AND kind <> 'container'
UNION ALL SELECT model_id, ord, 'Element "' || id || '" is external; "formatting" is ignored for external system elements', 'formatting', 'warning' FROM elements WHERE is_external AND background_color IS NOT NULL
UNION ALL SELECT model_id, ord, '"formatting.backgroundColor" must be a 6-digit hex color (e.g. "#1168bd"), got "' || background_color || '" on element "' || id || '"', 'formatting.backgroundColor', 'error' FROM elements WHERE NOT regexp_matches(background_color, '^#[0-9a-fA-F]{6}$'))"""
_C = """SELECT model_id, 'attributes' AS rule, 'INVALID_ATTRIBUTE' AS code, 'Element "' || id || '" cannot be a child of external system "' || parent_id || '"' AS message, 'elements[' || ord || '].parentId' AS path, 'error' AS severity FROM elements e WHERE EXISTS (SELECT 1 FROM elements x WHERE x.model_id = e.model_id AND x.id = e.parent_id AND x.kind = 'system' AND x.is_external)"""


@query(f"{CORPUS} {_IDS}")
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, rels, *_ = corpus(spark, sf_dir)
    return rules.duplicate_ids(elements, rels)


@query(f"{CORPUS} {_REFS}")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, rels, _, nodes, edges = corpus(spark, sf_dir)
    return rules.dangling_references(elements, rels, nodes, edges)


@query(f"{CORPUS} {_H}")
def hierarchy_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.hierarchy_violations(corpus(spark, sf_dir)[0])


@query(f"{CORPUS} {_L}")
def layout_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.layout_missing(corpus(spark, sf_dir)[2])


@query(f"{CORPUS} {_A}")
def attribute_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.attribute_violations(corpus(spark, sf_dir)[0])


@query(f"{CORPUS} {_C}")
def children_of_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.children_of_external(corpus(spark, sf_dir)[0])


@query(f"{CORPUS} SELECT model_id, rule, code, severity, count(*) AS n FROM ({' UNION ALL '.join(f'(SELECT * FROM ({x}))' for x in (_IDS, _REFS, _H, _L, _A, _C))}) GROUP BY ALL")
def violations_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.count_by_code(rules.violations(*corpus(spark, sf_dir)))


_KEY = "TRY_CAST(split_part(substr(id, 3), '.', 1) AS BIGINT)"
_AFTER = CORPUS.replace("WITH elements AS (", "WITH elements AS (SELECT * REPLACE (CASE WHEN id LIKE 's:%' AND {k} % 5 = 0 THEN 'component' ELSE kind END AS kind) FROM (").replace("), relationships AS (", ") WHERE NOT (id LIKE 'c:%' AND {k} % 9 = 0)), relationships AS (SELECT * FROM (", 1).replace("), views AS (", ") WHERE {k} % 8 <> 0), views AS (", 1).replace("{k}", _KEY)


@query(f"{_AFTER} {' UNION ALL '.join(f'SELECT * FROM ({x})' for x in (_IDS, _REFS, _H, _L, _A, _C))}")
def revalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Violations after customers and edges have gone and suppliers have changed their kind, from those before: only rows
    that changed, or that name what changed, are judged again."""
    before = corpus(spark, sf_dir)
    elements, rels, *rest = before
    number = F.substring_index(F.substring("id", 3, 99), ".", 1).try_cast("long")
    gone, altered, cut = F.col("id").startswith("c:") & (number % 9 == 0), F.col("id").startswith("s:") & (number % 5 == 0), number % 8 == 0
    after = (elements.filter(~gone).withColumn("kind", F.when(altered, "component").otherwise(F.col("kind"))), rels.filter(~cut), *rest)
    changed = elements.filter(gone | altered).select("model_id", "id").unionByName(rels.filter(cut).select("model_id", "id"))
    return rules.revalidate(rules.violations(*before), before, after, changed)


# Layout and drawing tables.


def placed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    elements, rels = estate(spark, sf_dir)
    return elements, rels, a.load(spark, sf_dir, a.LAYOUT_NODES)


@query(PRE + """, g AS (SELECT model_id, id, row_number() OVER (PARTITION BY model_id ORDER BY ord) - 1 AS n FROM elements)
SELECT model_id, id AS element_id, (50 + (n % 3) * 150)::DOUBLE AS x, (50 + (n // 3) * 150)::DOUBLE AS y, 120.0::DOUBLE AS w, 80.0::DOUBLE AS h FROM g""")
def grid_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place for every element of the estate."""
    return layout.grid_layout(layout.place_in_model(estate(spark, sf_dir)[0]), F.col("nth"))


@query(PRE + " SELECT model_id, id AS relationship_id FROM relationships WHERE source_id IN (SELECT id FROM elements) AND target_id IN (SELECT id FROM elements)")
def layout_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements, rels = estate(spark, sf_dir)
    return layout.layout_edges(rels, elements)


@query(PRE + TOP + LIFT + """, r AS (SELECT * FROM derived),
n AS (SELECT element_id, x, y, coalesce(w, 120) AS w, coalesce(h, 80) AS h, x + coalesce(w, 120) / 2 AS cx, y + coalesce(h, 80) / 2 AS cy FROM nodes),
j AS (SELECT r.id, r.action, r.integration_mode, s.*, t.x AS tx, t.y AS ty, t.w AS tw, t.h AS th, t.cx AS tcx, t.cy AS tcy FROM r JOIN n s ON s.element_id = r.source_id JOIN n t ON t.element_id = r.target_id),
k AS (SELECT *, least(CASE WHEN tcx <> cx THEN w / 2 / abs(tcx - cx) ELSE 1e300 END, CASE WHEN tcy <> cy THEN h / 2 / abs(tcy - cy) ELSE 1e300 END) AS s1, least(CASE WHEN tcx <> cx THEN tw / 2 / abs(tcx - cx) ELSE 1e300 END, CASE WHEN tcy <> cy THEN th / 2 / abs(tcy - cy) ELSE 1e300 END) AS s2 FROM j),
p AS (SELECT *, CASE WHEN s1 < 1e300 THEN cx + (tcx - cx) * s1 ELSE cx END AS fx, CASE WHEN s1 < 1e300 THEN cy + (tcy - cy) * s1 ELSE cy END AS fy, CASE WHEN s2 < 1e300 THEN tcx + (cx - tcx) * s2 ELSE tcx END AS gx, CASE WHEN s2 < 1e300 THEN tcy + (cy - tcy) * s2 ELSE tcy END AS gy FROM k)
SELECT 'estate' AS model_id, 'main' AS view_id, id, round(fx, 6) AS from_x, round(fy, 6) AS from_y, round(gx, 6) AS to_x, round(gy, 6) AS to_y, round((fx + gx) / 2, 6) AS mid_x, round((fy + gy) / 2, 6) AS mid_y, round(atan2(gy - fy, gx - fx), 6) AS angle,
       nullif(concat_ws(chr(10), nullif(action, ''), '[' || nullif(integration_mode, '') || ']'), '') AS label, round(least(fx, gx) - 20, 6) AS hit_x0, round(least(fy, gy) - 20, 6) AS hit_y0, round(greatest(fx, gx) + 20, 6) AS hit_x1, round(greatest(fy, gy) + 20, 6) AS hit_y1 FROM p""")
def edge_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines between nations and users, of the edges lifted to them."""
    elements, rels, nodes = placed(spark, sf_dir)
    lifted = views.derived_relationships(rels, elements, views.visible_elements(elements, "landscape"))
    return layout.edge_route(lifted, nodes, elements)


@query(PRE + """, pts AS (SELECT event_id AS point_id, 30.0 + (event_id * 37) % 1700 AS px, 30.0 + (event_id * 53) % 1700 AS py, 'n:' || (event_id % 25)::VARCHAR AS exclude_id FROM events)
SELECT 'estate' AS model_id, 'main' AS view_id, point_id, arg_min(element_id, ord) AS element_id FROM pts JOIN nodes ON px BETWEEN x AND x + coalesce(w, 120) AND py BETWEEN y AND y + coalesce(h, 80) AND element_id <> exclude_id GROUP BY point_id""")
def point_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda k: (30 + (F.col("event_id") * k) % 1700).cast("double")
    points = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("estate").alias("model_id"), F.lit("main").alias("view_id"), F.col("event_id").alias("point_id"), at(37).alias("px"), at(53).alias("py"), F.concat(F.lit("n:"), (F.col("event_id") % 25).cast("string")).alias("exclude_id"))
    return layout.point_hits(points, a.load(spark, sf_dir, a.LAYOUT_NODES))


@query("SELECT CASE WHEN z <= 0.2 THEN 'landscape' WHEN z <= 0.4 THEN 'system' WHEN z <= 0.6 THEN 'container' WHEN z <= 0.8 THEN 'component' ELSE 'code' END AS level, count(*) AS n FROM (SELECT l_quantity / 40 - 0.1 AS z FROM lineitem) GROUP BY 1")
def semantic_zoom_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select((F.col("l_quantity") / 40 - 0.1).alias("z"))
    return z.groupBy(layout.semantic_zoom(F.col("z")).alias("level")).agg(F.count("*").alias("n"))


@query(PRE + f", z(level, lo, hi) AS ({dimensions.values_sql(dimensions.ZOOM)}) SELECT e.id, e.kind AS level, coalesce(lo, 0.0)::DOUBLE AS min_zoom, coalesce(hi, 0.2)::DOUBLE AS max_zoom FROM elements e LEFT JOIN z ON z.level = e.kind")
def zoom_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.zoom_range(estate(spark, sf_dir)[0].select("id", F.col("kind").alias("level")))


@query(PRE + f""", d(level, adds_kind, parent_level, child_level, title) AS ({dimensions.values_sql(dimensions.LEVELS)})
SELECT e.id, d.level, adds_kind, parent_level, child_level, child_level IS NOT NULL AS can_drill_down, parent_level IS NOT NULL AS can_drill_up, CASE WHEN e.name <> '' THEN title || ': ' || e.name ELSE title END AS level_title FROM elements e JOIN d ON d.level = e.kind""")
def level_dim_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = layout.with_level(estate(spark, sf_dir)[0].select("id", "name", F.col("kind").alias("level")), F.col("name"))
    return rows.drop("name")


@query(PRE + f" SELECT model_id, id, CASE WHEN coalesce(is_external, false) OR kind = 'person' THEN NULL WHEN kind IN ('system', 'person') AND parent_id IS DISTINCT FROM 'r:1' THEN 'system' ELSE 'container' END AS target_level FROM elements")
def drill_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.drill_target(estate(spark, sf_dir)[0], "system", "r:1")


POSITIONS = """, ranked AS (SELECT *, row_number() OVER (ORDER BY first_ord, id) AS n FROM externals),
outer_nodes AS (SELECT r.model_id, 'main' AS view_id, r.id AS element_id, coalesce(o.x, (SELECT min(x) FROM nodes WHERE element_id IN (SELECT id FROM visible)) - 280, 50)::DOUBLE AS x, coalesce(o.y, 50 + 180.0 * (n - 1))::DOUBLE AS y, 200.0::DOUBLE AS w, 130.0::DOUBLE AS h FROM ranked r LEFT JOIN stored o ON o.element_id = r.id)"""
SOME = ", visible AS (SELECT * FROM elements WHERE kind = 'system' AND parent_id IN ('r:1', 'r:2')), stored AS (SELECT * FROM nodes WHERE element_id IN ('n:0', 'n:6', 'n:10'))"


def some_systems(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    """The systems of two regions, what lies outside them, and positions stored for a few of those."""
    elements, rels, nodes = placed(spark, sf_dir)
    visible = elements.filter("kind = 'system' AND parent_id IN ('r:1', 'r:2')")
    external = views.external_elements(rels, elements, visible)
    stored = nodes.filter(F.col("element_id").isin("n:0", "n:6", "n:10"))
    return elements, nodes, visible, external, stored


@query(PRE + SOME + LIFT + POSITIONS + " SELECT * FROM outer_nodes")
def external_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, visible, external, stored = some_systems(spark, sf_dir)
    return views.external_positions(nodes, external, stored, visible)


@query(PRE + SOME + LIFT + POSITIONS + " SELECT model_id, view_id, element_id, x, y, w, h FROM nodes WHERE element_id IN (SELECT id FROM visible) UNION ALL SELECT * FROM outer_nodes")
def view_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, visible, external, stored = some_systems(spark, sf_dir)
    return views.view_nodes(nodes, visible, views.external_positions(nodes, external, stored, visible))


@query(PRE + SOME + LIFT + """ SELECT model_id, view_id, min(x) - 24 AS x, min(y) - 24 AS y, max(x + coalesce(w, 120)) - min(x) + 48 AS width, max(y + coalesce(h, 80)) - min(y) + 48 AS height, 'System Boundary: Two regions' AS label
FROM nodes WHERE element_id IN (SELECT id FROM visible) AND EXISTS (SELECT 1 FROM externals) GROUP BY model_id, view_id""")
def boundary_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, nodes, visible, external, _ = some_systems(spark, sf_dir)
    return views.boundary_box(nodes, visible, external, views.boundary_label(F.lit("system"), F.lit("Two regions")))


@query(PRE + f""", pal(kind, bg, border, font) AS ({dimensions.values_sql(dimensions.PALETTE)}),
s AS (SELECT u.*, lpad('', (hash_len * 17 + 70)::INT, 'ab') AS description FROM (SELECT *, length(name) AS hash_len FROM uniq) u),
placed AS (SELECT model_id, 'v' AS view_id, id AS element_id, CASE WHEN kind = 'system' THEN 150.0 END AS w FROM s), outside AS (SELECT id FROM s WHERE kind = 'person')
SELECT s.model_id, 'v' AS view_id, s.id AS element_id, CASE WHEN coalesce(is_external, false) THEN '[External System]' WHEN o.id IS NOT NULL THEN '[External ' || s.kind || ']' WHEN s.kind = 'system' THEN '[Software System]' WHEN s.kind = 'container' AND container_subtype IS NOT NULL THEN '[Container: JVM]' WHEN s.kind = 'container' THEN '[Container]' WHEN s.kind = 'landscape' THEN '[Landscape]' WHEN s.kind = 'component' THEN '[Component]' ELSE '[Code]' END AS tag,
       CASE WHEN length(description) > 80 THEN substr(description, 1, 80) || '…' ELSE description END AS short_description,
       CASE WHEN coalesce(is_external, false) THEN '#fff3e0' WHEN o.id IS NOT NULL THEN '#ffffff' WHEN container_subtype IS NOT NULL THEN '#aabbcc' ELSE coalesce(bg, '{dimensions.OTHER_COLOURS[0]}') END AS background, CASE WHEN coalesce(is_external, false) THEN '#8a0000' WHEN o.id IS NOT NULL THEN '#999999' ELSE coalesce(border, '{dimensions.OTHER_COLOURS[1]}') END AS border,
       CASE WHEN coalesce(is_external, false) THEN '#8a0000' WHEN o.id IS NOT NULL THEN '#888888' ELSE coalesce(font, '{dimensions.OTHER_COLOURS[2]}') END AS font, CASE WHEN s.kind = 'container' AND container_subtype IS NOT NULL THEN container_subtype ELSE 'rounded' END AS shape,
       CASE WHEN coalesce(is_external, false) OR o.id IS NOT NULL THEN 1.5 ELSE 2.5 END::DOUBLE AS line_width, coalesce(p.w, 200)::DOUBLE AS w, 130.0::DOUBLE AS h
FROM placed p JOIN s ON s.id = p.element_id LEFT JOIN outside o ON o.id = s.id LEFT JOIN pal ON pal.kind = s.kind""")
def node_style(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = estate(spark, sf_dir)[0]
    null = F.lit(None).cast("string")
    own = F.col("container_subtype").isNotNull()
    elements = elements.withColumns({"description": F.lpad(F.lit(""), F.length("name") * 17 + 70, F.lit("ab")), "technology": F.when(own, "JVM"), "component_type": null, "formatting": F.when(own, F.struct(F.lit("#aabbcc").alias("background_color"), null.alias("border_color"), null.alias("font_color")))})
    nodes = elements.select("model_id", F.lit("v").alias("view_id"), F.col("id").alias("element_id"), F.when(F.col("kind") == "system", F.lit(150.0)).alias("w"), F.lit(None).cast("double").alias("h")).distinct()
    return layout.node_style(nodes, elements, elements.filter("kind = 'person'"))


# All views at once.

_SHOWN = """, shown(view_id, id) AS (SELECT DISTINCT 'landscape', id FROM elements WHERE kind IN ('system', 'person') UNION SELECT 'in ' || parent_id, id FROM elements WHERE kind IN ('container', 'component')),
nv AS (SELECT view_id, c.id, arg_min(c.anc, c.depth) AS v FROM closure c JOIN shown s ON s.id = c.anc GROUP BY ALL),
sa AS (SELECT c.id, arg_min(c.anc, c.depth) AS s FROM closure c JOIN uniq u ON u.id = c.anc AND u.kind IN ('system', 'person') GROUP BY c.id),
met AS (SELECT r.id AS rel, view_id FROM relationships r JOIN nv ON nv.id = r.source_id UNION SELECT r.id, view_id FROM relationships r JOIN nv ON nv.id = r.target_id),
rows AS (
  SELECT r.*, m.view_id, n1.v AS v1, n2.v AS v2, CASE WHEN n1.v IS NULL AND h1.id IS NULL THEN s1.s END AS o1, CASE WHEN n2.v IS NULL AND h2.id IS NULL THEN s2.s END AS o2
  FROM (SELECT * FROM relationships) r JOIN met m ON m.rel = r.id LEFT JOIN nv n1 ON n1.view_id = m.view_id AND n1.id = r.source_id LEFT JOIN nv n2 ON n2.view_id = m.view_id AND n2.id = r.target_id
  LEFT JOIN sa s1 ON s1.id = r.source_id LEFT JOIN sa s2 ON s2.id = r.target_id LEFT JOIN shown h1 ON h1.view_id = m.view_id AND h1.id = s1.s LEFT JOIN shown h2 ON h2.view_id = m.view_id AND h2.id = s2.s WHERE n1.v IS NOT NULL OR n2.v IS NOT NULL),
lifts AS (SELECT *, coalesce(v1, o1) AS src, coalesce(v2, o2) AS tgt, coalesce(v1 = source_id AND v2 = target_id, false) AS direct, coalesce(o1, o2) AS ext FROM rows),
kept AS (SELECT * FROM lifts WHERE direct OR (src IS NOT NULL AND tgt IS NOT NULL AND src <> tgt))"""


def every_view(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A view of the landscape, one inside each system, and one inside each container that has components."""
    elements, rels = estate(spark, sf_dir)
    inside = elements.filter(F.col("kind").isin("container", "component")).select("model_id", F.concat(F.lit("in "), "parent_id").alias("view_id"), "id")
    top = elements.filter(F.col("kind").isin("system", "person")).select("model_id", F.lit("landscape").alias("view_id"), "id")
    return elements, rels, top.unionByName(inside)


@query(PRE + _SHOWN + """, pairs AS (SELECT view_id, src, tgt, bool_or(direct) AS direct, arg_min(id, (ord, id)) AS first, arg_min(type, (ord, id)) AS type FROM kept GROUP BY ALL)
SELECT model_id, view_id, id, source_id, target_id, type, CAST(NULL AS VARCHAR) AS original_id FROM kept WHERE direct UNION ALL SELECT 'estate', view_id, 'derived-' || src || '-' || tgt, src, tgt, type, first FROM pairs WHERE NOT direct""")
def every_view_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of the estate's views shows of its edges, thousands of views in one pass."""
    elements, rels, visible = every_view(spark, sf_dir)
    return all_views.view_relationships(all_views.lifted(rels, elements, visible), "type")


@query(PRE + _SHOWN + """, ranked AS (SELECT view_id, ext, row_number() OVER (PARTITION BY view_id ORDER BY first, ext) - 1 AS n FROM (SELECT view_id, ext, min(kept.ord) AS first FROM kept JOIN uniq u ON u.id = ext WHERE NOT direct GROUP BY ALL)),
placed AS (SELECT s.view_id, s.id AS element_id, (100 + length(s.id) * 10)::DOUBLE AS x, (length(s.view_id) * 10)::DOUBLE AS y FROM shown s)
SELECT 'estate' AS model_id, view_id, element_id, x, y, CAST(NULL AS DOUBLE) AS w, CAST(NULL AS DOUBLE) AS h FROM placed UNION ALL
SELECT 'estate', r.view_id, ext, coalesce((SELECT min(x) FROM placed p WHERE p.view_id = r.view_id) - 280, 50), CASE WHEN ext = 'n:3' THEN 77 ELSE 50 + 180.0 * n END, 200, 130 FROM ranked r""")
def every_view_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of each of the estate's views, external elements placed beside them; one of those has a stored height."""
    elements, rels, visible = every_view(spark, sf_dir)
    external = kept(all_views.external_elements(all_views.lifted(rels, elements, visible), elements))
    null = F.lit(None).cast("double")
    nodes = visible.select("model_id", "view_id", F.col("id").alias("element_id"), (100 + F.length("id") * 10).cast("double").alias("x"), (F.length("view_id") * 10).cast("double").alias("y"), null.alias("w"), null.alias("h")).distinct()
    stored = external.filter("id = 'n:3'").select("model_id", "view_id", F.col("id").alias("element_id"), null.alias("x"), F.lit(77.0).alias("y"))
    return all_views.view_nodes(nodes, visible, all_views.external_positions(nodes, external, stored, visible))


_QUERIES = "SELECT c_custkey AS query_id, CASE WHEN c_custkey = 1 THEN '  ' WHEN c_custkey % 300 = 2 THEN 'N' || (c_custkey % 7)::VARCHAR WHEN c_custkey % 40 = 3 THEN 'ER ' || c_custkey::VARCHAR WHEN c_custkey % 40 = 4 THEN 'nothing ' || c_name ELSE upper(right(c_name, 6)) END AS q FROM customer"


@query(PRE + OPTIONS + f", q AS ({_QUERIES}) SELECT query_id, o.id FROM q JOIN options o ON trim(q) = '' OR contains(lower(label), lower(q)) OR contains(lower(coalesce(sublabel, '')), lower(q))")
def search_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query for each customer, one of them blank and some of two characters, against all options."""
    options = views.element_options(estate(spark, sf_dir)[0])
    text = "CASE WHEN c_custkey = 1 THEN '  ' WHEN c_custkey % 300 = 2 THEN concat('N', CAST(c_custkey % 7 AS STRING)) WHEN c_custkey % 40 = 3 THEN concat('ER ', CAST(c_custkey AS STRING)) WHEN c_custkey % 40 = 4 THEN concat('nothing ', c_name) ELSE upper(right(c_name, 6)) END"
    queries = spark.read.parquet(f"{sf_dir}/customer.parquet").selectExpr("c_custkey AS query_id", "'estate' AS model_id", f"{text} AS query")
    return views.search_many(options, queries).select("query_id", "id")
