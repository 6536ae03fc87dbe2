"""Queries of bulk edits, catalogs and text corpora over the supplied tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog, edits, hierarchy, text
from ..operators.edits import tagged
from . import adapters as a
from .queries import PRE, estate, query

EDGES = ", edges AS (SELECT model_id, 'main' AS view_id, ord, id AS relationship_id FROM relationships WHERE action IS NULL OR ord LIKE '%1' UNION ALL SELECT 'estate', 'main', '9', 'x:none')"
#: A region, a system and a few containers go.
IDS = ("r:2", "n:7", "c:11", "c:12")
GONE = ", gone AS (SELECT DISTINCT id FROM closure WHERE anc IN ('r:2', 'n:7', 'c:11', 'c:12'))"


def state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    elements, rels = estate(spark, sf_dir)
    nodes = a.load(spark, sf_dir, a.LAYOUT_NODES)
    stray = spark.createDataFrame([("estate", "main", "9", "x:none")], "model_id string, view_id string, ord string, relationship_id string")
    edges = rels.filter("action IS NULL OR ord LIKE '%1'").select("model_id", F.lit("main").alias("view_id"), "ord", F.col("id").alias("relationship_id")).unionByName(stray)
    return elements, rels, nodes, edges


def ids(spark: SparkSession, *values: str) -> DataFrame:
    return spark.createDataFrame([("estate", x) for x in values], "model_id string, id string")


def first_views(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("estate", "main")], "model_id string, view_id string")


def four(elements: DataFrame, rels: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    parts = [tagged("elements", elements, "id", "ord", "name", "is_external"), tagged("relationships", rels, "id", "ord", "type"), tagged("nodes", nodes, "element_id", F.col("x").cast("int"), F.col("y").cast("int")), tagged("edges", edges, "relationship_id", "ord")]
    return reduce(DataFrame.unionByName, parts)


_CELL = "coalesce(CAST({} AS STRING), '-')"


def _tag(table: str, *columns: str) -> str:
    return f"'{table}' AS table_name, concat_ws('|', {', '.join(_CELL.format(c) for c in columns)}) AS row"


def _four(element_where: str, external: str = "is_external") -> str:
    kept = "source_id NOT IN (SELECT id FROM gone) AND target_id NOT IN (SELECT id FROM gone)"
    return f"""SELECT {_tag('elements', 'id', 'ord', 'name', external)} FROM elements WHERE {element_where} UNION ALL SELECT {_tag('relationships', 'id', 'ord', 'type')} FROM relationships WHERE {kept}
UNION ALL SELECT {_tag('nodes', 'element_id', 'x::INT', 'y::INT')} FROM nodes WHERE element_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT {_tag('edges', 'relationship_id', 'ord')} FROM edges WHERE relationship_id IN (SELECT id FROM relationships WHERE {kept})"""


@query(PRE + EDGES + GONE + " " + _four("id NOT IN (SELECT id FROM gone)"))
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return four(*edits.cascade_delete(*state(spark, sf_dir), ids(spark, *IDS)))


@query(PRE + EDGES + ", gone AS (SELECT DISTINCT id FROM closure WHERE anc IN ('n:7', 'n:8') AND depth > 0) " + _four("id NOT IN (SELECT id FROM gone)", "CASE WHEN id IN ('n:7', 'n:8') THEN true ELSE is_external END"))
def mark_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    return four(*edits.mark_external(*state(spark, sf_dir), ids(spark, "n:7", "n:8")))


@query(PRE + EDGES + f" SELECT {_tag('relationships', 'id', 'ord')} FROM relationships WHERE id NOT IN (SELECT id FROM relationships WHERE type = 'R') UNION ALL SELECT {_tag('edges', 'relationship_id', 'ord')} FROM edges WHERE relationship_id NOT IN (SELECT id FROM relationships WHERE type = 'R')")
def remove_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rels, _, edges = state(spark, sf_dir)
    rels, edges = edits.remove_relationships(rels, edges, rels.filter("type = 'R'").select("model_id", "id"))
    return tagged("relationships", rels, "id", "ord").unionByName(tagged("edges", edges, "relationship_id", "ord"))


def new_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relationship from each supplier to its first part's orders' users, without a type for even keys."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return s.selectExpr("'estate' AS model_id", "concat('9', lpad(CAST(s_suppkey AS STRING), 12, '0')) AS ord", "concat('new:', CAST(s_suppkey AS STRING)) AS id", "concat('s:', CAST(s_suppkey AS STRING)) AS source_id", "concat('n:', CAST(s_nationkey AS STRING)) AS target_id", "CASE WHEN s_suppkey % 2 = 1 THEN 'reads' END AS type", "'calls' AS action", "CAST(NULL AS STRING) AS integration_mode", "'main' AS view_id")


_NEW = "SELECT concat('9', lpad(CAST(s_suppkey AS STRING), 12, '0')) AS ord, concat('new:', CAST(s_suppkey AS STRING)) AS id, concat('s:', CAST(s_suppkey AS STRING)) AS source_id, concat('n:', CAST(s_nationkey AS STRING)) AS target_id, CASE WHEN s_suppkey % 2 = 1 THEN 'reads' ELSE 'relates_to' END AS type FROM supplier"


@query(PRE + EDGES + f", fresh AS ({_NEW}) SELECT {_tag('relationships', 'id', 'ord', 'source_id', 'target_id', 'type')} FROM (SELECT ord, id, source_id, target_id, type FROM relationships UNION ALL SELECT * FROM fresh) UNION ALL SELECT {_tag('edges', 'relationship_id', 'ord')} FROM (SELECT relationship_id, ord FROM edges UNION ALL SELECT id, ord FROM fresh)")
def add_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rels, _, edges = state(spark, sf_dir)
    rels, edges = edits.add_relationships(rels, edges, new_relationships(spark, sf_dir))
    return tagged("relationships", rels, "id", "ord", "source_id", "target_id", "type").unionByName(tagged("edges", edges, "relationship_id", "ord"))


@query(PRE + ", e AS (SELECT * FROM elements), u AS (SELECT id, 'Renamed ' || name AS name FROM e WHERE kind = 'system'), fresh AS (SELECT 'f:' || CAST(p_partkey AS STRING) AS id, '9' || CAST(p_partkey AS STRING) AS ord, p_name AS name FROM part) SELECT e.id, e.ord, coalesce(u.name, e.name) AS name FROM e LEFT JOIN u ON u.id = e.id UNION ALL SELECT * FROM (SELECT id, ord, name FROM fresh)")
def upsert_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Systems are renamed in their place; parts come as containers that weren't there."""
    elements = estate(spark, sf_dir)[0]
    renamed = elements.filter("kind = 'system'").withColumn("name", F.concat(F.lit("Renamed "), "name")).withColumn("ord", F.concat(F.lit("9"), "ord"))
    fresh = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("'estate' AS model_id", "concat('9', CAST(p_partkey AS STRING)) AS ord", "concat('f:', CAST(p_partkey AS STRING)) AS id", "'container' AS kind", "p_name AS name", "CAST(NULL AS STRING) AS parent_id", "CAST(NULL AS STRING) AS container_subtype", "CAST(NULL AS BOOLEAN) AS is_external")
    return edits.upsert_elements(elements, renamed.unionByName(fresh)).select("id", "ord", "name")


@query("""WITH m AS (SELECT n_nationkey, 'm' || n_nationkey::VARCHAR AS model_id FROM nation), had AS (SELECT model_id, count(*) AS n FROM (SELECT 'm' || n_nationkey::VARCHAR AS model_id FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'm' || s_nationkey::VARCHAR FROM supplier) GROUP BY 1),
new AS (SELECT 'm' || c_nationkey::VARCHAR AS model_id, c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'system' ELSE 'container' END AS kind, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS nth FROM customer),
made AS (SELECT DISTINCT model_id FROM new WHERE kind = 'system' AND model_id NOT IN (SELECT 'm' || n_nationkey::VARCHAR FROM nation WHERE n_nationkey % 3 = 0))
SELECT 'elements' AS table_name, concat_ws('|', model_id, id, coalesce(parent_id, '-')) AS row FROM (
  SELECT 'm' || n_nationkey::VARCHAR AS model_id, 'top' AS id, NULL AS parent_id FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'm' || s_nationkey::VARCHAR, 's:' || s_suppkey::VARCHAR, NULL FROM supplier
  UNION ALL SELECT model_id, 'landscape-1', NULL FROM made UNION ALL SELECT n.model_id, 'k:' || c_custkey::VARCHAR, CASE WHEN kind = 'container' THEN NULL WHEN n.model_id IN (SELECT model_id FROM made) THEN 'landscape-1' ELSE 'top' END FROM new n)
UNION ALL SELECT 'nodes', concat_ws('|', n.model_id, 'k:' || c_custkey::VARCHAR, (100 + 30 * k)::INT::VARCHAR, (100 + 20 * k)::INT::VARCHAR) FROM (SELECT n.*, nth + coalesce(h.n, 0) + CASE WHEN n.model_id IN (SELECT model_id FROM made) THEN 1 ELSE 0 END AS k FROM new n LEFT JOIN had h USING (model_id)) n""")
def add_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer becomes a system or container of its nation's model; a third of the models have a landscape."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    model = lambda k: f"concat('m', CAST({k} AS STRING)) AS model_id"
    tops = read("nation").filter("n_nationkey % 3 = 0").selectExpr(model("n_nationkey"), "'0' AS ord", "'top' AS id", "'landscape' AS kind", "n_name AS name", "CAST(NULL AS STRING) AS parent_id")
    suppliers = read("supplier").selectExpr(model("s_nationkey"), "lpad(CAST(s_suppkey AS STRING), 12, '1') AS ord", "concat('s:', CAST(s_suppkey AS STRING)) AS id", "'container' AS kind", "s_name AS name", "CAST(NULL AS STRING) AS parent_id")
    new = read("customer").selectExpr(model("c_nationkey"), "concat('9', lpad(CAST(c_custkey AS STRING), 12, '0')) AS ord", "concat('k:', CAST(c_custkey AS STRING)) AS id", "CASE WHEN c_custkey % 2 = 0 THEN 'system' ELSE 'container' END AS kind", "c_name AS name", "CAST(NULL AS STRING) AS focus_id")
    views = read("nation").selectExpr(model("n_nationkey"), "'main' AS view_id")
    nodes = spark.createDataFrame([], "model_id string, view_id string, ord string, element_id string, x double, y double, w double, h double")
    elements, nodes = edits.add_elements(tops.unionByName(suppliers), nodes, new, views)
    return tagged("elements", elements, "model_id", "id", "parent_id").unionByName(tagged("nodes", nodes, "model_id", "element_id", F.col("x").cast("int"), F.col("y").cast("int")))


@query(PRE + ", last AS (SELECT 'n:' || (user_id % 25)::VARCHAR AS element_id, arg_max(event_id, event_id) AS e FROM events GROUP BY 1) SELECT n.element_id, CASE WHEN l.e IS NOT NULL THEN (l.e % 900)::DOUBLE ELSE n.x END AS x, CASE WHEN l.e IS NOT NULL THEN (l.e % 700)::DOUBLE ELSE n.y END AS y FROM nodes n LEFT JOIN last l ON l.element_id = n.element_id")
def move_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event drags a nation's node; the last one stays."""
    moves = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("estate").alias("model_id"), F.concat(F.lit("n:"), (F.col("user_id") % 25).cast("string")).alias("element_id"), (F.col("event_id") % 900).cast("double").alias("x"), (F.col("event_id") % 700).cast("double").alias("y"), F.col("event_id").alias("ord"))
    return edits.move_nodes(a.load(spark, sf_dir, a.LAYOUT_NODES), moves, first_views(spark)).select("element_id", "x", "y")


@query(PRE + f""", back AS (SELECT 'e:' || event_id::VARCHAR AS id, event_id FROM events), fresh AS ({_NEW}),
out_rels AS (SELECT r.id, r.ord, CASE WHEN b.id IS NOT NULL THEN 'n:1' ELSE source_id END AS source_id, target_id, CASE WHEN b.id IS NOT NULL THEN 'edited' ELSE action END AS action FROM relationships r LEFT JOIN back b ON b.id = r.id UNION ALL SELECT id, ord, source_id, target_id, 'calls' FROM fresh),
ends AS (SELECT ord, 0 AS side, source_id AS element_id FROM fresh UNION ALL SELECT ord, 1, target_id FROM fresh), lost AS (SELECT element_id, arg_min(side, ord || side::VARCHAR) AS side FROM ends WHERE element_id NOT IN (SELECT element_id FROM nodes) GROUP BY 1)
SELECT {_tag('relationships', 'id', 'ord', 'source_id', 'target_id', 'action')} FROM out_rels UNION ALL SELECT {_tag('nodes', 'element_id', 'x::INT', 'y::INT', 'w::INT', 'h::INT')} FROM (SELECT element_id, x, y, w, h FROM nodes UNION ALL SELECT element_id, 600 + 250 * side, 80, 200, 130 FROM lost)""")
def save_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits of derived edges go back to every event; suppliers' new edges come with nodes."""
    _, rels, nodes, _ = state(spark, sf_dir)
    own = [c for c in rels.columns]
    back = rels.filter("id LIKE 'e:%'").select(*own).withColumns({"original_id": F.col("id"), "source_id": F.lit("n:1"), "action": F.lit("edited")}).withColumn("id", F.concat(F.lit("derived-"), "id"))
    fresh = new_relationships(spark, sf_dir).select(*own).withColumn("original_id", F.lit(None).cast("string"))
    rels, nodes = edits.save_relationships(rels, nodes, back.unionByName(fresh), first_views(spark))
    return tagged("relationships", rels, "id", "ord", "source_id", "target_id", "action").unionByName(tagged("nodes", nodes, "element_id", *[F.col(c).cast("int") for c in ("x", "y", "w", "h")]))


@query("""WITH last AS (SELECT user_id, arg_max(event_type, event_id) AS op, max(event_id) AS e FROM events GROUP BY 1), elements AS (SELECT 'u:' || user_id::VARCHAR AS id, 'User' AS name FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0))
SELECT coalesce(e.id, 'u:' || l.user_id::VARCHAR) AS id, CASE WHEN l.op IN ('signup', 'click', 'purchase') THEN 'Changed by ' || l.e::VARCHAR ELSE e.name END AS name FROM elements e FULL JOIN last l ON e.id = 'u:' || l.user_id::VARCHAR
WHERE coalesce(l.op, '') <> 'error' AND (e.id IS NOT NULL OR l.op IN ('signup', 'click', 'purchase'))""")
def apply_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change proposals on persons: the last of each user counts."""
    elements, rels, nodes, edges = state(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    had = elements.filter("kind = 'person' AND CAST(substring(id, 3) AS BIGINT) % 2 = 0").withColumn("name", F.lit("User"))
    op = F.when(F.col("event_type") == "signup", "add").when(F.col("event_type").isin("click", "purchase"), "update").when(F.col("event_type") == "error", "delete").otherwise("none")
    null = lambda t: F.lit(None).cast(t)
    element = F.struct(F.lit("person").alias("kind"), F.concat(F.lit("Changed by "), F.col("event_id").cast("string")).alias("name"), null("string").alias("parent_id"), null("string").alias("container_subtype"), null("boolean").alias("is_external"))
    relationship = F.struct(*[null("string").alias(c) for c in ("source_id", "target_id", "type", "action", "integration_mode")])
    changes = events.select(F.lit("estate").alias("model_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ord"), op.alias("op"), F.lit("element").alias("target_type"), F.concat(F.lit("u:"), F.col("user_id").cast("string")).alias("target_id"), element.alias("element"), relationship.alias("relationship"))
    return edits.apply_changes(had, rels, nodes, edges, changes)[0].select("id", "name")


@query("SELECT p_partkey, coalesce(nullif(substr(regexp_replace(regexp_replace(regexp_replace(lower(title), '[^a-z0-9._-]', '-', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g'), 1, 200), ''), 'diagram') AS safe_name FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN '' ELSE '  ' || p_name || ' / (v. ' || p_partkey::VARCHAR || ')! ' END AS title FROM part)")
def safe_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.when(F.col("p_partkey") % 10 == 0, "").otherwise(F.concat(F.lit("  "), "p_name", F.lit(" / (v. "), F.col("p_partkey").cast("string"), F.lit(")! ")))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", catalog.safe_name(title).alias("safe_name"))


@query("""WITH h AS (SELECT user_id, epoch_us(max(ts)) AS v FROM events WHERE event_id % 3 <> 0 GROUP BY 1), f AS (SELECT user_id, epoch_us(max(ts)) AS v FROM events WHERE user_id % 7 <> 0 GROUP BY 1)
SELECT coalesce(h.user_id, f.user_id) AS file_id, CASE WHEN h.user_id % 5 <> 0 THEN h.v END::VARCHAR AS last_known, f.v::VARCHAR AS modified,
       CASE WHEN h.user_id IS NULL THEN 'new' WHEN f.user_id IS NULL THEN 'missing' WHEN h.user_id % 5 <> 0 AND h.v <> f.v THEN 'conflict' ELSE 'clean' END AS status FROM h FULL JOIN f ON h.user_id = f.user_id""")
def sync_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' last events: as a reader who missed every third event knows them, and as they are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = F.unix_micros(F.max(F.col("ts").cast("timestamp")))
    handles = e.filter("event_id % 3 <> 0").groupBy(F.col("user_id").alias("file_id")).agg(last.alias("v")).select("file_id", F.when(F.col("file_id") % 5 != 0, F.col("v")).alias("last_known"))
    files = e.filter("user_id % 7 <> 0").groupBy(F.col("user_id").alias("file_id")).agg(last.alias("modified"))
    return catalog.sync_conflicts(handles.withColumn("last_known", F.col("last_known").cast("string")), files.withColumn("modified", F.col("modified").cast("string")))


SLUG = "regexp_replace(regexp_replace(lower(trim({})), '[ \\t\\r\\n]+', '-', 'g'), '[^a-z0-9-]', '', 'g')"


@query(PRE + f" SELECT c.model_id, c.id, string_agg({SLUG.format('u.name')}, '.' ORDER BY depth DESC) AS slug_id FROM closure c JOIN uniq u ON u.id = c.anc GROUP BY 1, 2")
def slug_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.slug_ids(estate(spark, sf_dir)[0])


NAMED = ", e AS (SELECT model_id, id, ord, CASE WHEN kind = 'component' THEN 'Order ' || right(id, 1) WHEN kind = 'landscape' AND id <> 'r:0' THEN 'Order 3' ELSE name END AS name, CASE WHEN kind = 'landscape' THEN NULL ELSE parent_id END AS parent_id FROM elements)"


def named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The estate, orders named by their last digit, most regions as an order."""
    e = estate(spark, sf_dir)[0]
    name = F.when(F.col("kind") == "component", F.concat(F.lit("Order "), F.substring("id", -1, 1))).when((F.col("kind") == "landscape") & (F.col("id") != "r:0"), "Order 3").otherwise(F.col("name"))
    return e.withColumn("name", name)


_SLUGS = f", slugs AS (SELECT c.model_id, c.id, string_agg({SLUG.format('u.name')}, '.' ORDER BY depth DESC) AS slug FROM closure c JOIN e2 u ON u.id = c.anc GROUP BY 1, 2)"


def _scopes() -> str:
    """Level by level: of the elements whose parent registered, the first of each scope and name registers."""
    steps = []
    for i, kinds in enumerate(("'landscape'", "'system', 'person'", "'container'", "'component'", "'code'")):
        parents = f"AND parent_id IN (SELECT id FROM level{i - 1} WHERE nth = 1)" if i else ""
        steps.append(f"level{i} AS (SELECT k.*, row_number() OVER (PARTITION BY scope, name ORDER BY ord) AS nth FROM k WHERE kind IN ({kinds}) {parents})")
    return ", ".join(steps)


@query(PRE + NAMED + ", e2 AS (SELECT e.model_id, e.id, e.name FROM e QUALIFY row_number() OVER (PARTITION BY e.id ORDER BY e.ord DESC) = 1)" + _SLUGS + f""", k AS (SELECT e.*, u.kind, s.slug AS scope FROM e JOIN uniq u ON u.id = e.id LEFT JOIN slugs s ON s.id = e.parent_id), {_scopes()}
SELECT model_id, id, name, scope FROM ({' UNION ALL '.join(f'SELECT * FROM level{i}' for i in range(5))}) WHERE nth > 1""")
def duplicate_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.duplicate_names(named(spark, sf_dir))


@query(PRE + NAMED + """, names AS (SELECT name, arg_min(id, ord) AS found FROM e GROUP BY 1), r AS (SELECT event_id, 'Order ' || (event_id % 12)::VARCHAR AS s, 'NATION_' || (user_id % 30)::VARCHAR AS t FROM events)
SELECT event_id::VARCHAR AS id, 'ok' AS side, a.found || '>' || b.found AS name FROM r JOIN names a ON a.name = s JOIN names b ON b.name = t UNION ALL SELECT event_id::VARCHAR, 'source', s FROM r WHERE s NOT IN (SELECT name FROM names) UNION ALL SELECT event_id::VARCHAR, 'target', t FROM r WHERE t NOT IN (SELECT name FROM names)""")
def resolve_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rels = e.select(F.lit("estate").alias("model_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ord"), F.col("event_id").cast("string").alias("id"), F.concat(F.lit("Order "), (F.col("event_id") % 12).cast("string")).alias("source"), F.concat(F.lit("NATION_"), (F.col("user_id") % 30).cast("string")).alias("target"))
    found, missing = text.resolve_names(named(spark, sf_dir), rels)
    return found.select("id", F.lit("ok").alias("side"), F.concat("source_id", F.lit(">"), "target_id").alias("name")).unionByName(missing.select("id", "side", "name"))


@query(PRE + ", steps AS (SELECT c.id, max(depth) AS depth, string_agg(u.ord, '/' ORDER BY depth DESC) AS path FROM closure c JOIN uniq u ON u.id = c.anc GROUP BY 1) SELECT id, depth, path FROM steps")
def preorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.preorder(estate(spark, sf_dir)[0]).select("id", "depth", F.array_join("path", "/").alias("path"))


@query(PRE + """, steps AS (SELECT c.id, max(depth) AS depth, array_agg(u.ord ORDER BY depth DESC) AS path FROM closure c JOIN uniq u ON u.id = c.anc GROUP BY 1), sizes AS (SELECT anc AS id, count(*) AS n FROM closure GROUP BY 1),
numbered AS (SELECT id, depth, row_number() OVER (ORDER BY path) - 1 AS entry FROM steps) SELECT id, depth, entry, entry + n - 1 AS exit FROM numbered JOIN sizes USING (id)""")
def preorder_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.intervals(estate(spark, sf_dir)[0]).drop("model_id")


@query(PRE + """, steps AS (SELECT DISTINCT id, anc FROM closure WHERE depth > 0), pairs AS (SELECT source_id, target_id FROM relationships UNION ALL SELECT id, parent_id FROM elements UNION ALL SELECT parent_id, id FROM elements),
found AS (SELECT CASE WHEN s.id IS NULL OR t.id IS NULL THEN NULL WHEN source_id = target_id THEN 'same' WHEN b.id IS NOT NULL THEN 'source' WHEN a.id IS NOT NULL THEN 'target' ELSE 'apart' END AS nesting
  FROM pairs p LEFT JOIN uniq s ON s.id = p.source_id LEFT JOIN uniq t ON t.id = p.target_id LEFT JOIN steps a ON a.id = p.source_id AND a.anc = p.target_id LEFT JOIN steps b ON b.id = p.target_id AND b.anc = p.source_id)
SELECT nesting, count(*) AS n FROM found GROUP BY 1""")
def nested_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the ends of all relationships, and all elements and their parents, stand to each other."""
    elements, rels = estate(spark, sf_dir)
    ends = rels.select("model_id", "source_id", "target_id")
    for a, b in (("id", "parent_id"), ("parent_id", "id")):
        ends = ends.unionByName(elements.select("model_id", F.col(a).alias("source_id"), F.col(b).alias("target_id")))
    return hierarchy.nesting(ends, hierarchy.intervals(elements)).groupBy("nesting").agg(F.count("*").alias("n"))


@query(PRE + """, b AS (SELECT id, CASE WHEN kind = 'person' THEN name || '!' ELSE name END AS name, kind, parent_id FROM uniq WHERE kind <> 'system' UNION ALL SELECT 'p:' || p_partkey::VARCHAR, p_name, 'system', NULL FROM part)
SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'only_left' WHEN a.id IS NULL THEN 'only_right' WHEN a.name = b.name THEN 'equal' ELSE 'changed' END AS status FROM (SELECT * FROM uniq) a FULL JOIN b ON a.id = b.id""")
def model_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = hierarchy.last_by_id(estate(spark, sf_dir)[0], "name", "kind", "parent_id")
    right = left.filter("kind <> 'system'").withColumn("name", F.when(F.col("kind") == "person", F.concat("name", F.lit("!"))).otherwise(F.col("name")))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("'estate' AS model_id", "concat('p:', CAST(p_partkey AS STRING)) AS id", "p_name AS name", "'system' AS kind", "CAST(NULL AS STRING) AS parent_id")
    return text.model_diff(left, right.unionByName(parts)).drop("model_id")


def customer_models(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A small model for each customer: the customer, orders, and lines; edges from orders to suppliers."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    o, c, line = read("orders"), read("customer"), read("lineitem")
    # Both tables of lines come from one shuffle of them, by order.
    owners = o.groupBy("o_orderkey").agg(F.collect_list(F.struct(F.col("o_custkey").cast("string").alias("model_id"))).alias("owners"))
    bought = line.groupBy("l_orderkey").agg(F.collect_list(F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_returnflag")).alias("bought"))
    orders = bought.join(owners, bought["l_orderkey"] == owners["o_orderkey"])
    lines = orders.select(F.explode("owners").alias("o"), "l_orderkey", "bought").select("o.model_id", "l_orderkey", F.explode("bought").alias("b")).select("model_id", "l_orderkey", "b.*")
    supplies = orders.select(F.explode(F.array_distinct("owners")).alias("o"), "l_orderkey", "bought").select("o.model_id", "l_orderkey", F.explode(F.array_distinct(F.transform("bought", lambda x: x["l_suppkey"]))).alias("l_suppkey"))
    model = "CAST(o_custkey AS STRING) AS model_id"
    parts = [
        c.selectExpr("CAST(c_custkey AS STRING) AS model_id", "'0' AS ord", "'c' AS id", "'container' AS kind", "c_name AS name", "CAST(NULL AS STRING) AS parent_id"),
        o.selectExpr(model, "concat('1', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS ord", "concat('o:', CAST(o_orderkey AS STRING)) AS id", "'component' AS kind", "concat('Order ', CAST(o_orderkey AS STRING)) AS name", "'c' AS parent_id"),
        supplies.selectExpr("model_id", "concat('2', lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0')) AS ord", "concat('s:', CAST(l_orderkey AS STRING), '.', CAST(l_suppkey AS STRING)) AS id", "'code' AS kind", "concat('Supply ', CAST(l_orderkey AS STRING), ' ', CAST(l_suppkey AS STRING)) AS name", "concat('o:', CAST(l_orderkey AS STRING)) AS parent_id"),
    ]
    rels = lines.selectExpr("model_id", "concat(lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_linenumber AS STRING), 4, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'), lpad(CAST(l_partkey AS STRING), 12, '0')) AS ord", "concat('x:', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS id", "concat('o:', CAST(l_orderkey AS STRING)) AS source_id", "concat('s:', CAST(l_orderkey AS STRING), '.', CAST(l_suppkey AS STRING)) AS target_id", "l_returnflag AS type")
    return reduce(DataFrame.unionByName, parts), rels


_SUPPLY = "SELECT DISTINCT o_custkey, l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _block(inside: str, indent: str) -> str:
    return f"coalesce(' {{' || chr(10) || {inside} || chr(10) || '{indent}}}', '')"


@query(f"""WITH s AS (SELECT l_orderkey, string_agg('    code "Supply ' || l_orderkey::VARCHAR || ' ' || l_suppkey::VARCHAR || '"', chr(10) ORDER BY l_suppkey) AS t FROM ({_SUPPLY}) GROUP BY 1),
o AS (SELECT o_custkey, string_agg('  component "Order ' || o_orderkey::VARCHAR || '"' || {_block('t', '  ')}, chr(10) ORDER BY o_orderkey) AS t FROM orders LEFT JOIN s ON l_orderkey = o_orderkey GROUP BY 1),
l AS (SELECT o_custkey, lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 4, '0') || lpad(l_suppkey::VARCHAR, 12, '0') || lpad(l_partkey::VARCHAR, 12, '0') AS k, '"Order ' || l_orderkey::VARCHAR || '" -> "Supply ' || l_orderkey::VARCHAR || ' ' || l_suppkey::VARCHAR || '" [type="' || l_returnflag || '"]' AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT o_custkey, string_agg(line, chr(10) ORDER BY k, line) AS t FROM l GROUP BY 1)
SELECT c_custkey::VARCHAR AS model_id, 'version "1"' || chr(10) || chr(10) || 'container "' || c_name || '"' || {_block('o.t', '')} || coalesce(chr(10) || chr(10) || r.t, '') AS text FROM customer LEFT JOIN o ON o.o_custkey = c_custkey LEFT JOIN r ON r.o_custkey = c_custkey""")
def render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text document for each customer's model."""
    return text.render_text(*customer_models(spark, sf_dir))


@query()
def tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the rendered models, and of every page of prose, which is garbage as a model."""
    docs = render_text(spark, sf_dir).select(F.concat(F.lit("m"), "model_id").alias("doc_id"), "text")
    prose = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return text.tokenise(docs.unionByName(prose))


_SLINES = "SELECT DISTINCT o_custkey, l_orderkey, l_suppkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


@query(f"""SELECT CAST(c_custkey AS STRING) AS doc_id, 'element' AS type, 'container' AS kind, c_name AS name, CAST(NULL AS STRING) AS target, CAST(NULL AS STRING) AS parent FROM customer
UNION ALL SELECT CAST(o_custkey AS STRING), 'element', 'component', 'Order ' || o_orderkey::VARCHAR, NULL, c_name FROM orders JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT CAST(o_custkey AS STRING), 'element', 'code', 'Supply ' || l_orderkey::VARCHAR || ' ' || l_suppkey::VARCHAR, NULL, 'Order ' || l_orderkey::VARCHAR FROM ({_SLINES})
UNION ALL SELECT CAST(o_custkey AS STRING), 'relationship', l_returnflag, 'Order ' || l_orderkey::VARCHAR, 'Supply ' || l_orderkey::VARCHAR || ' ' || l_suppkey::VARCHAR, NULL FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT CAST(c_custkey AS STRING), 'version', NULL, '1', NULL, NULL FROM customer""")
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read back from the rendered models: the very elements and relationships that were rendered."""
    docs = render_text(spark, sf_dir).withColumnRenamed("model_id", "doc_id")
    found = text.statements(docs)
    kind = F.when(F.col("type") == "relationship", F.element_at("attributes", "type")).otherwise(F.col("kind"))
    return found.select("doc_id", "type", kind.alias("kind"), "name", "target", "parent")


def spoilt_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rendered models, four in five with a fault by the customer's key."""
    docs = render_text(spark, sf_dir).withColumnRenamed("model_id", "doc_id").join(spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("doc_id"), "c_name"), "doc_id")
    number, body = F.col("doc_id").cast("long"), F.col("text")
    k, head = number % 5, F.lit('version "1"\n')
    again = F.when(number % 2 == 0, F.concat(F.lit('\ncontainer "'), "c_name", F.lit('"'))).otherwise(F.lit('\nsystem "A B" { container "X" }\nsystem "A-B" { container "X" [tags="t"] }'))
    fault = (
        F.when(k == 1, F.replace(body, head, F.lit('version "2.0.0"\n'))).when(k == 2, F.concat(body, again)).when(k == 3, F.replace(body, head, F.concat(head, F.lit('"ghost" -> "'), "c_name", F.lit('"\n'))))
        .when(k == 4, F.lit('version "1" # nothing')).otherwise(body)
    )
    return docs.select("doc_id", fault.alias("text"))


@query("""SELECT c_custkey::VARCHAR AS doc_id, CASE k WHEN 1 THEN 'UNSUPPORTED_VERSION' WHEN 2 THEN 'DUPLICATE_NAME' WHEN 3 THEN 'UNRESOLVED_REFERENCE' ELSE 'EMPTY_DOCUMENT' END AS error_code, CASE k WHEN 2 THEN again WHEN 3 THEN 'ghost' END AS element_name, CASE k WHEN 1 THEN 1 WHEN 3 THEN 2 END::INT AS line,
  CASE k WHEN 1 THEN 'DSL version ''2.0.0'' is not supported. Only version ''1'' is accepted.' WHEN 2 THEN 'Duplicate element name ''' || again || ''' in scope ''' || scope || '''' WHEN 3 THEN 'Element ''ghost'' is not declared in this document' ELSE 'Document contains no elements. At least one element must be declared.' END AS message
FROM (SELECT c_custkey, c_custkey % 5 AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE 'X' END AS again, CASE WHEN c_custkey % 2 = 0 THEN 'root' ELSE 'a-b' END AS scope FROM customer) WHERE k <> 0""")
def document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.document_checks(spoilt_texts(spark, sf_dir)).select("doc_id", "error_code", "message", "line", "element_name")


@query(f"""WITH c AS (SELECT c_custkey, {SLUG.format('c_name')} AS slug, c_name FROM customer), o AS (SELECT o.o_orderkey, c.c_custkey, c.slug || '.order-' || o_orderkey::VARCHAR AS slug, c.slug AS up FROM orders o JOIN c ON o.o_custkey = c.c_custkey)
SELECT c_custkey::VARCHAR AS model_id, slug AS id, 'container' AS kind, c_name AS name, NULL AS parent_id FROM c UNION ALL SELECT c_custkey::VARCHAR, slug, 'component', 'Order ' || o_orderkey::VARCHAR, up FROM o
UNION ALL SELECT o.c_custkey::VARCHAR, o.slug || '.supply-' || l_orderkey::VARCHAR || '-' || l_suppkey::VARCHAR, 'code', 'Supply ' || l_orderkey::VARCHAR || ' ' || l_suppkey::VARCHAR, o.slug FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) JOIN o ON l_orderkey = o_orderkey""")
def assemble_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render_text(spark, sf_dir).withColumnRenamed("model_id", "doc_id")
    return text.assemble(text.statements(docs))[0].select("model_id", "id", "kind", "name", "parent_id")


@query(f"""WITH c AS (SELECT c_custkey, {SLUG.format('c_name')} AS slug FROM customer), o AS (SELECT o_orderkey, o_custkey, c.slug || '.order-' || o_orderkey::VARCHAR AS slug FROM orders JOIN c ON o_custkey = c_custkey)
SELECT o_custkey::VARCHAR AS model_id, 'rel-order-' || o_orderkey::VARCHAR || '-supply-' || o_orderkey::VARCHAR || '-' || l_suppkey::VARCHAR AS id, o.slug AS source_id, o.slug || '.supply-' || o_orderkey::VARCHAR || '-' || l_suppkey::VARCHAR AS target_id, l_returnflag AS type FROM lineitem JOIN o ON l_orderkey = o_orderkey""")
def assemble_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = render_text(spark, sf_dir).withColumnRenamed("model_id", "doc_id")
    return text.assemble(text.statements(docs))[1].select("model_id", "id", "source_id", "target_id", "type")


@query(PRE + ", last AS (SELECT 'n:' || (user_id % 25)::VARCHAR AS id, arg_max(event_type, event_id) AS t, max(event_id) AS e FROM events GROUP BY 1) SELECT x.id, CASE WHEN l.id IS NULL THEN '#ffffff' WHEN l.t = 'error' THEN NULL ELSE '#' || lpad((e % 1000000)::VARCHAR, 6, '0') END AS background FROM elements x LEFT JOIN last l ON l.id = x.id")
def set_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event paints a nation, errors take the paint away; all else stays white."""
    paint = lambda c: F.struct(c.alias("background_color"))
    elements = estate(spark, sf_dir)[0].withColumn("formatting", paint(F.lit("#ffffff")))
    colour = F.concat(F.lit("#"), F.lpad((F.col("event_id") % 1_000_000).cast("string"), 6, "0"))
    jobs = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit("estate").alias("model_id"), F.concat(F.lit("n:"), (F.col("user_id") % 25).cast("string")).alias("id"), F.when(F.col("event_type") != "error", paint(colour)).alias("formatting"), F.col("event_id").alias("ord"))
    return edits.set_formatting(elements, jobs).select("id", F.col("formatting.background_color").alias("background"))


@query(PRE + " SELECT id, CASE WHEN id IN (SELECT 'n:' || s_nationkey::VARCHAR FROM supplier) THEN false ELSE is_external END AS is_external FROM elements")
def unmark_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations that have suppliers aren't external."""
    own = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.lit("estate").alias("model_id"), F.concat(F.lit("n:"), F.col("s_nationkey").cast("string")).alias("id"))
    return edits.unmark_external(estate(spark, sf_dir)[0], own).select("id", "is_external")


@query(PRE + """, last AS (SELECT 'e:' || (event_id % 1000)::VARCHAR AS id, arg_max(event_type, event_id) AS op, max(event_id) AS e FROM events GROUP BY 1),
out_rels AS (SELECT r.id, CASE WHEN l.op IN ('click', 'purchase', 'signup') THEN 'changed' ELSE r.action END AS action, CASE WHEN l.op IN ('click', 'purchase', 'signup') THEN 'by ' || l.e::VARCHAR ELSE r.type END AS type FROM relationships r LEFT JOIN last l ON l.id = r.id WHERE coalesce(l.op, '') <> 'error'
UNION ALL SELECT id, 'changed', 'by ' || e::VARCHAR FROM last WHERE op IN ('click', 'purchase', 'signup') AND id NOT IN (SELECT id FROM relationships)) SELECT * FROM out_rels""")
def apply_changes_to_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as change proposals on a thousand relationships: the last of each counts."""
    elements, rels, nodes, drawn = state(spark, sf_dir)
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    op = F.when(F.col("event_type").isin("click", "purchase", "signup"), "update").when(F.col("event_type") == "error", "delete").otherwise("none")
    null = lambda t: F.lit(None).cast(t)
    element = F.struct(null("string").alias("kind"), null("string").alias("name"), null("string").alias("parent_id"), null("string").alias("container_subtype"), null("boolean").alias("is_external"))
    relationship = F.struct(F.lit("u:1").alias("source_id"), F.lit("c:1").alias("target_id"), F.concat(F.lit("by "), F.col("event_id").cast("string")).alias("type"), F.lit("changed").alias("action"), null("string").alias("integration_mode"))
    changes = events.select(F.lit("estate").alias("model_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ord"), op.alias("op"), F.lit("relationship").alias("target_type"), F.concat(F.lit("e:"), (F.col("event_id") % 1000).cast("string")).alias("target_id"), element.alias("element"), relationship.alias("relationship"))
    return edits.apply_changes(elements, rels, nodes, drawn, changes)[1].select("id", "action", "type")
