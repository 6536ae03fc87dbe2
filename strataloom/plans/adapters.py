"""The supplied star-schema tables read as architecture models.

Every table is a union of projections. A projection is written once, as expressions that Spark and ANSI SQL engines
agree on, so that the reading side and the comparison side can't drift apart.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession

Projection = tuple[str, list[str]]

#: `estate`: one large model.
ELEMENTS: list[Projection] = [
    ("region", ["'estate' AS model_id", "concat('0', lpad(CAST(r_regionkey AS STRING), 12, '0')) AS ord", "concat('r:', CAST(r_regionkey AS STRING)) AS id", "'landscape' AS kind", "r_name AS name", "CAST(NULL AS STRING) AS parent_id", "CAST(NULL AS STRING) AS container_subtype", "CAST(NULL AS BOOLEAN) AS is_external"]),
    ("nation", ["'estate' AS model_id", "concat('1', lpad(CAST(n_nationkey AS STRING), 12, '0')) AS ord", "concat('n:', CAST(n_nationkey AS STRING)) AS id", "'system' AS kind", "n_name AS name", "concat('r:', CAST(n_regionkey AS STRING)) AS parent_id", "CAST(NULL AS STRING) AS container_subtype", "(n_nationkey % 5 = 0) AS is_external"]),
    ("customer", ["'estate' AS model_id", "concat('2', lpad(CAST(c_custkey AS STRING), 12, '0')) AS ord", "concat('c:', CAST(c_custkey AS STRING)) AS id", "'container' AS kind", "c_name AS name", "concat('n:', CAST(c_nationkey AS STRING)) AS parent_id", "CAST(NULL AS STRING) AS container_subtype", "CAST(NULL AS BOOLEAN) AS is_external"]),
    ("supplier", ["'estate' AS model_id", "concat('3', lpad(CAST(s_suppkey AS STRING), 12, '0')) AS ord", "concat('s:', CAST(s_suppkey AS STRING)) AS id", "'container' AS kind", "s_name AS name", "concat('n:', CAST(s_nationkey AS STRING)) AS parent_id", "'backend-service' AS container_subtype", "CAST(NULL AS BOOLEAN) AS is_external"]),
    ("orders", ["'estate' AS model_id", "concat('4', lpad(CAST(o_orderkey AS STRING), 12, '0')) AS ord", "concat('o:', CAST(o_orderkey AS STRING)) AS id", "'component' AS kind", "concat('Order ', CAST(o_orderkey AS STRING)) AS name", "concat('c:', CAST(o_custkey AS STRING)) AS parent_id", "CAST(NULL AS STRING) AS container_subtype", "CAST(NULL AS BOOLEAN) AS is_external"]),
    ("lineitem", ["'estate' AS model_id", "concat('5', lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_linenumber AS STRING), 4, '0'), lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0')) AS ord", "concat('l:', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS id", "'code' AS kind", "concat('Line ', CAST(l_linenumber AS STRING), ' of part ', CAST(l_partkey AS STRING)) AS name", "concat('o:', CAST(l_orderkey AS STRING)) AS parent_id", "CAST(NULL AS STRING) AS container_subtype", "CAST(NULL AS BOOLEAN) AS is_external"]),
    ("(SELECT DISTINCT user_id FROM events)", ["'estate' AS model_id", "concat('6', lpad(CAST(user_id AS STRING), 12, '0')) AS ord", "concat('u:', CAST(user_id AS STRING)) AS id", "'person' AS kind", "concat('User ', CAST(user_id AS STRING)) AS name", "concat('r:', CAST(user_id % 5 AS STRING)) AS parent_id", "CAST(NULL AS STRING) AS container_subtype", "CAST(NULL AS BOOLEAN) AS is_external"]),
]
RELATIONSHIPS: list[Projection] = [
    ("lineitem", ["'estate' AS model_id", "concat('0', lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_linenumber AS STRING), 4, '0'), lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'), l_returnflag, l_linestatus) AS ord", "concat('x:', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) AS id", "concat('o:', CAST(l_orderkey AS STRING)) AS source_id", "concat('s:', CAST(l_suppkey AS STRING)) AS target_id", "l_returnflag AS type", "l_linestatus AS action", "CASE WHEN l_linenumber % 2 = 0 THEN 'async' END AS integration_mode"]),
    ("events", ["'estate' AS model_id", "concat('1', lpad(CAST(event_id AS STRING), 12, '0')) AS ord", "concat('e:', CAST(event_id AS STRING)) AS id", "concat('u:', CAST(user_id AS STRING)) AS source_id", "concat('c:', CAST(user_id AS STRING)) AS target_id", "event_type AS type", "CAST(NULL AS STRING) AS action", "CAST(NULL AS STRING) AS integration_mode"]),
]
#: Stored positions: nations on a grid three wide, users beside them.
LAYOUT_NODES: list[Projection] = [
    ("nation", ["'estate' AS model_id", "'main' AS view_id", "concat('1', lpad(CAST(n_nationkey AS STRING), 12, '0')) AS ord", "concat('n:', CAST(n_nationkey AS STRING)) AS element_id", "CAST(50 + (n_nationkey % 3) * 150 AS DOUBLE) AS x", "CAST(50 + CAST(floor(n_nationkey / 3) AS INT) * 150 AS DOUBLE) AS y", "CASE WHEN n_nationkey % 2 = 0 THEN CAST(200 AS DOUBLE) END AS w", "CASE WHEN n_nationkey % 2 = 0 THEN CAST(130 AS DOUBLE) END AS h"]),
    ("(SELECT DISTINCT user_id FROM events)", ["'estate' AS model_id", "'main' AS view_id", "concat('6', lpad(CAST(user_id AS STRING), 12, '0')) AS ord", "concat('u:', CAST(user_id AS STRING)) AS element_id", "CAST(700 + (user_id % 7) * 150 AS DOUBLE) AS x", "CAST(50 + (user_id % 11) * 150 AS DOUBLE) AS y", "CAST(NULL AS DOUBLE) AS w", "CAST(NULL AS DOUBLE) AS h"]),
]

#: `corpus`: a model for each nation, with faults made by arithmetic. Foreign suppliers are missing, so edges dangle.
_OF_ORDER = "(SELECT o.*, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey)"
_OF_LINE = "(SELECT l.*, c.c_nationkey FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey)"


def _faulty(model: str, ord_: str, id_: str, kind: str, name: str, parent: str = "CAST(NULL AS STRING)", code_ref: str = "false", external: str = "CAST(NULL AS BOOLEAN)", subtype: str = "CAST(NULL AS STRING)", colour: str = "CAST(NULL AS STRING)") -> list[str]:
    return [f"concat('m', CAST({model} AS STRING)) AS model_id", f"{ord_} AS ord", f"{id_} AS id", f"'{kind}' AS kind", f"{name} AS name", f"{parent} AS parent_id", f"{code_ref} AS has_code_ref", f"{external} AS is_external", f"{subtype} AS container_subtype", f"{colour} AS background_color"]


FAULTY_ELEMENTS: list[Projection] = [
    ("nation", _faulty("n_nationkey", "'0'", "concat('r:', CAST(n_regionkey AS STRING))", "landscape", "'Landscape'", parent="CASE WHEN n_nationkey % 6 = 1 THEN 'r:99' END")),
    ("nation", _faulty("n_nationkey", "'1'", "concat('n:', CAST(n_nationkey AS STRING))", "system", "n_name", parent="concat('r:', CAST(n_regionkey AS STRING))", external="CASE WHEN n_nationkey % 5 = 0 THEN true END", colour="CASE WHEN n_nationkey % 10 = 0 THEN '#00ff00' END")),
    ("customer", _faulty("c_nationkey", "concat('2', lpad(CAST(c_custkey AS STRING), 12, '0'))", "concat('c:', CAST(c_custkey AS STRING))", "container", "c_name", parent="CASE WHEN c_custkey % 7 <> 0 THEN concat('n:', CAST(c_nationkey AS STRING)) END", external="CASE WHEN c_custkey % 17 = 0 THEN false END", colour="CASE WHEN c_custkey % 11 = 0 THEN 'red' WHEN c_custkey % 11 = 1 THEN '#12ab9F' END")),
    ("supplier", _faulty("s_nationkey", "concat('3', lpad(CAST(s_suppkey AS STRING), 12, '0'))", "concat('s:', CAST(s_suppkey AS STRING))", "container", "s_name", parent="concat('n:', CAST(s_nationkey AS STRING))", subtype="'backend-service'")),
    (_OF_ORDER, _faulty("c_nationkey", "concat('4', lpad(CAST(o_orderkey AS STRING), 12, '0'))", "concat('o:', CAST(o_orderkey AS STRING))", "component", "concat('Order ', CAST(o_orderkey AS STRING))", parent="CASE WHEN o_orderkey % 19 = 0 THEN concat('n:', CAST(c_nationkey AS STRING)) WHEN o_orderkey % 23 = 0 THEN 'c:0' ELSE concat('c:', CAST(o_custkey AS STRING)) END", code_ref="(o_orderkey % 13 = 0)", subtype="CASE WHEN o_orderkey % 29 = 0 THEN 'database' END")),
    (_OF_LINE, _faulty("c_nationkey", "concat('5', lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_linenumber AS STRING), 4, '0'), lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0'))", "concat('l:', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING))", "code", "concat('Line ', CAST(l_linenumber AS STRING))", parent="concat('o:', CAST(l_orderkey AS STRING))", code_ref="(l_linenumber <> 1)")),
]
FAULTY_RELATIONSHIPS: list[Projection] = [
    (_OF_LINE, ["concat('m', CAST(c_nationkey AS STRING)) AS model_id", "concat(lpad(CAST(l_orderkey AS STRING), 12, '0'), lpad(CAST(l_linenumber AS STRING), 4, '0'), lpad(CAST(l_partkey AS STRING), 12, '0'), lpad(CAST(l_suppkey AS STRING), 12, '0')) AS ord", "CASE WHEN l_orderkey % 31 = 0 THEN concat('o:', CAST(l_orderkey AS STRING)) ELSE concat('x:', CAST(l_orderkey AS STRING), '.', CAST(l_linenumber AS STRING)) END AS id", "concat('o:', CAST(l_orderkey AS STRING)) AS source_id", "concat('s:', CAST(l_suppkey AS STRING)) AS target_id", "l_returnflag AS type"]),
]
FAULTY_VIEWS: list[Projection] = [
    ("nation", ["concat('m', CAST(n_nationkey AS STRING)) AS model_id", "'0' AS ord", "'main' AS id", "'system' AS level", "n_name AS title", "(n_nationkey % 4 <> 0) AS has_layout"]),
]
FAULTY_NODES: list[Projection] = [
    ("supplier", ["concat('m', CAST((s_nationkey + CAST(s_suppkey % 2 AS INT)) % 25 AS STRING)) AS model_id", "'main' AS view_id", "'0' AS view_ord", "lpad(CAST(s_suppkey AS STRING), 12, '0') AS ord", "concat('s:', CAST(s_suppkey AS STRING)) AS element_id"]),
]
FAULTY_EDGES: list[Projection] = [
    ("supplier", ["concat('m', CAST(s_nationkey AS STRING)) AS model_id", "'main' AS view_id", "'0' AS view_ord", "lpad(CAST(s_suppkey AS STRING), 12, '0') AS ord", "concat('x:', CAST(s_suppkey AS STRING), '.1') AS relationship_id"]),
]
BASE = ("region", "nation", "customer", "supplier", "orders", "lineitem", "events")


def load(spark: SparkSession, sf_dir: str, projections: list[Projection]) -> DataFrame:
    """The union of projections, read from Parquet files."""

    def one(source: str, columns: list[str]) -> DataFrame:
        if not source.startswith("("):
            return spark.read.parquet(f"{sf_dir}/{source}.parquet").selectExpr(*columns)
        tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f" {t} " in source.replace(")", " ")}
        text = source[1:-1]
        for t in tables:
            text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
        return spark.sql(text, **tables).selectExpr(*columns)

    return reduce(DataFrame.unionByName, [one(*p) for p in projections])


def select_sql(projections: list[Projection]) -> str:
    """The same union for an SQL engine in which the tables are views."""
    return " UNION ALL ".join(f"SELECT {', '.join(columns)} FROM {source}{' AS src' if source.startswith('(') else ''}" for source, columns in projections)
