"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citelens.operators.nested import flat_table, object_nodes
from citelens.plans.registry import query

_TREE = """
WITH bodies AS (SELECT serp_id, CASE WHEN json_valid(body) THEN body::JSON END AS body FROM serp_sample),
tree AS (
  SELECT b.serp_id, substr(t.fullkey, 3) AS node, t.value AS value
  FROM bodies b, json_tree(b.body) t WHERE b.body IS NOT NULL AND t.type = 'OBJECT' AND t.fullkey LIKE '%]'
),
nodes AS (SELECT serp_id, node, regexp_extract(node, '^(.*\\])\\.', 1) AS parent, value FROM tree)
"""

ITEM_COLUMNS = {
    "type": "string",
    "rank_group": "int",
    "rank_absolute": "int",
    "markdown": "string",
    "domain": "string",
    "title": "string",
    "url": "string",
    "text": "string",
}
REFERENCE_COLUMNS = {x: "string" for x in ("type", "source", "domain", "url", "title", "text")}


def _nodes(spark: SparkSession, folder: str, payload: bool = False) -> DataFrame:
    return object_nodes(spark.read.parquet(f"{folder}/serp_sample.parquet"), "serp_id", "body", payload)


@query("p2_found", _TREE + "SELECT serp_id, node, parent FROM nodes")
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _nodes(spark, folder)


def _typed_sql(field: str, columns: dict[str, str]) -> str:
    def one(name: str, kind: str) -> str:
        text = f"value->>'$.{name}'"
        return f"TRY_CAST({text} AS INTEGER) AS {name}" if kind == "int" else f"{text} AS {name}"

    return (
        _TREE
        + "SELECT serp_id, node, parent, CAST(regexp_extract(node, '\\[(\\d+)\\]$', 1) AS INTEGER) AS position, "
        + ", ".join(one(*x) for x in columns.items())
        + f" FROM nodes WHERE regexp_extract(node, '([^.\\[\\]]+)(?:\\[\\d+\\])+$', 1) = '{field}'"
    )


@query("p2_items", _typed_sql("items", ITEM_COLUMNS))
def p2_items(spark: SparkSession, folder: str) -> DataFrame:
    return flat_table(_nodes(spark, folder, True), "serp_id", "items", ITEM_COLUMNS)


@query("p2_references", _typed_sql("references", REFERENCE_COLUMNS))
def p2_references(spark: SparkSession, folder: str) -> DataFrame:
    return flat_table(_nodes(spark, folder, True), "serp_id", "references", REFERENCE_COLUMNS)
