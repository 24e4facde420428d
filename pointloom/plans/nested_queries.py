"""Queries over the nested steps of trajectories (problem 2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointloom.operators.deliveries import current_rows
from pointloom.operators.nested import nested_nodes, nested_table
from pointloom.sources.tables import table


def _current(spark: SparkSession, folder: str) -> DataFrame:
    return current_rows(table(spark, folder, "trajectories"), "traj_id", ["steps"])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every object below a current trajectory."""
    return nested_nodes(_current(spark, folder), "traj_id", "steps").select("traj_id", "node_path")


def _of_kind(kind: str, fields: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        nodes = nested_nodes(_current(spark, folder), "traj_id", "steps", attributes=True)
        return nested_table(nodes, kind, fields).drop("depth")

    return query


def p2_steps(spark: SparkSession, folder: str) -> DataFrame:
    """Steps with their scalar fields, the type of the action and the scalars of the state."""
    nodes = nested_nodes(_current(spark, folder), "traj_id", "steps", attributes=True)
    fields = "step_idx int, cost double, delta_cost double, accepted boolean, action struct<type: string>, state struct<k: int, weights: array<double>>"
    return nested_table(nodes, "step", fields).select(
        "traj_id", "node_path", "position", "step_idx", "cost", "delta_cost", "accepted", F.col("action.type").alias("action_type"), F.col("state.k").alias("state_k"), F.col("state.weights").alias("state_weights")
    )


def _read(v: str) -> str:
    """SQL for a JSON value that may be JSON held as text."""
    return f"CASE WHEN json_type({v}) = 'VARCHAR' THEN TRY_CAST({v} ->> '$' AS JSON) ELSE {v} END"


_V, _H = _read("v"), _read("h")
#: SQL for the (position, value) pairs of a list in any of its shapes.
_PLACES = """CASE json_type(v)
  WHEN 'ARRAY' THEN list_transform(from_json(v, '["JSON"]'), lambda x, i: {'p': i - 1, 'v': x})
  WHEN 'OBJECT' THEN CASE WHEN len(list_filter(json_keys(v), lambda k: NOT regexp_full_match(k, '[0-9]+'))) = 0
    THEN list_transform(json_keys(v), lambda k: {'p': k::BIGINT, 'v': json_extract(v, '$."' || k || '"')}) ELSE [{'p': 0::BIGINT, 'v': v}] END END"""
#: Every object below a current trajectory: `traj_id`, `path`, `parent`, `pos`, `kind`, `v`.
_NODES_SQL = f"""WITH RECURSIVE latest AS (SELECT traj_id, steps FROM (SELECT *, row_number() OVER (PARTITION BY traj_id ORDER BY ingested_at DESC) AS turn FROM trajectories) WHERE turn = 1),
t0 AS (SELECT traj_id, TRY_CAST(steps AS JSON) AS v FROM latest WHERE steps IS NOT NULL AND NOT regexp_matches(steps, 'NaN|Infinity')),
t1 AS (SELECT traj_id, {_V} AS v FROM t0), t2 AS (SELECT traj_id, {_V} AS v FROM t1),
root AS (SELECT traj_id, CASE WHEN json_type(v) = 'OBJECT' AND list_contains(json_keys(v), 'steps') THEN v -> '$.steps' ELSE v END AS v FROM t2),
rel(kind, child, name, outer_key) AS (VALUES ('step', 'move', 'moves', 'action'), ('step', 'cluster', 'clusters', 'state'), ('move', 'point', 'points', NULL), ('cluster', 'member', 'members', NULL), ('cluster', 'cluster', 'children', NULL)),
n(traj_id, path, parent, pos, kind, v) AS (
  SELECT traj_id, p.p::VARCHAR, NULL::VARCHAR, p.p, 'step', p.v FROM (SELECT traj_id, unnest({_PLACES}) AS p FROM (SELECT traj_id, {_V} AS v FROM root))
  UNION ALL
  SELECT traj_id, path || '/' || name || '/' || p.p, path, p.p, child, p.v FROM (
    SELECT traj_id, path, name, child, unnest({_PLACES}) AS p FROM (SELECT traj_id, path, name, child, {_V} AS v FROM (SELECT traj_id, path, name, child, {_V} AS v FROM (
      SELECT traj_id, path, name, child, json_extract(CASE WHEN outer_key IS NULL THEN v ELSE {_H} END, '$.' || name) AS v FROM (
        SELECT n.traj_id, n.path, r.name, r.child, r.outer_key, v, CASE WHEN outer_key IS NOT NULL THEN json_extract(v, '$.' || outer_key) END AS h
        FROM (SELECT traj_id, path, kind, {_V} AS v FROM (SELECT traj_id, path, kind, {_V} AS v FROM n)) n JOIN rel r ON r.kind = n.kind WHERE json_type(v) = 'OBJECT'
      )))))
), nodes AS (SELECT * FROM (SELECT traj_id, path, parent, pos, kind, {_V} AS v FROM (SELECT traj_id, path, parent, pos, kind, {_V} AS v FROM n)) WHERE json_type(v) = 'OBJECT')"""


def _kind_sql(kind: str, fields: str) -> str:
    return f"{_NODES_SQL} SELECT traj_id, path AS node_path, parent AS parent_path, pos::INT AS position, {fields} FROM nodes WHERE kind = '{kind}'"


def _number(name: str, kind: str) -> str:
    return f'CASE WHEN json_type(v, \'$.{name}\') IN (\'BIGINT\', \'UBIGINT\', \'DOUBLE\') THEN TRY_CAST(v ->> \'$.{name}\' AS {kind}) END AS "{name}"'


_NUMBERS = "('BIGINT', 'UBIGINT', 'DOUBLE')"
_STEPS_SQL = f"""{_NODES_SQL}, steps AS (SELECT traj_id, path, pos, v, {_read("a")} AS a, {_read("s")} AS s FROM (SELECT *, {_read("json_extract(v, '$.action')")} AS a, {_read("json_extract(v, '$.state')")} AS s FROM nodes WHERE kind = 'step'))
SELECT traj_id, path AS node_path, pos::INT AS position, {_number("step_idx", "INT")}, {_number("cost", "DOUBLE")}, {_number("delta_cost", "DOUBLE")},
  CASE WHEN json_type(v, '$.accepted') = 'BOOLEAN' THEN (v ->> '$.accepted')::BOOLEAN END AS accepted, CASE WHEN json_type(a, '$.type') = 'VARCHAR' THEN a ->> '$.type' END AS action_type,
  CASE WHEN json_type(s, '$.k') IN {_NUMBERS} THEN TRY_CAST(s ->> '$.k' AS INT) END AS state_k, CASE WHEN json_type(s, '$.weights') = 'ARRAY' THEN from_json(s -> '$.weights', '["DOUBLE"]') END AS state_weights FROM steps"""

SQL = {
    "p2_steps": _STEPS_SQL,
    "p2_found": f"{_NODES_SQL} SELECT traj_id, path AS node_path FROM nodes",
    "p2_moves": _kind_sql("move", f"{_number('from', 'INT')}, {_number('to', 'INT')}"),
    "p2_points": _kind_sql("point", f"{_number('id', 'INT')}, {_number('gain', 'DOUBLE')}"),
    "p2_clusters": _kind_sql("cluster", f"{_number('cluster', 'INT')}, {_number('size', 'INT')}"),
    "p2_members": _kind_sql("member", f"{_number('id', 'INT')}, {_number('dist', 'DOUBLE')}, CASE WHEN json_type(v, '$.tags') = 'ARRAY' THEN from_json(v -> '$.tags', '[\"VARCHAR\"]') END AS tags"),
}
QUERIES = {
    "p2_found": p2_found,
    "p2_steps": p2_steps,
    "p2_moves": _of_kind("move", "`from` int, `to` int"),
    "p2_points": _of_kind("point", "id int, gain double"),
    "p2_clusters": _of_kind("cluster", "cluster int, size int"),
    "p2_members": _of_kind("member", "id int, dist double, tags array<string>"),
}
