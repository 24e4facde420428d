"""Nested records against a recursive walk."""

from __future__ import annotations

import json
import random

from pointloom.operators.nested import nested_nodes, nested_table
from pointloom.plans.nested_queries import QUERIES, p2_found


def _read(v):
    while isinstance(v, str):
        try:
            v = json.loads(v, parse_constant=lambda c: 1 / 0)
        except (ValueError, ZeroDivisionError):
            return None
    return v


def _items(v):
    v = _read(v)
    if isinstance(v, dict):
        v = {int(k): x for k, x in v.items()} if all(k.isdigit() for k in v) else {0: v}
    elif isinstance(v, list):
        v = dict(enumerate(v))
    else:
        return []
    return [(k, y) for k, x in v.items() if isinstance(y := _read(x) if isinstance(x, str) else x, dict)]


def _walk(text):
    root = _read(text)
    if isinstance(root, dict) and "steps" in root:
        root = root["steps"]
    out = []

    def cluster(c, path):
        out.append(path)
        out.extend(f"{path}/members/{k}" for k, _ in _items(c.get("members")))
        for k, child in _items(c.get("children")):
            cluster(child, f"{path}/children/{k}")

    for i, step in _items(root):
        out.append(str(i))
        action, state = _read(step.get("action")), _read(step.get("state"))
        for k, move in _items(action.get("moves")) if isinstance(action, dict) else []:
            out.append(f"{i}/moves/{k}")
            out.extend(f"{i}/moves/{k}/points/{p}" for p, _ in _items(move.get("points")))
        for k, c in _items(state.get("clusters")) if isinstance(state, dict) else []:
            cluster(c, f"{i}/clusters/{k}")
    return out


def _shape(rng, items):
    kind = rng.randrange(5)
    if kind == 0 and len(items) == 1 and items[0] is not None:
        return items[0]
    if kind == 1 and items:
        return {str(i): x for i, x in enumerate(items)}
    if kind == 2:
        return json.dumps(items)
    return items


def _tree(rng, depth):
    c = {"cluster": rng.randrange(9), "size": None if rng.random() < 0.2 else rng.randrange(99)}
    if rng.random() < 0.8:
        c["members"] = _shape(rng, [None if rng.random() < 0.1 else {"id": rng.randrange(99), "dist": rng.random()} for _ in range(rng.randrange(4))])
    if depth and rng.random() < 0.7:
        c["children"] = _shape(rng, [None if rng.random() < 0.1 else _tree(rng, depth - 1) for _ in range(rng.randrange(3))])
    return c


def _text(rng):
    steps = []
    for i in range(rng.randrange(4)):
        action = {"type": "swap", "moves": _shape(rng, [{"from": 1, "points": _shape(rng, [{"id": 5}, None])} for _ in range(rng.randrange(3))])}
        state = {"k": 3, "clusters": _shape(rng, [_tree(rng, 3) for _ in range(rng.randrange(3))])}
        steps.append(None if rng.random() < 0.1 else {"step_idx": i, "action": json.dumps(action) if rng.random() < 0.3 else action, "state": state})
    whole = {"steps": steps, "n_steps": len(steps)} if rng.random() < 0.3 else steps
    text = json.dumps(whole)
    return text[: len(text) // 2] if rng.random() < 0.1 else json.dumps(text) if rng.random() < 0.1 else text


CASES = [
    None, "", " ", "null", "[]", "{}", "[null]", "[1, \"x\", [2]]", "{\"step_idx\": 1}", "[{\"a\": NaN}]", "{\"steps\": \"[{\\\"x\\\": 1}]\"}", "{\"0\": {\"a\": 1}, \"2\": {\"a\": 2}}", "not json", "[{\"state\": \"broken {\"}]",
    "[{\"state\": {\"clusters\": {}}}]", "[{\"action\": null, \"state\": 5}]",
]


def test_against_a_recursive_walk(spark):
    rng = random.Random(3)
    texts = CASES + [_text(rng) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "traj_id long, steps string")
    got: dict[int, list[str]] = {}
    for r in nested_nodes(df, "traj_id", "steps").collect():
        got.setdefault(r["traj_id"], []).append(r["node_path"])
        assert r["parent_path"] == (r["node_path"].rsplit("/", 2)[0] if "/" in r["node_path"] else None)
    for i, t in enumerate(texts):
        assert sorted(got.get(i, [])) == sorted(_walk(t)), t


def test_a_very_deep_tree_and_a_very_long_list(spark):
    deep = {"cluster": 0}
    for i in range(60):
        deep = {"cluster": i, "children": [deep]}
    texts = [json.dumps([{"state": {"clusters": [deep]}}]), json.dumps([{"step_idx": i} for i in range(20_000)])]
    df = spark.createDataFrame(list(enumerate(texts)), "traj_id long, steps string")
    got = {r["traj_id"]: r["count"] for r in nested_nodes(df, "traj_id", "steps").groupBy("traj_id").count().collect()}
    assert got == {0: 62, 1: 20_000}


def test_typed_fields_and_repeated_keys(spark):
    text = json.dumps([{"state": {"clusters": [{"members": [{"id": 4, "dist": 1.5, "tags": ["a"]}, {"id": "odd"}]}]}}])
    df = spark.createDataFrame([(1, text), (1, text)], "traj_id long, steps string")
    rows = nested_table(nested_nodes(df, "traj_id", "steps", attributes=True), "member", "id int, dist double, tags array<string>").collect()
    assert len(rows) == 4
    assert sorted((r["position"], r["id"], r["dist"]) for r in rows if r["position"] == 0) == [(0, 4, 1.5)] * 2


def test_queries_take_the_latest_delivery(spark, tmp_path):
    rows = [(1, "[{\"a\": 1}]", 1), (1, "[{\"a\": 1}, {\"b\": 2}]", 2), (None, "[{}]", 1), (2, None, 1)]
    spark.createDataFrame(rows, "traj_id long, steps string, ingested_at long").write.parquet(f"{tmp_path}/trajectories.parquet")
    assert sorted(tuple(r) for r in p2_found(spark, str(tmp_path)).collect()) == [(1, "0"), (1, "1")]
    assert QUERIES["p2_members"](spark, str(tmp_path)).count() == 0


ODD = [
    '[],"x":1', "[],[]", '[{"x":NaN}]', '[{"x":Infinity}]', '[{"action":{"moves":[]},"x":Inf}]', "null", "", " ", "[null,{}]", '[{"state":{"clusters":[{"members":[{},null,5]}]}}]', '[{"state":null,"action":{"moves":null}}]',
    '{"steps":[{"action":{"moves":[{"points":[{},{}]}]}}]}', '{"steps":null}', '{"steps":5}', '{"other":[{}]}', '{"steps":[{}],"steps":[{},{}]}', '[{"state":{"clusters":[{"children":[{"children":[{"members":[{}]}]}]}]}}]',
    '[{"state":{"clusters":' + '[{"children":' * 12 + "[{}]" + "}]" * 12 + "}}]", '{"steps":[{}]}x', '[{"action":"{\\"moves\\":[{}]}"}]', '[{"x":"a\tb"}]', '[{"x":"\\ud800"}]', '[{"x":1e999}]', '[{"act\\u0069on":{"moves":[{}]}}]',
    '[{"x":"}"},{"x":"{"}]', "[" * 3000 + "]" * 3000, '{"0":{},"2":{}}', "{}", "[{}]\n", '\n[{}]', '{"steps":{"1":{"action":{"moves":{"from":1}}}}}',
]


def test_regular_and_odd_records_alike(monkeypatch):
    """Whatever Arrow's reader takes in bulk gives the rows that decoding record by record gives."""
    import numpy as np
    import pyarrow as pa

    from pointloom.operators import nested as N

    keys, texts = pa.array(range(len(ODD))), pa.array([t.encode() for t in ODD])

    def rows():
        found = [c for c in N._flatten(keys, texts, N.TRAJECTORY, None)]
        return sorted(map(str, zip(*[sum((c[j].to_pylist() for c in found), []) for j in range(6)], strict=True)))

    whole = rows()
    regular, rest = N._split(texts, N.TRAJECTORY)
    assert sum(len(at) for at, _ in regular) >= 6 and len(rest) > 10
    monkeypatch.setattr(N, "_split", lambda texts, shape: ([], np.arange(len(texts))))
    assert rows() == whole
