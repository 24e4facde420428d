"""Nested records as related flat tables.

A record is JSON text holding objects within lists within objects. `nested_nodes`
turns it into one row per object with the path of the object and of its parent, and
`nested_table` types one kind of object. Flattening is by level and columnar: every
relation of a level is an Arrow list array (offsets and children); its parent-index
kernel says to which parent each child belongs, and keys and paths reach the children
by vectorised take. Recursive relations (an object whose children are of its own kind)
run as further levels until none is left.

Records of the regular shape become such arrays without a row being parsed in Python:
Arrow's reader turns a batch of texts into nested arrays, whose buffers are flattened
as they are. What it can't read so (lists as lone objects, as objects of positions or
as text, damaged text, deeper recursion than `DEPTH`) is decoded record by record.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.json as pj
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Relation:
    """Children of kind `child` under the keys `at` of their parent; `name` stands in the path."""

    at: tuple[str, ...]
    name: str
    child: str


@dataclass(frozen=True)
class Shape:
    """Which objects a record holds: kind of the root's list, where it may lie, relations of each kind."""

    root: str
    root_key: str
    relations: Mapping[str, Sequence[Relation]] = field(default_factory=dict)


#: The steps of a trajectory: moved points under the action, a tree of clusters under the state.
TRAJECTORY = Shape(
    root="step",
    root_key="steps",
    relations={
        "step": (Relation(("action", "moves"), "moves", "move"), Relation(("state", "clusters"), "clusters", "cluster")),
        "move": (Relation(("points",), "points", "point"),),
        "cluster": (Relation(("members",), "members", "member"), Relation(("children",), "children", "cluster")),
    },
)

#: Levels of recursion that the regular shape has room for.
DEPTH = 8

_NO_CONSTANT = json.JSONDecoder(parse_constant=lambda word: _reject(word))


def _reject(word: str) -> Any:
    raise ValueError(f"{word} is not JSON")


def _decoded(value: Any) -> Any:
    """`value`, or what its JSON text says, however often it is text within text; None if it isn't JSON."""
    while isinstance(value, str):
        try:
            value = _NO_CONSTANT.decode(value)
        except (ValueError, RecursionError):
            return None
    return value


def _is_positions(value: dict) -> bool:
    return all(k.isascii() and k.isdigit() for k in value)


_ONLY_OBJECTS = {dict}


def _gather(value: Any, at: list[int], nodes: list[dict]) -> int:
    """Add position and object of each place of a list in any of its shapes, and say how many; places without an object are left out."""
    if type(value) is str:
        value = _decoded(value)
    if type(value) is list:
        if set(map(type, value)) == _ONLY_OBJECTS:
            at.extend(range(len(value)))
            nodes.extend(value)
            return len(value)
        places = enumerate(value)
    elif type(value) is dict:
        places = sorted(((int(k), v) for k, v in value.items()), key=lambda p: p[0]) if _is_positions(value) else [(0, value)]
    else:
        return 0
    before = len(nodes)
    for place, item in places:
        if type(item) is str:
            item = _decoded(item)
        if type(item) is dict:
            at.append(place)
            nodes.append(item)
    return len(nodes) - before


def _root(text: str | None, shape: Shape) -> Any:
    value = _decoded(text)
    return value[shape.root_key] if isinstance(value, dict) and shape.root_key in value else value


def _under(node: dict, at: Sequence[str]) -> Any:
    for key in at[:-1]:
        node = node.get(key)
        if type(node) is str:
            node = _decoded(node)
        if type(node) is not dict:
            return None
    return node.get(at[-1])


def _attributes(node: dict, inner: frozenset[str]) -> str:
    kept = {k: v for k, v in node.items() if k not in inner}
    for key in ("action", "state"):
        if key in inner and key in node:
            held = _decoded(node[key])
            kept[key] = {k: v for k, v in held.items() if k not in inner} if isinstance(held, dict) else held
    return json.dumps(kept)


def _related(nodes: list[dict], at: Sequence[str]) -> Iterator[Any]:
    """What each object holds under the keys of a relation."""
    if len(at) == 1:
        return (n.get(at[0]) for n in nodes)
    return (_under(n, at) for n in nodes)


def _columns(lists: Iterator[Any]) -> tuple[pa.Array, pa.Array, list[dict]]:
    """Parent index and position of each child, and the children, of one relation of a level."""
    at: list[int] = []
    nodes: list[dict] = []
    offsets = np.cumsum([0, *[0 if value is None else _gather(value, at, nodes) for value in lists]]).astype(np.int32)
    arrow = pa.ListArray.from_arrays(pa.array(offsets), pa.array(at, type=pa.int32()))
    return pc.list_parent_indices(arrow), pc.list_flatten(arrow), nodes


def _regular(shape: Shape, kind: str, depth: int) -> pa.DataType:
    """The type of an object of the regular shape: only its relations; beyond the last level of recursion nothing may be held."""
    tree: dict = {}
    for r in shape.relations.get(kind, ()):
        held = tree
        for key in r.at[:-1]:
            held = held.setdefault(key, {})
        deeper = depth - (r.child == kind)
        held[r.at[-1]] = pa.list_(_regular(shape, r.child, deeper)) if deeper >= 0 else pa.null()

    def typed(held: dict) -> pa.DataType:
        return pa.struct([(k, typed(v) if isinstance(v, dict) else v) for k, v in held.items()])

    return typed(tree)


#: Words that Arrow's reader takes for numbers though they are no JSON; a text that holds one anywhere is decoded by itself.
_NO_NUMBER = "NaN|Inf"


def _read(texts: pa.Array, options: pj.ParseOptions) -> pa.Table | None:
    lines = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], type=pa.int32()), texts), "\n")[0].as_buffer()
    try:
        found = pj.read_json(pa.BufferReader(lines), read_options=pj.ReadOptions(use_threads=False, block_size=lines.size + 64), parse_options=options)
    except pa.ArrowInvalid:
        return None
    return found if found.num_rows == len(texts) else None


def _read_regular(texts: pa.Array, options: pj.ParseOptions) -> list[tuple[int, pa.Table]]:
    """(offset, table) of the stretches of texts that can be read; halves are tried where a whole can't."""
    found, waiting = [], [(0, len(texts))]
    while waiting:
        start, count = waiting.pop()
        table = _read(texts.slice(start, count), options)
        if table is not None:
            found.append((start, table))
        elif count > 1:
            waiting += [(start, count // 2), (start + count // 2, count - count // 2)]
    return found


def _split(texts: pa.Array, shape: Shape) -> tuple[list[tuple[np.ndarray, pa.Array]], np.ndarray]:
    """The root lists of regular records with their rows, and the rows of all other records."""
    plain = pc.cast(texts, pa.string(), safe=False)
    lists = "|".join(sorted({re.escape(r.at[-1]) for rs in shape.relations.values() for r in rs} | {re.escape(shape.root_key)}))
    inner = "|".join(sorted({re.escape(k) for rs in shape.relations.values() for r in rs for k in r.at[:-1]})) or "^$"
    odd = pc.match_substring_regex(plain, rf'"(?:{lists})"\s*:\s*[{{"]|"(?:{inner})"\s*:\s*["\[]|\n|\r|{_NO_NUMBER}')
    even = pc.and_(pc.equal(pc.count_substring(plain, "{"), pc.count_substring(plain, "}")), pc.equal(pc.count_substring(plain, "["), pc.count_substring(plain, "]")))
    sane = pc.and_(even, pc.invert(odd))
    element = _regular(shape, shape.root, DEPTH)
    kinds = {"[": pa.list_(pa.list_(element)), "{": pa.list_(pa.struct([(shape.root_key, pa.list_(element))]))}
    found, left = [], np.ones(len(texts), dtype=bool)
    for opening, kind in kinds.items():
        rows = np.flatnonzero(pc.fill_null(pc.and_(sane, pc.starts_with(plain, opening)), False).to_numpy(zero_copy_only=False))
        if not len(rows):
            continue
        # within a list of its own a text can only be a value or an error, not a part of what is around it
        lines = pc.binary_join_element_wise('{"r":[', plain.take(pa.array(rows)), "]}", "")
        options = pj.ParseOptions(explicit_schema=pa.schema([("r", kind)]), unexpected_field_behavior="ignore")
        for start, table in _read_regular(lines, options):
            held = table["r"].combine_chunks()
            held = held if isinstance(held, pa.Array) else held.chunk(0)
            alone = (held.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) == 1)
            picked = pc.list_flatten(held.filter(pa.array(alone)))
            at = rows[start : start + len(held)][alone]
            if opening == "{":
                picked = picked.field(0) if not picked.null_count else pc.struct_field(picked, [0])
            known = picked.is_valid().to_numpy(zero_copy_only=False)
            left[at[known]] = False
            found.append((at[known], picked.filter(pa.array(known))))
    return found, np.flatnonzero(left)


def _flatten_regular(keys: pa.Array, roots: pa.Array, shape: Shape) -> Iterator[list[pa.Array]]:
    """Levels of nested Arrow arrays as flat columns; nulls keep their position and give no row."""
    frontier = [(shape.root, keys, None, roots, None)]
    depth = 0
    while frontier:
        below = []
        for kind, key, parent, lists, name in frontier:
            up = pc.list_parent_indices(lists)
            nodes = pc.list_flatten(lists)
            if not len(nodes):
                continue
            lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            places = pa.array((np.arange(len(nodes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32))
            if nodes.null_count:
                known = nodes.is_valid()
                up, nodes, places = up.filter(known), nodes.filter(known), places.filter(known)
            own = key.take(up)
            if parent is None:
                from_path, path = pa.nulls(len(nodes), pa.string()), places.cast(pa.string())
            else:
                from_path = parent.take(up)
                path = pc.binary_join_element_wise(from_path, pa.scalar(name), places.cast(pa.string()), "/")
            yield [own, path, from_path, pa.repeat(kind, len(nodes)), pa.array(np.full(len(nodes), depth, dtype=np.int32)), places]
            for r in shape.relations.get(kind, ()):
                held = pc.struct_field(nodes, list(r.at))
                if pa.types.is_list(held.type):
                    below.append((r.child, own, path, held, r.name))
        frontier, depth = below, depth + 1


def _text(raw: bytes | None) -> str | None:
    try:
        return None if raw is None else raw.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _flatten(keys: pa.Array, texts: pa.Array, shape: Shape, inner: frozenset[str] | None) -> Iterator[list[pa.Array]]:
    if inner is None and len(texts):
        regular, rest = _split(texts, shape)
        for rows, roots in regular:
            yield from _flatten_regular(keys.take(pa.array(rows)), roots, shape)
        keys, texts = keys.take(pa.array(rest)), texts.take(pa.array(rest))
    parents, places, nodes = _columns(_root(_text(t), shape) for t in texts.to_pylist())
    key, path = keys.take(parents), places.cast(pa.string())
    frontier = [(shape.root, key, path, pa.nulls(len(nodes), pa.string()), places, nodes)]
    depth = 0
    while frontier:
        below: dict[str, list[tuple]] = {}
        for kind, key, path, parent_path, places, nodes in frontier:
            if not nodes:
                continue
            columns = [key, path, parent_path, pa.repeat(kind, len(nodes)), pa.array(np.full(len(nodes), depth, dtype=np.int32)), places]
            if inner is not None:
                columns.append(pa.array([_attributes(n, inner) for n in nodes], type=pa.string()))
            yield columns
            for r in shape.relations.get(kind, ()):
                up, child_places, children = _columns(_related(nodes, r.at))
                if children:
                    from_path = path.take(up)
                    child_path = pc.binary_join_element_wise(from_path, pa.scalar(r.name), child_places.cast(pa.string()), "/")
                    below.setdefault(r.child, []).append((key.take(up), child_path, from_path, child_places, children))
        frontier = [(kind, *group) for kind, groups in below.items() for group in groups]
        depth += 1


def nested_nodes(df: DataFrame, key: str, text: str, shape: Shape = TRAJECTORY, attributes: bool = False) -> DataFrame:
    """One row per object below a record.

    Columns: `key`, `node_path` (position of the root object, then name and position
    per level, joined by '/'), `parent_path` (null for roots), `kind`, `depth`,
    `position` and, if asked for, `attributes` (JSON of the object without its
    related lists). A lone object is a list of one; an object whose keys are all
    positions is a list, an empty one an empty list; JSON held as text is read as
    that JSON, at any level. A null or a bare value in a list keeps its position and
    gives no row. Null, empty or invalid text (NaN and Infinity are not JSON) gives
    no rows; neither does a record without objects. Rows are independent, so repeated
    keys give repeated rows; an empty table gives an empty table.
    """
    inner = None
    if attributes:
        inner = frozenset(part for rs in shape.relations.values() for r in rs for part in r.at)
    kind = df.schema[key].dataType.simpleString()
    fields = f"{key} {kind}, node_path string, parent_path string, kind string, depth int, position int" + (", attributes string" if attributes else "")
    names = [f.split(" ")[0] for f in fields.split(", ")]

    def flatten(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gc.disable()  # decoded records are trees: they are freed without a search for cycles
        try:
            for batch in batches:
                for columns in _flatten(batch.column(0), batch.column(1), shape, inner):
                    yield pa.RecordBatch.from_arrays(columns, names=names)
        finally:
            gc.enable()

    return df.select(F.col(key), F.col(text).cast("binary").alias("__pl_text")).where("__pl_text is not null").mapInArrow(flatten, fields)


def nested_table(nodes: DataFrame, kind: str, fields: str) -> DataFrame:
    """The objects of one kind with typed `fields` (DDL) next to their keys and paths; what doesn't fit is null."""
    own = [c for c in nodes.columns if c not in ("kind", "attributes")]
    typed = F.from_json("attributes", fields, {"mode": "PERMISSIVE"})
    return nodes.where(F.col("kind") == kind).select(*own, typed.alias("__pl_f")).select(*own, "__pl_f.*")
