"""Nested records as flat tables: columnar shredding with repetition and definition levels.

A batch of records is shredded into one column for each leaf path of a *shape*: the values in document order, and
for each of them a repetition level (how deep the list is that starts a new element here; 0 starts a record) and a
definition level (how much of the path is there). The flat table of a repeated ancestor is then put together from the
level sequences alone, with array operations over whole columns; a record is never walked a second time.

The stored form of a list is not always a list. Lists are normalised while shredding:

* a list holds its elements at their positions, counting elements that aren't objects;
* an object whose keys are all decimal numbers holds its elements at those positions;
* any other object that isn't empty stands for a list of that one object, at position 0;
* text that holds JSON counts as its content; anything else, and the empty object, holds no element.

Positions needn't be contiguous, so each repeated node has a leaf of its own, ``#``, with the position.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship
from .batches import pieces

POSITION = "#"


@dataclass(frozen=True)
class Node:
    """A node of a shape. ``kind``: ``struct`` (fields), ``list`` (fields of its objects), ``values`` (a list of plain values),
    ``leaf`` or ``map`` (open keys)."""

    kind: str
    fields: dict[str, Node] = field(default_factory=dict)


def struct(**fields: Node) -> Node:
    return Node("struct", fields)


def listed(**fields: Node) -> Node:
    return Node("list", fields)


LEAF, MAP, VALUES = Node("leaf"), Node("map"), Node("values")

#: The nested parts of a results record that are turned into tables.
RECORD_SHAPE = struct(
    checks=listed(compilation=LEAF, tests=LEAF, coverage=LEAF, invocation=LEAF, mutation=LEAF),
    coverage_stats=listed(covered_lines=LEAF, total_lines=LEAF, line_coverage=LEAF),
    function_component=struct(
        argument_definitions_lsp=listed(
            name=LEAF, type=LEAF, definitions=listed(type_name=LEAF, definition=LEAF, location=LEAF)
        )
    ),
    metadata=MAP,
)


def decoded(value):
    """JSON held in text counts as its content; other text, and broken JSON, stays as it is."""
    if isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def elements(value) -> list[tuple[int, dict]]:
    """(position, object) of a list in any of its stored forms."""
    value = decoded(value)
    if isinstance(value, list):
        items = enumerate(value)
    elif isinstance(value, dict) and value:
        if all(k.isascii() and k.isdigit() for k in value):
            items = sorted((int(k), v) for k, v in value.items())
        else:
            items = ((0, value),)
    else:
        return []
    out = []
    for i, item in items:
        item = decoded(item)
        if isinstance(item, dict):
            out.append((i, item))
    return out


def plain_values(value) -> list[tuple[int, object]]:
    """(position, value) of the elements of a list that are neither null nor objects nor lists."""
    value = decoded(value)
    return [(i, x) for i, x in enumerate(value) if x is not None and not isinstance(decoded(x), (dict, list))] if isinstance(value, list) else []


class Column_:
    """A shredded leaf column."""

    __slots__ = ("values", "rep", "dfn")

    def __init__(self) -> None:
        self.values: list = []
        self.rep: list[int] = []
        self.dfn: list[int] = []


class Shredder:
    """Shreds records into columns by leaf path; list nodes have the path's last part with ``[]``."""

    def __init__(self, shape: Node) -> None:
        self.shape = shape
        self.columns: dict[str, Column_] = {}
        self._declare(shape, "")

    def _declare(self, node: Node, path: str) -> None:
        if node.kind in ("leaf", "map"):
            self.columns[path] = Column_()
            if node.kind == "map":
                self.columns[f"{path}[].{POSITION}"] = Column_()
            return
        if node.kind in ("list", "values"):
            path = f"{path}[]"
            self.columns[f"{path}.{POSITION}"] = Column_()
        if node.kind == "values":
            self.columns[f"{path}.value"] = Column_()
        for name, child in node.fields.items():
            self._declare(child, f"{path}.{name}" if path else name)

    def add(self, record) -> None:
        self._walk(self.shape, "", decoded(record), 0, 0, 0)

    def _put(self, path: str, rep: int, dfn: int, value) -> None:
        c = self.columns[path]
        c.values.append(value)
        c.rep.append(rep)
        c.dfn.append(dfn)

    def _absent(self, node: Node, path: str, rep: int, dfn: int) -> None:
        if node.kind == "leaf":
            self._put(path, rep, dfn, None)
            return
        if node.kind == "map":
            self._put(path, rep, dfn, None)
            self._put(f"{path}[].{POSITION}", rep, dfn, None)
            return
        if node.kind in ("list", "values"):
            path = f"{path}[]"
            self._put(f"{path}.{POSITION}", rep, dfn, None)
        if node.kind == "values":
            self._put(f"{path}.value", rep, dfn, None)
        for name, child in node.fields.items():
            self._absent(child, f"{path}.{name}" if path else name, rep, dfn)

    def _walk(self, node: Node, path: str, value, rep: int, dfn: int, depth: int) -> None:
        """depth: lists above this node; dfn: nodes of the path that are there."""
        if node.kind == "leaf":
            self._put(path, rep, dfn + (value is not None), value)
            return
        value = decoded(value)
        if node.kind == "map":
            leaves = list(_leaves(value, "")) if isinstance(value, dict) else []
            if not leaves:
                self._absent(node, path, rep, dfn)
            for i, (key, leaf) in enumerate(leaves):
                at = rep if i == 0 else depth + 1
                self._put(f"{path}[].{POSITION}", at, dfn + 1, key)
                self._put(path, at, dfn + 1, leaf)
            return
        if node.kind == "values":
            found = plain_values(value)
            if not found:
                self._absent(node, path, rep, dfn)
            for i, (position, item) in enumerate(found):
                at = rep if i == 0 else depth + 1
                self._put(f"{path}[].{POSITION}", at, dfn + 1, position)
                self._put(f"{path}[].value", at, dfn + 1, item)
            return
        if node.kind == "list":
            found = elements(value)
            if not found:
                self._absent(node, path, rep, dfn)
                return
            below = f"{path}[]"
            for i, (position, item) in enumerate(found):
                at = rep if i == 0 else depth + 1
                self._put(f"{below}.{POSITION}", at, dfn + 1, position)
                for name, child in node.fields.items():
                    self._walk(child, f"{below}.{name}", item.get(name), at, dfn + 1, depth + 1)
            return
        there = isinstance(value, dict)
        for name, child in node.fields.items():
            sub = f"{path}.{name}" if path else name
            if there:
                self._walk(child, sub, value.get(name), rep, dfn + bool(path), depth)
            else:
                self._absent(child, sub, rep, dfn)


def _leaves(value, prefix: str) -> Iterator[tuple[str, str]]:
    for key, item in value.items():
        path = f"{prefix}.{key}" if prefix else str(key)
        inner = decoded(item)
        if isinstance(inner, dict):
            yield from _leaves(inner, path)
        elif item is not None:
            yield path, _text(item)


def _text(value) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False)


def assemble(columns: dict[str, Column_], ancestor: str, above: tuple[str, ...] = ()) -> pd.DataFrame:
    """The flat table of one repeated ancestor, from the level sequences.

    ancestor: a list path such as ``checks[]``; above: the list paths over it, outermost first. The result has the
    ordinal of the record, the position in each list, and one text column for each leaf below the ancestor that is in no
    further list; leaves of objects within are named ``a.b``. Of a map the positions are its keys, and the leaf is ``value``.
    """
    depth = len(above) + 1
    key = columns[f"{ancestor}.{POSITION}"]
    rep, dfn = np.asarray(key.rep, np.int32), np.asarray(key.dfn, np.int32)
    record = np.cumsum(rep == 0) - 1
    there = dfn >= _full(ancestor)
    out = {"record": record[there]}
    for level, outer in enumerate(above, start=1):
        # an entry of the ancestor starts a new element of the outer list where its repetition level is at most that list's
        outer_key = columns[f"{outer}.{POSITION}"]
        ordinal = np.cumsum(rep <= level) - 1
        positions = np.asarray([-1 if v is None else v for v in outer_key.values], np.int64)
        out[f"position_{level}"] = positions[ordinal][there]
    values = np.asarray(key.values, object)[there]
    out[f"position_{depth}"] = values
    prefix = f"{ancestor}."
    for path, c in columns.items():
        name = path[len(prefix) :] if path.startswith(prefix) else ""
        if name and name != POSITION and "[]" not in name and f"{path}[].{POSITION}" not in columns:
            out[name] = [_text(v) for v, ok in zip(c.values, there, strict=True) if ok]
    if (leaf := columns.get(ancestor.removesuffix("[]"))) is not None:
        out["value"] = [v for v, ok in zip(leaf.values, there, strict=True) if ok]
    return pd.DataFrame(out)


def _full(path: str) -> int:
    """Definition level at which an element of the list exists: named nodes above it that can be absent, and itself."""
    parts = path.split(".")
    return len(parts)


def shred(values, shape: Node = RECORD_SHAPE) -> dict[str, Column_]:
    """Shred decoded records (dicts, or None for no record)."""
    s = Shredder(shape)
    for value in values:
        s.add(value)
    return s.columns


def _reject(name: str):
    raise ValueError(f"{name} isn't JSON")


def parse_record(line: str | None):
    """The record of a line if the line is one complete JSON object, else None."""
    if line is None:
        return None
    try:
        value = json.loads(line, parse_constant=_reject)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


#: Tables of ``RECORD_SHAPE`` that aren't named by the last part of their path.
RECORD_NAMES = {"function_component.argument_definitions_lsp[]": "arguments"}


def tables_of(shape: Node, names: dict[str, str] | None = None) -> dict[str, tuple[str, tuple[str, ...], bool]]:
    """Tables of a shape by name: (list path, list paths above it, whether it is a map).

    A table is named by ``names``, else by the last part of its path, or by its whole path where that is taken.
    """
    out: dict[str, tuple[str, tuple[str, ...], bool]] = {}

    def walk(node: Node, path: str, above: tuple[str, ...]) -> None:
        if node.kind in ("list", "values", "map"):
            path = f"{path}[]"
            name = (names or {}).get(path) or path.removesuffix("[]").split(".")[-1].removesuffix("[]")
            out[path.removesuffix("[]") if name in out else name] = (path, above, node.kind == "map")
            above = (*above, path)
        for name, child in node.fields.items():
            walk(child, f"{path}.{name}" if path else name, above)

    walk(shape, "", ())
    return out


def _children(keys, columns: dict[str, Column_], tables: dict[str, tuple[str, tuple[str, ...], bool]]) -> pd.DataFrame | None:
    frames = []
    for name, (ancestor, above, is_map) in tables.items():
        t = assemble(columns, ancestor, above)
        if t.empty:
            continue
        path, parent = _paths(ancestor, above, t, is_map)
        attributes = [c for c in t.columns if c != "record" and not c.startswith("position_")]
        rows = t[attributes].to_dict("records")
        frames.append(
            pd.DataFrame(
                {
                    "record": t["record"],
                    "node_table": name,
                    "node_path": path,
                    "parent_path": parent,
                    "position": t[f"position_{len(above) + 1}"].astype(str),
                    "attributes": [[(k, v) for k, v in r.items() if v is not None] for r in rows],
                }
            )
        )
    if not frames:
        return None
    out = pd.concat(frames, ignore_index=True)
    return out.assign(key=np.asarray(keys, object)[out["record"].to_numpy()])


def _paths(ancestor: str, above: tuple[str, ...], t: pd.DataFrame, is_map: bool) -> tuple[list[str], list[str]]:
    """Paths of the elements with their positions or keys, and of the elements that hold them ('' for the record)."""
    parts = ancestor.split("[]")[:-1]
    path = [""] * len(t)
    parent = path
    for level, part in enumerate(parts, start=1):
        parent = path
        form = "{}{}.{}" if is_map and level == len(parts) else "{}{}[{}]"
        path = [form.format(p, part, i) for p, i in zip(path, t[f"position_{level}"], strict=True)]
    return path, parent


def shredded_children(df: DataFrame, key: str, source: str | Column, shape: Node = RECORD_SHAPE, names: dict[str, str] | None = RECORD_NAMES) -> DataFrame:
    """Flat child rows of JSON records: ``key, node_table, node_path, parent_path, position, attributes``.

    There is a table for each list and map of the shape, see ``tables_of``. df: any columns; ``key`` identifies the record, ``source`` is a JSON text column (for nested columns, pass
    ``to_json(struct(...))``). Lines that are null, blank, broken or no object have no children, repeated lines have
    theirs under each key, an empty table gives an empty one, and other columns of ``df`` aren't touched. ``node_path``
    names the child in its record, ``parent_path`` the child that holds it ('' for the record itself), ``attributes``
    its own leaves that aren't null.

    One narrow pass: no shuffle, and a task holds a few megabytes of lines, or one longer line, as columns.
    """
    ship(df.sparkSession)
    tables = tables_of(shape, names)
    source = F.col(source) if isinstance(source, str) else source
    key_type = df.schema[key].dataType
    schema = T.StructType(
        [
            T.StructField(key, key_type),
            *(T.StructField(n, T.StringType()) for n in ("node_table", "node_path", "parent_path", "position")),
            T.StructField("attributes", T.MapType(T.StringType(), T.StringType())),
        ]
    )
    arrow_key = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[key_type.simpleString()]
    arrow = pa.schema(
        [
            (key, arrow_key),
            *((n, pa.string()) for n in ("node_table", "node_path", "parent_path", "position")),
            ("attributes", pa.map_(pa.string(), pa.string())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, 1):
                keys, lines = part.column(0).to_pylist(), part.column(1).to_pylist()
                out = _children(keys, shred(map(parse_record, lines), shape), tables)
                if out is not None:
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(out["key"].tolist(), arrow_key),
                            *(pa.array(out[n].tolist(), pa.string()) for n in arrow.names[1:5]),
                            pa.array(out["attributes"].tolist(), arrow.types[5]),
                        ],
                        schema=arrow,
                    )

    return df.select(F.col(key), source.alias("__source")).mapInArrow(run, schema)


def child_table(children: DataFrame, name: str, key: str, attributes: dict[str, str]) -> DataFrame:
    """One of the flat tables, with typed attribute columns (``try_cast``: null where the text doesn't fit)."""
    wanted = [F.expr(f"try_cast(attributes['{a}'] AS {kind})").alias(a) for a, kind in attributes.items()]
    return children.where(F.col("node_table") == name).select(key, "node_path", "parent_path", F.expr("try_cast(position AS int)").alias("position"), *wanted)
