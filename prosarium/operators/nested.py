"""Nested records to flat tables under Merkle subtree identities.

A record is a graph of objects, lists and values. Each gets an identity made bottom-up from its
canonical form, so equal subtrees have equal identities wherever they occur. `unpack_columns` does
it for typed columns inside the JVM, `unpack_payloads` for JSON text of unknown shape; the same
subtree has the same identity in both. Both emit bridge rows, one per occurrence of a child under
its parent with its name or ordinal, from the record down to the last object; `object_store` keeps
one copy per identity. Store and bridge together hold the whole records.

Canonical form: fields and members that are null are left out; fields have one order; equal
numbers are equal however they are written (5, 5.0, 5e0); a string where children are looked for
that itself holds a JSON object or list counts as that object or list.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Key names that hold children, and the child kinds they give (fixed values).
METRIC_LISTS = ("pitch_adjustments", "rate_adjustments", "volume_adjustments", "break_times")
#: One row per occurrence. parent_id, name (key in an object), ordinal (place in a list, nulls not counted), child_id, kind
#: (object, list, value; unreadable: a payload that is no JSON) and value say what the child is; child, segment and pos are set
#: on the children that the tables are about. An object's value holds its plain fields as JSON, a list has none.
EDGE = T.StructType([T.StructField(n, T.IntegerType() if n in ("ordinal", "pos") else T.StringType()) for n in ("parent_id", "name", "ordinal", "child_id", "kind", "value", "child", "segment", "pos")])
BRIDGE = "record_id long, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in EDGE.fields)
_EXACT = 10**15  # integers below have one form as integers and as doubles


# Typed columns: one SQL expression per record, written here as text, as building it Column by Column takes seconds


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _field(c: str, name: str) -> str:
    return f"{c}.`{name.replace('`', '``')}`"


class _Names:
    """Fresh names for lambda variables."""

    def __init__(self) -> None:
        self.last = 0

    def new(self) -> str:
        self.last += 1
        return f"v{self.last}"

    def let(self, value: str, body: Callable[[str], str]) -> str:
        """body(value) with the value computed once."""
        v = self.new()
        return f"element_at(transform(array({value}), {v} -> {body(v)}), 1)"

    def each(self, values: str, body: Callable[[str, str], str]) -> str:
        v, i = self.new(), self.new()
        return f"transform({values}, ({v}, {i}) -> {body(v, i)})"


def _scalar_identity(c: str, kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return f"sha2(concat('b:', cast({c} as string)), 256)"
    if isinstance(kind, T.NumericType):
        d = f"cast({c} as double)"
        exact = f"format_string('%a', {d})"
        if isinstance(kind, T.IntegralType):
            exact = f"if(cast({d} as decimal(38,0)) = cast({c} as decimal(38,0)), {exact}, cast({c} as string))"
        return f"if({c} is null, null, sha2(concat('n:', if(abs({d}) < {_EXACT}D and {d} = floor({d}), cast(cast({d} as bigint) as string), {exact})), 256))"
    return f"sha2(concat('s:', cast({c} as string)), 256)"


def _nested(kind: T.DataType) -> bool:
    return isinstance(kind, (T.StructType, T.ArrayType, T.MapType))


def _edge(**given: str) -> str:
    return "named_struct(" + ", ".join(f"'{f.name}', cast({given.get(f.name, 'null')} as {f.dataType.simpleString()})" for f in EDGE.fields) + ")"


_NO_EDGES = f"cast(array() as array<{EDGE.simpleString()}>)"


def _key(name: str) -> str:
    """A field's name in an object's canonical form; the length keeps any name from passing for something else."""
    return f"{len(name)}:{name}="


def _map_key(c: str) -> str:
    return f"concat(cast(length({c}) as string), ':', {c}, '=')"


def _kind(kind: T.DataType) -> str:
    return "'list'" if isinstance(kind, T.ArrayType) else "'object'"


def _node(n: _Names, c: str, kind: T.DataType, role: str = "", segment: str | None = None) -> str:
    """struct(id, value, below) of a nested column, null for null; below has the edges of its whole subtree.
    role is the key that the column is found under."""
    made = _object(n, c, kind) if isinstance(kind, T.StructType) else _list(n, c, kind, role, segment) if isinstance(kind, T.ArrayType) else _map(n, c, kind, role)
    return f"if({c} is null, null, {made})"


def _under(own: str, node: str, kind: T.DataType, **at: str) -> str:
    """The edge from `own` to a node, then the node's subtree."""
    return f"concat(array({_edge(parent_id=own, child_id=node + '.id', kind=_kind(kind), value=node + '.value', **at)}), {node}.below)"


def _object(n: _Names, c: str, kind: T.StructType) -> str:
    fields = sorted(kind.fields, key=lambda f: _key(f.name))
    deep, flat = [f for f in fields if _nested(f.dataType)], sorted((f for f in fields if not _nested(f.dataType)), key=lambda f: f.name)
    value = f"to_json(named_struct({', '.join(f'{_quoted(f.name)}, {_field(c, f.name)}' for f in flat)}))" if flat else "'{}'"
    parts = ["0 as none", *(f"{_node(n, _field(c, f.name), f.dataType, f.name)} as n{i}" for i, f in enumerate(deep))]

    def finish(m: str) -> str:
        ids = [f"concat({_quoted(_key(f.name))}, {f'{m}.n{deep.index(f)}.id' if f in deep else _scalar_identity(_field(c, f.name), f.dataType)})" for f in fields]

        def below(own: str) -> str:
            rows = ", ".join(f"if({m}.n{i} is null, {_NO_EDGES}, {_under(own, f'{m}.n{i}', f.dataType, name=_quoted(f.name))})" for i, f in enumerate(deep))
            return f"struct({own} as id, {value} as value, {f'concat({rows})' if rows else _NO_EDGES} as below)"

        return n.let(f"sha2(concat_ws(',', 'o', {', '.join(ids)}), 256)", below)

    return n.let(f"struct({', '.join(parts)})", finish)


def _list(n: _Names, c: str, kind: T.ArrayType, role: str, segment: str | None) -> str:
    inner = kind.elementType
    kept = f"filter({c}, e -> e is not null)"
    if not _nested(inner):
        child = "stripped" if segment is not None and isinstance(inner, T.StringType) else role if role in METRIC_LISTS else None
        at = lambda i: {"child": _quoted(child), "segment": segment or "''", "pos": i} if child else {}

        def finish(m: str) -> str:
            rows = lambda own: n.each(m, lambda e, i: _edge(parent_id=own, ordinal=i, child_id=e + ".id", kind="'value'", value=e + ".text", **at(i)))
            return n.let(f"sha2(concat_ws(',', 'l', {m}.id), 256)", lambda own: f"struct({own} as id, cast(null as string) as value, {rows(own)} as below)")

        return n.let(n.each(kept, lambda e, i: f"struct({_scalar_identity(e, inner)} as id, cast({e} as string) as text)"), finish)
    child = "sequence" if role == "parsed_sequence" and isinstance(inner, T.StructType) else None
    named = child is not None and "segment" in inner.fieldNames()
    at = lambda e, i: {"ordinal": i} | ({"child": _quoted(child), "segment": e + ".segment", "pos": i} if child else {})

    def finish(m: str) -> str:
        rows = lambda own: n.each(m, lambda e, i: _under(own, e + ".node", inner, **at(e, i)))
        return n.let(f"sha2(concat_ws(',', 'l', {m}.node.id), 256)", lambda own: f"struct({own} as id, cast(null as string) as value, flatten({rows(own)}) as below)")

    place = lambda e: f"coalesce(cast({_field(e, 'segment')} as string), '')" if named else "''"
    return n.let(n.each(kept, lambda e, i: f"struct({_node(n, e, inner, role, segment)} as node, {place(e)} as segment)"), finish)


def _map(n: _Names, c: str, kind: T.MapType, role: str) -> str:
    inner = kind.valueType
    held = f"filter(map_entries({c}), e -> e.value is not null)"
    if not _nested(inner):
        ids = n.each(held, lambda e, i: f"concat({_map_key(e + '.key')}, {_scalar_identity(e + '.value', inner)})")
        return f"struct(sha2(concat_ws(',', 'o', array_sort({ids})), 256) as id, to_json(map_from_entries({held})) as value, {_NO_EDGES} as below)"

    def finish(m: str) -> str:
        ids = n.each(m, lambda e, i: f"concat({_map_key(e + '.key')}, {e}.node.id)")
        rows = lambda own: n.each(m, lambda e, i: _under(own, e + ".node", inner, name=e + ".key"))
        return n.let(f"sha2(concat_ws(',', 'o', array_sort({ids})), 256)", lambda own: f"struct({own} as id, '{{}}' as value, flatten({rows(own)}) as below)")

    segment = lambda e: f"cast({e}.key as string)" if role == "stripped_ssml" else None
    return n.let(n.each(held, lambda e, i: f"struct(cast({e}.key as string) as key, {_node(n, e + '.value', inner, '', segment(e))} as node)"), finish)


def unpack_columns(df: DataFrame, record: str, sequence: str | None = None, stripped: str | None = None, metrics: str | None = None) -> DataFrame:
    """Bridge rows (BRIDGE) of typed nested columns, all inside the JVM: one pass with one explode.

    The record is the object of the given columns, under the names parsed_sequence, stripped_ssml and
    metrics; its own row has no parent. Null lists, maps, structs and members have no rows and no
    places; a record of nulls only is an empty object. Extra columns are ignored, an empty table gives no rows.
    """
    used = {n: c for n, c in (("parsed_sequence", sequence), ("stripped_ssml", stripped), ("metrics", metrics)) if c}
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = T.StructType([T.StructField(n, kinds[c]) for n, c in used.items()])
    slim = df.select(F.col(record).cast("long").alias("record_id"), F.struct(*[F.col(c).alias(n) for n, c in used.items()]).alias("record"))
    names = _Names()
    top = lambda v: f"concat(array({_edge(child_id=v + '.id', kind=_quoted('object'), value=v + '.value')}), {v}.below)"
    rows = F.expr(names.let(_node(names, "record", whole), top))
    # Every record has a row of its own. Unlike explode, explode_outer leads to no filter that would make all rows once more.
    return slim.select("record_id", F.explode_outer(rows).alias("r")).select("record_id", "r.*")


# JSON text


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def _number(x: int | float) -> str:
    """One form for equal numbers: digits of integers, else the exact binary form."""
    if abs(x) < _EXACT and x == math.floor(x):
        return str(int(x))
    if isinstance(x, int):
        try:
            same = int(float(x)) == x
        except OverflowError:
            same = False
        if not same:
            return str(x)
    x = float(x)
    if math.isinf(x):
        return "Infinity" if x > 0 else "-Infinity"
    digits, power = x.hex().split("p")
    digits = digits.rstrip("0")
    return f"{digits}0p{int(power)}" if digits.endswith(".") else f"{digits}p{int(power)}"


def _leaf(x: object) -> str:
    """Identity of a plain value."""
    if isinstance(x, str):
        return _sha("s:" + x)
    return _sha("b:" + str(x).lower() if isinstance(x, bool) else "n:" + _number(x))


def _no_constant(name: str) -> float:
    raise ValueError(f"{name} is not JSON")


def parse_json(text: str | None) -> tuple[bool, object]:
    """(valid, value) by the JSON standard: NaN and Infinity are no values."""
    if not text:
        return False, None
    try:
        try:
            return True, json.loads(text, parse_constant=_no_constant)
        except RecursionError:
            return True, _read_deep(text)
    except ValueError:
        return False, None


_SPACE = re.compile(r"[ \t\n\r]*")
_SCALAR = json.JSONDecoder(parse_constant=_no_constant).scan_once


def _read_deep(text: str) -> object:
    """As json.loads, for values nested deeper than it reads."""
    skip = lambda i: _SPACE.match(text, i).end()
    top: list[object] = []
    open_: list[tuple[object, str]] = [(top, "")]  # objects and lists whose end isn't read, with the key of the member at hand

    def member(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"no key at {i}")
        key, i = _SCALAR(text, i)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError(f"no colon at {i}")
        return key, skip(i + 1)

    i = skip(0)
    while True:
        holder, key = open_[-1]
        mark = text[i : i + 1]
        if mark in ("{", "["):
            value: object = {} if mark == "{" else []
            i = skip(i + 1)
            inside = text[i : i + 1] != ("}" if mark == "{" else "]")
        else:
            try:
                value, i = _SCALAR(text, i)
            except StopIteration as e:
                raise ValueError(f"no value at {i}") from e
            inside = False
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)
        if inside:
            name, i = member(i) if mark == "{" else ("", i)
            open_.append((value, name))
            continue
        if mark in ("{", "["):
            i += 1
        while True:  # what follows a value
            i = skip(i)
            holder = open_[-1][0]
            if holder is top:
                if i != len(text):
                    raise ValueError(f"more at {i}")
                return top[0]
            after = text[i : i + 1]
            i += 1
            if after == ",":
                i = skip(i)
                if isinstance(holder, dict):
                    name, i = member(i)
                    open_[-1] = holder, name
                break
            if after != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError(f"no end at {i}")
            open_.pop()


def _written(x: object, sort_keys: bool = False) -> str:
    """JSON text, of any depth."""
    try:
        return json.dumps(x, ensure_ascii=False, sort_keys=sort_keys)
    except RecursionError:
        pass
    out: list[str] = []
    todo: list[tuple[object, bool]] = [(x, False)]
    while todo:
        v, raw = todo.pop()
        if raw or not isinstance(v, (dict, list)):
            out.append(v if raw else json.dumps(v, ensure_ascii=False))
            continue
        parts: list[tuple[object, bool]] = []
        for k, m in (sorted(v.items(), key=lambda e: e[0]) if sort_keys else v.items()) if isinstance(v, dict) else enumerate(v):
            parts += [(", " if parts else "", True), (json.dumps(k, ensure_ascii=False) + ": " if isinstance(v, dict) else "", True), (m, False)]
        ends = "{}" if isinstance(v, dict) else "[]"
        todo += reversed([(ends[0], True), *parts, (ends[1], True)])
    return "".join(out)


def _opened(x: object) -> object:
    """A string that itself holds a JSON object or list, read; anything else as it is."""
    if isinstance(x, str) and (s := x.strip(" \t\r\n"))[:1] in ("{", "["):
        ok, inner = parse_json(s)
        if ok:
            return inner
    return x


def _text(x: object) -> str:
    return x if isinstance(x, str) else "" if x is None else _written(x)


class _Node:
    """An occurrence of an object, list or value in a record."""

    __slots__ = ("child", "flat", "kind", "members", "name", "ordinal", "own", "parent", "pos", "segment", "value")

    def __init__(self, kind: str, parent: _Node | None, name: str | None, ordinal: int | None):
        self.kind, self.parent, self.name, self.ordinal = kind, parent, name, ordinal
        self.members: list[_Node] = []
        self.flat: dict[str, object] = {}  # an object's plain fields
        self.child = self.segment = self.pos = self.value = None
        self.own = ""


def graph(value: object) -> list[_Node]:
    """All occurrences of a record in document order, each with its identity.

    The key names decide, at any depth: parsed_sequence has objects, stripped_ssml strings by
    segment, the METRIC_LISTS values. A lone value counts as a list of one, lists within lists are
    read in order. Places count over the kept children of the record (of the segment for stripped).
    """
    nodes: list[_Node] = []
    places: dict[tuple[str, str], int] = {}
    # A value with what it is looked through for (a key name, "any", "strings" of a segment, or "" for nothing), its holder and its name there.
    todo: list[tuple[object, str, str, _Node | None, str | None]] = [(value, "any", "", None, None)]
    while todo:
        x, role, segment, up, name = todo.pop()
        if role:
            x = _opened(x)
        if x is None:
            continue
        kind = "object" if isinstance(x, dict) else "list" if isinstance(x, list) else "value"
        child, inner = None, role
        if kind == "object":
            if role == "parsed_sequence":
                child, segment, inner = "sequence", _text(x.get("segment")), ""
            elif role in METRIC_LISTS:
                child, inner = role, ""
            elif role == "strings":
                inner = ""
        elif kind == "value":
            child = "stripped" if role == "strings" and isinstance(x, str) else role if role in METRIC_LISTS else None
            if child is None and up is not None and up.kind == "object":
                up.flat[name] = x
                continue
        node = _Node(kind, up, name, len(up.members) if up is not None and up.kind == "list" else None)
        nodes.append(node)
        if up is not None:
            up.members.append(node)
        if child:
            by = (child, segment if child == "stripped" else "")
            node.child, node.segment, node.pos = child, segment if child in ("sequence", "stripped") else "", places.get(by, 0)
            places[by] = node.pos + 1
        if kind == "list":
            todo += [(v, inner, segment, node, None) for v in reversed(x)]
        elif kind == "object":
            if role == "stripped_ssml":
                todo += [(v, "strings", k, node, k) for k, v in reversed(x.items())]
            elif inner:
                todo += [(v, k if k in METRIC_LISTS or k in ("parsed_sequence", "stripped_ssml") else "any", "", node, k) for k, v in reversed(x.items())]
            else:
                node.flat = {k: v for k, v in x.items() if v is not None and not isinstance(v, (dict, list))}
                todo += [(v, "", "", node, k) for k, v in reversed(x.items()) if isinstance(v, (dict, list))]
        else:
            node.value, node.own = x if isinstance(x, str) else _written(x), _leaf(x)
    for n in reversed(nodes):  # members come after their holders
        if n.kind == "object":
            parts = [_key(k) + _leaf(v) for k, v in n.flat.items()] + [_key(m.name) + m.own for m in n.members]
            n.own = _sha(",".join(["o", *sorted(parts)]))
            n.value = _written(n.flat, sort_keys=True)
        elif n.kind == "list":
            n.own = _sha(",".join(["l", *(m.own for m in n.members)]))
    return nodes


def unpack_payloads(df: DataFrame, record: str, payload: str) -> DataFrame:
    """Bridge rows (BRIDGE) of records held as JSON text, of any depth.

    Payloads that are null or empty have no rows; those that are not valid JSON have one row of kind
    'unreadable' without identities, so that they can be counted. Work goes batch by batch, nothing is gathered per key.
    """
    schema = pa.schema([("record_id", pa.int64()), *((f.name, pa.int32() if isinstance(f.dataType, T.IntegerType) else pa.string()) for f in EDGE.fields)])

    def batch(cols: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([_clean(x) for x in c] if f.type == pa.string() else c, f.type) for c, f in zip(cols, schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in schema]
        for b in batches:
            for rid, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ok, value = parse_json(text)
                if ok:
                    rows = ((rid, n.parent and n.parent.own, n.name, n.ordinal, n.own, n.kind, n.value, n.child, n.segment, n.pos) for n in graph(value))
                else:
                    rows = iter([(rid, None, None, None, None, "unreadable", None, None, None, None)] if text else [])
                for row in rows:
                    for c, x in zip(cols, row):
                        c.append(x)
                if len(cols[0]) >= 50_000:
                    yield batch(cols)
                    cols = [[] for _ in schema]
        yield batch(cols)

    return df.select(F.col(record).cast("long"), F.col(payload).cast("string")).mapInArrow(run, BRIDGE)


def _clean(x: str | None) -> str | None:
    """Lone surrogates, which JSON escapes can make, have no UTF-8 form."""
    return x if x is None or x.isascii() else x.encode("utf-8", "replace").decode("utf-8")


def object_store(bridge: DataFrame) -> DataFrame:
    """child_id, kind, value, occurrences: one row per distinct object, list and value, however often it occurs.

    Every parent_id of the bridge is a child_id here. Rows without identity (unreadable payloads) are left out. Counting
    before the shuffle keeps a value that most records share from loading one task.
    """
    return bridge.where(F.col("child_id").isNotNull()).groupBy("child_id").agg(F.min("kind").alias("kind"), F.min("value").alias("value"), F.count(F.lit(1)).alias("occurrences"))
