"""Deeply nested records as flat tables with parent-child links, by shared inlining of their schema graph.

The graph has a type for each kind of object and its fields with their number. Types that are reached once, from one
place, are inlined into their parent; types that are repeated, shared by several parents or recursive get a table. Each
row has a surrogate for itself and its parent row, and the natural keys of both.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Child:
    """A field that holds objects of ``type``; ``many`` if a list of them."""

    name: str
    type: str
    many: bool = False


@dataclass(frozen=True)
class Node:
    """A type of the graph: its scalar fields, its children, and the fields its key is taken from (the first not null)."""

    scalars: tuple[str, ...] = ()
    children: tuple[Child, ...] = ()
    key: tuple[str, ...] = ()
    bare: str | None = None  # the scalar that a plain value in place of an object stands for


@dataclass
class Graph:
    root: str
    nodes: dict[str, Node]
    tables: dict[str, str] = field(init=False)

    def __post_init__(self) -> None:
        self.tables = self._tables()

    def _tables(self) -> dict[str, str]:
        """The types that need a table, and why: root, repeated, shared or recursive."""
        why = {self.root: "root"}
        parents: dict[str, set] = {}
        for name, node in self.nodes.items():
            for c in node.children:
                parents.setdefault(c.type, set()).add((name, c.name))
                if c.many:
                    why.setdefault(c.type, "repeated")
        for name, at in parents.items():
            if len(at) > 1:
                why.setdefault(name, "shared")
        for name in self.nodes:
            if name in self._below(name):
                why[name] = "recursive"
        return why

    def _below(self, name: str) -> set[str]:
        seen: set[str] = set()
        todo = [c.type for c in self.nodes[name].children]
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += [c.type for c in self.nodes[x].children]
        return seen

    def inlined(self, name: str) -> list[tuple[tuple[str, ...], str]]:
        """Paths and types of what is inlined into the table of ``name``, itself first."""
        out = [((), name)]
        for path, kind in out:
            out += [((*path, c.name), c.type) for c in self.nodes[kind].children if c.type not in self.tables]
        return out

    def columns(self, name: str) -> list[str]:
        return ["_".join((*path, s)) for path, kind in self.inlined(name) for s in self.nodes[kind].scalars]


_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?", re.A)
_SPACE = re.compile(r"[ \t\n\r]*")
_WORDS = (("true", "true"), ("false", "false"), ("null", None))


def _bad(_: str) -> None:
    raise ValueError("not JSON")


def _deep(text: str):
    """JSON of any depth, with an explicit stack; numbers stay text."""
    at, stack, key, value = 0, [], None, None
    strings = json.decoder.scanstring
    while True:
        at = _SPACE.match(text, at).end()
        c = text[at : at + 1]
        if c in ("{", "["):
            stack.append(({} if c == "{" else [], key))
            at = _SPACE.match(text, at + 1).end()
            if text[at : at + 1] == ("}" if c == "{" else "]"):
                at += 1
                value, key = stack.pop()
            else:
                if c == "{":
                    key, at = _name(text, at, strings)
                continue
        elif c == '"':
            value, at = strings(text, at + 1, True)
        else:
            for word, value in _WORDS:
                if text.startswith(word, at):
                    at += len(word)
                    break
            else:
                m = _NUMBER.match(text, at)
                if not m:
                    raise ValueError("not JSON")
                value, at = m[0], m.end()
        while True:  # a value is complete: put it in place, and close what closes
            at = _SPACE.match(text, at).end()
            if not stack:
                if at != len(text):
                    raise ValueError("not JSON")
                return value
            holder, outer = stack[-1]
            if isinstance(holder, dict):
                holder[key] = value
            else:
                holder.append(value)
            c = text[at : at + 1]
            at += 1
            if c == ",":
                if isinstance(holder, dict):
                    key, at = _name(text, _SPACE.match(text, at).end(), strings)
                break
            if c != ("}" if isinstance(holder, dict) else "]"):
                raise ValueError("not JSON")
            stack.pop()
            value, key = holder, outer


def _name(text: str, at: int, strings) -> tuple[str, int]:
    if text[at : at + 1] != '"':
        raise ValueError("not JSON")
    name, at = strings(text, at + 1, True)
    at = _SPACE.match(text, at).end()
    if text[at : at + 1] != ":":
        raise ValueError("not JSON")
    return name, at + 1


def read_json(text: str | None):
    """The value of a JSON text, numbers as their text; text that was encoded again is decoded again. None if it is null
    or cannot be read."""
    for _ in range(8):
        if text is None:
            return None
        try:
            value = json.loads(text, parse_int=str, parse_float=str, parse_constant=_bad)
        except RecursionError:
            try:
                value = _deep(text)
            except ValueError:
                return None
        except ValueError:
            return None
        if not isinstance(value, str):
            return value
        text = value
    return None


def _scalar(value) -> str | None:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace" if any("\ud800" <= c <= "\udfff" for c in value) else "strict").decode()
    return None


def _text(rest: dict) -> str:
    try:
        return json.dumps(rest, sort_keys=True)  # ASCII alone, so lone surrogates stay readable
    except RecursionError:
        return "\"too deep\""


def shred(graph: Graph, record: dict) -> Iterator[tuple]:
    """Rows (table, node, parent table, parent node, field, parent key, key, columns) of one record, parents first.

    A list of one may be a bare object. A type without key passes its parent's on. Null elements and values that
    aren't objects (or plain values, where the type has a place for them) give no rows. Fields that the graph doesn't
    name are kept as one JSON text, ``rest``, by their path below the row (numbers as their text).
    """
    named = {k: {*n.scalars, *(c.name for c in n.children)} for k, n in graph.nodes.items()}
    layout = {t: [(p, graph.nodes[k], named[k]) for p, k in graph.inlined(t)] for t in graph.tables}
    todo = [(graph.root, record, "0", None, None, None, None)]
    while todo:
        table, value, node, above, above_node, via, above_key = todo.pop()
        if not isinstance(value, dict):
            bare = graph.nodes[table].bare
            if bare is None or isinstance(value, list) or (value := _scalar(value)) is None:
                continue
            value = {bare: value}
        columns, found, rest = {}, {}, {}
        for path, kind, known in layout[table]:
            inner = value
            for step in path:
                inner = inner[0] if isinstance(inner, list) and len(inner) == 1 else inner
                inner = inner.get(step) if isinstance(inner, dict) else None
            if isinstance(inner, list) and len(inner) == 1:
                inner = inner[0]
            if isinstance(inner, dict):
                found[path] = (inner, kind)
                for s in kind.scalars:
                    columns["_".join((*path, s))] = _scalar(inner.get(s))
                if not inner.keys() <= known:
                    rest.update((".".join((*path, f)), inner[f]) for f in inner.keys() - known)
        if rest:
            columns["rest"] = _text(rest)
        keys = graph.nodes[table].key
        key = next((columns[k] for k in keys if columns.get(k) is not None), None)
        yield table, node, above, above_node, via, above_key, key, columns
        below, n = [], 0
        for path, (inner, kind) in found.items():
            for c in kind.children:
                if c.type in graph.tables:
                    held = inner.get(c.name)
                    for x in held if isinstance(held, list) else [held]:
                        if x is not None:
                            below.append((c.type, x, f"{node}.{n}", table, node, "_".join((*path, c.name)), key if keys else above_key))
                            n += 1
        todo += reversed(below)


_PATHS = tuple(Child(x, "path", True) for x in ("added", "modified", "removed"))

#: The payloads of all hosts in one graph.
WEBHOOKS = Graph(
    "event",
    {
        "event": Node(
            ("ref", "before", "after", "number"),
            (
                Child("commits", "commit", True),
                Child("push", "push"),
                *(Child(x, "request") for x in ("pull_request", "issue", "object_attributes", "pullrequest")),
                Child("discussions", "comment", True),
                *(Child(x, "person") for x in ("pusher", "sender", "user", "actor")),
            ),
            ("ref",),
        ),
        "person": Node(("id", "login", "username", "name", "email", "display_name", "nickname"), (Child("prefs", "prefs"),), ("login", "username", "nickname", "name")),
        "prefs": Node((), (Child("mail", "mail"),)),
        "mail": Node(("digest",)),
        "push": Node((), (Child("changes", "change", True),)),
        "change": Node((), (Child("new", "new_ref"), Child("old", "old_ref"), Child("commits", "commit", True)), ("new_name", "old_name")),
        "new_ref": Node(("name", "type"), (Child("target", "new_target"),)),
        "old_ref": Node(("name", "type"), (Child("target", "old_target"),)),
        "new_target": Node(("hash", "type", "date", "message")),
        "old_target": Node(("hash", "type", "date", "message")),
        "commit": Node(("id", "hash", "message"), (Child("author", "author"), *_PATHS, Child("files", "change_of_file", True)), ("id", "hash")),
        "author": Node(("name", "email")),
        "path": Node(("path",), (), ("path",), "path"),
        "change_of_file": Node(("status",), (Child("new", "new_path"), Child("old", "old_path")), ("new_path", "old_path")),
        "new_path": Node(("path",)),
        "old_path": Node(("path",)),
        "request": Node(("number", "iid", "id", "title"), (Child("labels", "label", True), Child("review", "review")), ("number", "iid", "id")),
        "label": Node(("id", "name", "title", "color"), (), ("name", "title"), "name"),
        "review": Node((), (Child("threads", "thread", True),)),
        "thread": Node(("path", "line"), (Child("comments", "comment", True),)),
        "comment": Node(("id", "body"), (Child("replies", "comment", True), Child("notes", "comment", True)), ("id",)),
    },
)
#: By provider, the field of a request that is its number.
NUMBER_OF = {"gitlab": ("iid",), "bitbucket": ("id",), "github": ("number",), "gitea": ("number",)}
_PLAIN = {"ref", "before", "after"}


def _record(payload) -> dict:
    record = {}
    for k, v in payload or ():
        if k in _PLAIN:
            record[k] = v
        elif (x := read_json(v)) is not None:
            record[k] = x
    return record


def shred_events(events: DataFrame, key: str = "event_id", wide: bool = True) -> DataFrame:
    """(``key``, provider, tbl, node, parent_tbl, parent_node, via, parent_key, key[, cols]): all rows of all tables of
    the events' payloads, ``cols`` a map of the inlined columns.

    A null or empty payload has its event row only; payload values that are null or not JSON are left out; repeated
    events repeat their rows. Discussions lie beside their request: their parent_key is its number.
    """
    kind = events.schema[key].dataType.simpleString()
    keys = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    entries = F.transform(F.map_entries("payload"), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))
    data = events.select(events[key].alias("_k"), F.col("repository.provider").alias("provider"), entries.alias("p"))
    names = ["_k", "provider", "tbl", "node", "parent_tbl", "parent_node", "via", "parent_key", "key"] + ["cols"] * wide
    types = [keys, *[pa.string()] * 8] + [pa.map_(pa.string(), pa.string())] * wide

    def rows(provider: str | None, payload) -> Iterator[tuple]:
        number, request = NUMBER_OF.get((provider or "").lower(), ("number", "iid", "id")), None
        for table, node, above, above_node, via, above_key, k, columns in shred(WEBHOOKS, _record(payload)):
            if table == "request":
                k = next((columns[x] for x in number if columns.get(x) is not None), None)
                requests[node] = k
                request = request or k
            elif above == "request" or above == "thread" and via == "comments":
                # The key of a request depends on the provider; a thread has none of its own.
                above_key = requests.get(above_node if above == "request" else above_node.rpartition(".")[0])
            elif via == "discussions":
                late.append((table, node, above, above_node, via, k, columns))
                continue
            yield table, node, above, above_node, via, above_key, k, columns
        for table, node, above, above_node, via, k, columns in late:
            yield table, node, above, above_node, via, request, k, columns

    requests: dict[str, str | None] = {}
    late: list[tuple] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for k, provider, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                requests.clear()
                late.clear()
                payload = [(e["key"], e["value"]) for e in payload] if payload else None
                for row in rows(provider, payload):
                    out.append((k, provider, *row[:7], list(row[7].items())) if wide else (k, provider, *row[:7]))
                if len(out) >= 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    schema = f"_k {kind}, " + ", ".join(f"{n} string" for n in names[1:9]) + ", cols map<string,string>" * wide
    return data.mapInArrow(run, schema).withColumnRenamed("_k", key if key != "key" else "_k")


def links(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """(``key``, kind, parent_key, child_key): the distinct links between rows that both have a key."""
    kind = (
        F.when(F.col("tbl") == "commit", "commit")
        .when(F.col("tbl").isin("path", "change_of_file"), "file")
        .when(F.col("tbl") == "label", "label")
        .when((F.col("tbl") == "comment") & (F.col("parent_tbl") == "comment"), "reply")
        .when(F.col("tbl") == "comment", "comment")
    )
    out = rows.select(key, kind.alias("kind"), "parent_key", F.col("key").alias("child_key"))
    return out.where("kind is not null and parent_key is not null and child_key is not null").distinct()


def schema_graph(rows: DataFrame) -> DataFrame:
    """(tbl, field, mapped, n): the schema graph as the records have it: each table's fields by their path below a row,
    in how many rows they hold a value, and whether the graph gives them a column (else they are in ``rest``)."""
    entries = rows.select("tbl", F.explode("cols").alias("field", "value")).where("value is not null and field <> 'rest'").select("tbl", "field", F.lit(True).alias("mapped"))
    others = rows.where("cols['rest'] is not null").select("tbl", F.explode(F.json_object_keys(F.col("cols")["rest"])).alias("field"), F.lit(False).alias("mapped"))
    return entries.unionByName(others).groupBy("tbl", "field", "mapped").agg(F.count("*").alias("n"))


def orphans(rows: DataFrame, key: str = "event_id") -> DataFrame:
    """One row: how many rows name a parent row that isn't there; 0 unless something was lost."""
    there = rows.select(F.col(key).alias("k"), F.col("tbl").alias("t"), F.col("node").alias("n")).distinct()
    below = rows.where("parent_tbl is not null").select(F.col(key).alias("k"), F.col("parent_tbl").alias("t"), F.col("parent_node").alias("n")).distinct()
    return below.join(there, ["k", "t", "n"], "left_anti").agg(F.count("*").alias("orphans"))


def table_of(rows: DataFrame, name: str, key: str = "event_id", graph: Graph = WEBHOOKS) -> DataFrame:
    """The flat table of one type: surrogates, keys and its inlined columns, repeated events counted once."""
    columns = [F.col("cols")[c].alias(f"c_{c}") for c in (*graph.columns(name), "rest")]
    return rows.where(F.col("tbl") == name).select(key, "node", "parent_tbl", "parent_node", "via", "parent_key", "key", *columns).dropDuplicates([key, "node"])
