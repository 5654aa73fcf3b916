"""Nested records as flat tables, by columnar shredding.

A record is read once and shredded to one column per leaf path, each entry carrying a repetition and a definition level. Tables
of a repeated ancestor are then rebuilt from the level sequences alone, a batch at a time, so that a table never touches the
leaves of another. All of it is one narrow stage: no shuffle, no group, memory bounded by an Arrow batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Node:
    """A member of a record. A repeated one may come as a list, as a lone object, or inside a wrapper object of which only the
    member `inside` counts. A scalar where an object is expected stands for the child `scalar`."""

    name: str
    children: tuple[Node, ...] = ()
    repeated: bool = False
    inside: str = ""
    scalar: str = ""
    label: str = ""


@dataclass
class Column:
    """One leaf's entries over a batch of records. ancestor[d] is the definition level from which the d-th repeated ancestor's
    slot exists; full[d] that from which its member isn't null."""

    path: str
    ancestor: tuple[int, ...]
    full: tuple[int, ...]
    most: int
    rep: list[int] = field(default_factory=list)
    defs: list[int] = field(default_factory=list)
    values: list[str] = field(default_factory=list)


def leaf(name: str) -> Node:
    return Node(name)


#: The parts of a bibliographic payload that become tables.
PAYLOAD = (
    Node(
        "authorList",
        (
            leaf("fullName"), leaf("firstName"), leaf("lastName"), leaf("initials"), leaf("collectiveName"),
            Node("authorId", (leaf("type"), leaf("value")), repeated=True, scalar="value", label="own_id"),
            Node("authorAffiliationDetailsList", (leaf("affiliation"),), repeated=True, inside="authorAffiliation", scalar="affiliation", label="affiliation"),
        ),
        repeated=True, inside="author", scalar="fullName", label="author",
    ),
    Node("authorIdList", (leaf("type"), leaf("value")), repeated=True, inside="authorId", scalar="value", label="author_id"),
    Node(
        "journalInfo",
        (leaf("issue"), leaf("volume"), leaf("yearOfPublication"), Node("journal", (leaf("title"), leaf("issn"), leaf("isoabbreviation")))),
        label="journal_info",
    ),
    Node("fullTextUrlList", (leaf("url"), leaf("site"), leaf("documentStyle"), leaf("availability"), leaf("availabilityCode")), repeated=True, inside="fullTextUrl", scalar="url", label="full_text_url"),
)


def read_record(payload: str | None) -> dict | None:
    """The record of a payload, or None where it can't be read. A byte order mark, a record that was encoded twice, a list of
    one, and the envelopes {"result": ...} and {"resultList": {"result": [...]}} are taken off."""
    if not payload:
        return None
    try:
        x = json.loads(payload.lstrip("\ufeff \t\r\n"))
        for _ in range(6):
            if isinstance(x, str):
                x = json.loads(x.lstrip("\ufeff \t\r\n"))
            elif isinstance(x, list):
                x = next((m for m in x if m is not None), None)
            elif isinstance(x, dict) and isinstance(x.get("resultList"), dict):
                x = x["resultList"].get("result")
            elif isinstance(x, dict) and isinstance(x.get("result"), (dict, list)):
                x = x["result"]
            else:
                break
    except (ValueError, RecursionError):
        return None
    return x if isinstance(x, dict) else None


def members(x: object, node: Node) -> list | None:
    """The slots of a repeated node, null ones included; None where there is no list at all."""
    if isinstance(x, dict) and node.inside:
        x = x.get(node.inside)
    if x is None or x == "" or x == {} and node.inside:
        return None
    return x if isinstance(x, list) else [x]


class Shredder:
    """Compiles a tree of nodes to one writer per record; columns fill as records are written."""

    def __init__(self, nodes: tuple[Node, ...]) -> None:
        self.nodes = nodes
        self.columns: dict[str, Column] = {}
        self._plan = [self._compile(n, "", 0, 0, (), ()) for n in nodes]

    def _compile(self, n: Node, prefix: str, level: int, depth: int, anc: tuple, full: tuple) -> tuple:
        path = f"{prefix}.{n.name}" if prefix else n.name
        if not n.children:
            self.columns[path] = Column(path, anc, full, level + 1)
            return ("leaf", n.name, self.columns[path], level)
        if n.repeated:  # levels: list there, slot there, member not null
            kids = [self._compile(c, path, level + 2, depth + 1, (*anc, level + 1), (*full, level + 2)) for c in n.children]
        else:
            kids = [self._compile(c, path, level + 1, depth, anc, full) for c in n.children]
        return ("list" if n.repeated else "object", n.name, kids, level, depth, n)

    def write(self, record: dict | None) -> None:
        for part in self._plan:
            self._write(part, (record or {}).get(part[1]), 0)

    def _none(self, part: tuple, rep: int, level: int) -> None:
        """Nothing below: each leaf gets one entry of the level reached."""
        if part[0] == "leaf":
            c = part[2]
            c.rep.append(rep)
            c.defs.append(level)
        else:
            for kid in part[2]:
                self._none(kid, rep, level)

    def _write(self, part: tuple, x: object, rep: int) -> None:
        kind = part[0]
        if kind == "leaf":
            c, level = part[2], part[3]
            c.rep.append(rep)
            if x is None or x == {} or x == []:
                c.defs.append(level)
            else:
                c.defs.append(level + 1)
                c.values.append(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False))
        elif kind == "object":
            _, _, kids, level, _, n = part
            if isinstance(x, list):
                x = x[0] if x else None
            if not x or not isinstance(x, dict):
                for kid in kids:
                    self._none(kid, rep, level)
            else:
                for kid in kids:
                    self._write(kid, x.get(kid[1]), rep)
        else:
            _, _, kids, level, depth, n = part
            slots = members(x, n)
            if not slots:
                for kid in kids:
                    self._none(kid, rep, level)
                return
            for i, m in enumerate(slots):
                at = rep if i == 0 else depth + 1
                if m is None:
                    for kid in kids:
                        self._none(kid, at, level + 1)
                elif isinstance(m, dict):
                    for kid in kids:
                        self._write(kid, m.get(kid[1]), at)
                else:
                    for kid in kids:
                        self._write(kid, m if kid[1] == n.scalar else None, at)


def places(c: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """From a leaf's levels alone: record number, place in the first and in the second repeated ancestor (0 where there is
    none), definition level, and the index of the value (-1 where there is none) of each entry."""
    rep, defs = np.asarray(c.rep, np.int32), np.asarray(c.defs, np.int32)
    record = np.cumsum(rep == 0) - 1
    at = np.arange(len(rep))

    def count(depth: int) -> np.ndarray:
        """Slots of this depth since the last entry that opened an outer one."""
        opens = rep <= depth
        outer = np.maximum.accumulate(np.where(rep < depth, at, 0)) if len(rep) else at
        slots = np.cumsum(opens)
        return np.where(defs >= c.ancestor[depth - 1], slots - slots[outer] + 1, 0)

    first = count(1) if len(c.ancestor) > 0 else np.zeros(len(rep), int)
    second = count(2) if len(c.ancestor) > 1 else np.zeros(len(rep), int)
    has = defs == c.most
    return record, first, second, defs, np.where(has, np.cumsum(has) - 1, -1)


def rebuild(s: Shredder, label: str) -> dict[str, np.ndarray | list]:
    """The table of one labelled node: record number, pos, sub_pos and the node's own scalar leaves, null members left out."""
    node, prefix = _find(s.nodes, label)
    names = [n for n in _scalars(node)]
    lead = s.columns[f"{prefix}.{names[0]}"]
    record, first, second, defs, _ = places(lead)
    depth = len(lead.ancestor)
    here = defs >= lead.full[-1] if node.repeated else _object_here(s, prefix, names)
    keep = np.flatnonzero(here)
    out: dict[str, np.ndarray | list] = {"record": record[keep], "pos": first[keep] if depth else np.ones(len(keep), int), "sub_pos": second[keep]}
    for name in names:
        c = s.columns[f"{prefix}.{name}"]
        *_, index = places(c)
        values = np.asarray([*c.values, None], object)
        out[name] = values[index[keep]].tolist()
    return out


def _object_here(s: Shredder, prefix: str, names: list[str]) -> np.ndarray:
    """An object that isn't repeated is there where any of its leaves got past the object's own level."""
    defs = [np.asarray(s.columns[f"{prefix}.{n}"].defs) for n in names]
    floor = s.columns[f"{prefix}.{names[0]}"].most - 1
    return np.logical_or.reduce([d >= floor for d in defs]) if defs else np.zeros(0, bool)


def _scalars(node: Node, prefix: str = "") -> list[str]:
    out = []
    for c in node.children:
        if not c.children:
            out.append(prefix + c.name)
        elif not c.repeated:
            out += _scalars(c, f"{prefix}{c.name}.")
    return out


def _find(nodes: tuple[Node, ...], label: str, prefix: str = "") -> tuple[Node, str]:
    for n in nodes:
        path = f"{prefix}.{n.name}" if prefix else n.name
        if n.label == label:
            return n, path
        if n.children and (found := _find(n.children, label, path))[0]:
            return found
    return (None, "") if prefix else (_ for _ in ()).throw(KeyError(label))


def _column_name(path: str) -> str:
    return "".join("_" + ch.lower() if ch.isupper() else ch for ch in path).replace(".", "_")


def child_tables(df: DataFrame, id_col: str, payload_col: str, labels: tuple[str, ...], *, nodes: tuple[Node, ...] = PAYLOAD, values: bool = True) -> DataFrame:
    """df -> (parent_id, child, pos, sub_pos, [leaf columns of all the labels]): one row per child of a readable record.

    A null, empty or unreadable payload gives no row; a null member none either, but it keeps its place; repeated records give
    their children again; other columns of df, whatever their names, are left alone.
    """
    shape = Shredder(nodes)
    leaves = {label: [_column_name(x) for x in _scalars(_find(shape.nodes, label)[0])] for label in labels} if values else {label: [] for label in labels}
    extra = list(dict.fromkeys(x for label in labels for x in leaves[label]))
    schema = pa.schema([("parent_id", pa.int64()), ("child", pa.string()), ("pos", pa.int32()), ("sub_pos", pa.int32()), *((x, pa.string()) for x in extra)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False)
            s = Shredder(nodes)
            for p in b.column(1).to_pylist():
                s.write(read_record(p))
            for label in labels:
                t = rebuild(s, label)
                n = len(t["record"])
                if not n:
                    continue
                cols = {"parent_id": pa.array(ids[t["record"]], pa.int64()), "child": pa.array([label] * n, pa.string()), "pos": pa.array(t["pos"], pa.int32()), "sub_pos": pa.array(t["sub_pos"], pa.int32())}
                if values:
                    cols |= {_column_name(x): pa.array(t[x], pa.string()) for x in _scalars(_find(nodes, label)[0])}
                yield pa.RecordBatch.from_arrays([cols[f.name] if f.name in cols else pa.nulls(n, f.type) for f in schema], schema=schema)

    ddl = ", ".join(f"`{f.name}` {'bigint' if f.type == pa.int64() else 'int' if f.type == pa.int32() else 'string'}" for f in schema)
    return df.select(F.col(id_col).cast("bigint").alias("parent_id"), F.col(payload_col).alias("payload")).where("payload is not null").mapInArrow(run, ddl)


#: The children of a bibliographic payload.
CHILDREN = ("author", "affiliation", "author_id", "journal_info", "full_text_url")


def payload_children(articles: DataFrame, preprints: DataFrame, labels: tuple[str, ...] = CHILDREN, *, values: bool = True) -> DataFrame:
    """The children of both tables' payloads, with origin; sub_pos is 0 but for affiliations (places within the author)."""
    parts = [
        child_tables(df, key, "payload", labels, values=values).withColumn("origin", F.lit(origin))
        for df, key, origin in ((articles, "article_id", "article"), (preprints, "preprint_id", "preprint"))
    ]
    return parts[0].unionByName(parts[1])
