"""The tree (or graph) of tables of a job: order, levels and cycles. Small, and kept on the driver."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kinfold.config import Job, Relation


class GraphError(ValueError):
    pass


class CycleError(GraphError):
    """participants lie on a cycle, blocked only behind one; path is one cycle from a table back to itself."""

    def __init__(self, path: list[str], participants: list[str], blocked: list[str]):
        self.path, self.participants, self.blocked = path, participants, blocked
        said = f"tables form a cycle: {' -> '.join(path)}; on a cycle: {', '.join(participants)}"
        super().__init__(said + (f"; blocked behind one: {', '.join(blocked)}" if blocked else ""))


@dataclass(frozen=True)
class Edge:
    parent: str
    child: str
    foreign_key: str
    dependency: str = "1-N"


@dataclass
class Graph:
    root: str
    keys: dict[str, str | None] = field(default_factory=dict)  # primary key of each table, in the order of declaration
    edges: list[Edge] = field(default_factory=list)

    def add_table(self, name: str, key: str | None) -> None:
        if not name:
            raise GraphError("a table needs a name")
        if name in self.keys:
            raise GraphError(f"table {name!r} appears twice")
        self.keys[name] = key

    def add_edge(self, parent: str, child: str, foreign_key: str, dependency: str = "1-N") -> None:
        if not foreign_key:
            raise GraphError(f"table {child!r} needs a foreign key")
        if dependency not in ("1-1", "1-N"):
            raise GraphError(f"table {child!r}: dependency must be '1-1' or '1-N', not {dependency!r}")
        for t in (parent, child):
            if t not in self.keys:
                raise GraphError(f"unknown table {t!r}")
        self.edges.append(Edge(parent, child, foreign_key, dependency))

    def children(self, table: str) -> list[str]:
        return list(dict.fromkeys(e.child for e in self.edges if e.parent == table))

    def parents(self, table: str) -> list[str]:
        return list(dict.fromkeys(e.parent for e in self.edges if e.child == table))

    def edges_to(self, table: str) -> list[Edge]:
        return [e for e in self.edges if e.child == table]

    def in_degrees(self) -> dict[str, int]:
        return {t: len(self.parents(t)) for t in self.keys}

    def copy_order(self) -> list[str]:
        """Parents before children (Kahn's algorithm); ties in the order of declaration."""
        degree = self.in_degrees()
        ready, out = deque(t for t in self.keys if not degree[t]), []
        while ready:
            out.append(t := ready.popleft())
            for c in self.children(t):
                degree[c] -= 1
                if not degree[c]:
                    ready.append(c)
        if len(out) < len(self.keys):
            left = [t for t in self.keys if t not in out]
            on = [t for t in left if self._reaches(t, t)]
            raise CycleError(self._cycle(on[0]), on, [t for t in left if t not in on])
        return out

    def delete_order(self) -> list[str]:
        return self.copy_order()[::-1]

    def has_cycle(self) -> bool:
        try:
            self.copy_order()
        except CycleError:
            return True
        return False

    def _reaches(self, a: str, b: str) -> bool:
        todo, seen = list(self.children(a)), set()
        while todo:
            if (t := todo.pop()) == b:
                return True
            if t not in seen:
                seen.add(t)
                todo += self.children(t)
        return False

    def _cycle(self, start: str) -> list[str]:
        came, todo = {}, deque([start])
        while todo:
            t = todo.popleft()
            for c in self.children(t):
                if c == start:
                    path = [t]
                    while path[-1] != start:
                        path.append(came[path[-1]])
                    return [*path[::-1], start]
                if c not in came:
                    came[c] = t
                    todo.append(c)
        raise GraphError(f"no cycle through {start!r}")

    def levels(self) -> dict[str, int]:
        """The root is 0; a child is one below its deepest parent."""
        out: dict[str, int] = {}
        for t in self.copy_order():
            out[t] = max((out[p] + 1 for p in self.parents(t)), default=0)
        return out

    def validate(self) -> None:
        if self.root not in self.keys:
            raise GraphError(f"root {self.root!r} is not a table")
        self.copy_order()

    def edge_rows(self, spark: SparkSession) -> DataFrame:
        """edges(parent, child, fk, ref, dep)."""
        rows = [(e.parent, e.child, e.foreign_key, self.keys[e.parent], e.dependency) for e in self.edges]
        return spark.createDataFrame(rows, "parent string, child string, fk string, ref string, dep string")

    def tree(self, table: str | None = None, depth: int = 0) -> str:
        """The tables as an indented tree."""
        table = table or self.root
        own = [e for e in self.edges if e.child == table]
        label = table if not own else f"{table} ({', '.join(f'{e.foreign_key} -> {e.parent}, {e.dependency}' for e in own)})"
        return "\n".join(["  " * depth + label, *(self.tree(c, depth + 1) for c in self.children(table))])


def build(job: Job) -> Graph:
    """The tree that a job declares."""
    if not job.root_table or not job.primary_key:
        raise GraphError("a job needs a root table and its primary key")
    g = Graph(job.root_table)
    g.add_table(job.root_table, job.primary_key)

    def add(parent: str, rel: Relation) -> None:
        if rel.primary_key == "" or (rel.primary_key is None and rel.relations):
            raise GraphError(f"table {rel.table!r} needs a primary key")
        g.add_table(rel.table, rel.primary_key)
        g.add_edge(parent, rel.table, rel.foreign_key, rel.dependency_type or "1-N")
        for x in rel.relations:
            add(rel.table, x)

    for rel in job.relations:
        add(job.root_table, rel)
    g.validate()
    return g
