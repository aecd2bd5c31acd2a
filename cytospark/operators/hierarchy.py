"""Gate hierarchies (forests of ids) and link counts: in memory for the gates of a file, as tables for those of many."""

from __future__ import annotations

from collections import Counter, deque
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import GateError
from ..session import written


class Hierarchy:
    def __init__(self, edges=()):
        self.up: dict[str, str] = {}
        self.down: dict[str, list[str]] = {}
        for parent, child in edges:
            self.add(parent, child)

    def add(self, parent: str, child: str) -> None:
        """Put child under parent, moving it if it has another; refused if that closes a cycle."""
        if parent == child or parent in self.descendants(child):
            raise GateError(f"{child!r} under {parent!r} would be a cycle")
        if child in self.up:
            self.down[self.up[child]].remove(child)
        self.up[child] = parent
        self.down.setdefault(parent, []).append(child)

    reparent = add

    def parent(self, g: str) -> str | None:
        return self.up.get(g)

    def children(self, g: str) -> list[str]:
        return list(self.down.get(g, ()))

    def ancestors(self, g: str) -> list[str]:
        """Nearest first."""
        out = []
        while g in self.up:
            out.append(g := self.up[g])
        return out

    def descendants(self, g: str) -> list[str]:
        out, todo = [], deque(self.down.get(g, ()))
        while todo:
            out.append(x := todo.popleft())
            todo.extend(self.down.get(x, ()))
        return out

    def chain(self, g: str) -> list[str]:
        """Root first, g last."""
        return [*reversed(self.ancestors(g)), g]

    def depth(self, g: str) -> int:
        return len(self.ancestors(g))

    def nodes(self) -> list[str]:
        return sorted({*self.up, *(p for p, c in self.down.items() if c)})

    def roots(self) -> list[str]:
        return [n for n in self.nodes() if n not in self.up]

    def leaves(self) -> list[str]:
        return [n for n in self.nodes() if not self.down.get(n)]

    def depth_first(self) -> list[str]:
        out, todo = [], self.roots()[::-1]
        while todo:
            out.append(x := todo.pop())
            todo.extend(reversed(self.down.get(x, ())))
        return out

    def topological(self) -> list[str]:
        out, todo = [], deque(self.roots())
        while todo:
            out.append(x := todo.popleft())
            todo.extend(self.down.get(x, ()))
        return out

    def remove_child(self, parent: str, child: str) -> None:
        if self.up.get(child) == parent:
            del self.up[child]
            self.down[parent].remove(child)

    def remove(self, g: str) -> None:
        """Remove a node; its children become roots."""
        for c in self.down.pop(g, []):
            del self.up[c]
        if g in self.up:
            self.down[self.up.pop(g)].remove(g)

    def remove_keep_children(self, g: str) -> None:
        """Remove a node; its children take its place under its parent."""
        parent, below = self.up.get(g), self.children(g)
        self.remove(g)
        if parent is not None:
            for c in below:
                self.add(parent, c)

    def remove_subtree(self, g: str) -> list[str]:
        gone = [g, *self.descendants(g)]
        for x in reversed(gone):
            self.remove(x)
        return gone

    def clone_subtree(self, g: str, rename) -> list[tuple[str, str]]:
        """Copy g and all below it under new names; returns the new edges."""
        new = [(rename(p), rename(c)) for p in (g, *self.descendants(g)) for c in self.children(p)]
        for p, c in new:
            self.add(p, c)
        return new

    def restricted(self, keep) -> Hierarchy:
        """Edges whose ends are both kept."""
        return Hierarchy((p, c) for c, p in sorted(self.up.items()) if p in keep and c in keep)

    def edges(self) -> list[tuple[str, str]]:
        return sorted((p, c) for c, p in self.up.items())

    def validate(self) -> None:
        """An error if there is a cycle, or if parents and children contradict one another."""
        if len(self.topological()) != len(self.nodes()):
            raise GateError("the hierarchy has a cycle")
        for p, below in self.down.items():
            if bad := [c for c in below if self.up.get(c) != p]:
                raise GateError(f"{bad[0]!r} is a child of {p!r}, but its parent is {self.up.get(bad[0])!r}")
        if bad := [c for c, p in self.up.items() if c not in self.down.get(p, ())]:
            raise GateError(f"{bad[0]!r} is no child of its parent")


def ancestor_table(edges: DataFrame) -> DataFrame:
    """(gate, ancestor, depth) of a forest kept as a table of (parent, child): one equi-join a level, as deep as the forest.

    A cycle is an error: no chain is longer than there are edges.
    """
    edges = written(edges.select("parent", "child"), "edges")
    level = edges.select(F.col("child").alias("gate"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    out, most = [level], edges.count()
    while len(out) <= most:
        k = len(out) + 1
        level = written(level.join(edges, F.col("ancestor") == F.col("child")).select("gate", F.col("parent").alias("ancestor"), F.lit(k).alias("depth")), f"level-{k}")
        if level.isEmpty():
            return reduce(DataFrame.unionAll, out)
        out.append(level)
    if most:
        raise GateError("the hierarchy has a cycle")
    return level


def restricted_table(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """The edges whose two ends are both in keep (gate): two semi-joins."""
    ends = lambda c: keep.select(F.col("gate").alias(c))
    return edges.join(ends("child"), "child", "left_semi").join(ends("parent"), "parent", "left_semi").select("parent", "child")


def link_table(links: DataFrame) -> DataFrame:
    """(target, links): how many links each gate has; a repeated link counts again. links: target, source."""
    return links.groupBy("target").agg(F.count(F.lit(1)).alias("links"))


class Links:
    """Which gates link to a gate; a repeated link counts again."""

    def __init__(self):
        self.of: dict[str, list[str]] = {}

    def add(self, target: str, source: str) -> None:
        self.of.setdefault(target, []).append(source)

    def remove(self, target: str, source: str) -> None:
        if source in self.of.get(target, ()):
            self.of[target].remove(source)

    def get(self, target: str) -> list[str]:
        return list(self.of.get(target, ()))

    def count(self, target: str) -> int:
        return len(self.of.get(target, ()))

    def is_linked(self, target: str) -> bool:
        return bool(self.of.get(target))

    def counts(self) -> Counter:
        return Counter({t: len(s) for t, s in self.of.items() if s})

    def clear(self) -> None:
        self.of.clear()
