"""Distributed union-find: local forests, merged level by level on ever smaller graphs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.session import materialise

FOREST = "node string, root string"


class Forest:
    """Union-find over strings. The root of a tree is its first member by the draw of the level, or, without one, its smallest member."""

    def __init__(self, level: int | None = None) -> None:
        self.parent: dict[str, str] = {}
        self.level = level

    def rank(self, x: str) -> tuple[int, str]:
        return (0 if self.level is None else zlib.crc32(f"{self.level}|{x}".encode()), x)

    def find(self, x: str) -> str:
        parent = self.parent
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            low, high = (a, b) if self.rank(a) < self.rank(b) else (b, a)
            self.parent[high] = low
            self.parent.setdefault(low, low)

    def rows(self) -> pd.DataFrame:
        return pd.DataFrame([(x, self.find(x)) for x in self.parent], columns=["node", "root"], dtype=object)


def _local_forests(level: int | None, per_task: int):
    """Forests of the edges of a partition; one is handed on when it holds ``per_task`` nodes, and the next begun."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forest = Forest(level)
        for batch in batches:
            for a, b in zip(batch["node"], batch["root"]):
                forest.union(a, b)
                if len(forest.parent) >= per_task:
                    yield forest.rows()
                    forest = Forest(level)
        yield forest.rows()

    return run


def _draw(level: int, node: str) -> Column:
    return F.crc32(F.concat(F.lit(f"{level}|"), F.col(node)).cast("binary"))


def connected_components(edges: DataFrame, a: str, b: str, per_task: int = 1_000_000) -> DataFrame:
    """Columns ``node``, ``root``: every node of ``edges`` with the smallest node of its component.

    A level turns the edges of each task into forests of at most ``per_task`` nodes. A node of several forests goes to the
    root that comes first by the level's draw; the next level has these roots for nodes and, for edges, the edges between
    them, each once. So a level leaves a fraction of the nodes, whatever the shape of the graph, and the last one, whose
    edges fit one task, is a single forest. No task holds more than ``per_task`` nodes, and a hot node is spread over all
    tasks that meet it. Self-links and NULL ends link nothing.
    """
    links = edges.select(F.col(a).cast("string").alias("node"), F.col(b).cast("string").alias("root")).dropna()
    now = materialise(links.distinct(), "edges")
    nodes = now.select("node").union(now.select(F.col("root").alias("node"))).distinct()
    now = now.where("node <> root")
    steps: list[DataFrame] = []
    while (left := now.count()) > per_task:
        level = len(steps)
        forests = now.mapInPandas(_local_forests(level, per_task), FOREST)
        step = materialise(forests.groupBy("node").agg(F.min(F.struct(_draw(level, "root").alias("d"), "root")).alias("m")).select("node", F.col("m.root").alias("to")), "forest")
        steps.append(step)
        x, y = step.select(F.col("node").alias("nx"), F.col("to").alias("x")), step.select(F.col("node").alias("ny"), F.col("to").alias("y"))
        joined = now.join(x, F.col("node") == F.col("nx")).join(y, F.col("root") == F.col("ny"))
        now = materialise(joined.where("x <> y").select(F.least("x", "y").alias("node"), F.greatest("x", "y").alias("root")).distinct(), "edges")
    last = now.repartition(1).mapInPandas(_local_forests(None, 2 * per_task + 2), FOREST) if left else now.select("node", "root").limit(0)
    if not steps:
        return nodes.join(last, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    found = nodes.withColumn("at", F.col("node"))
    for step in steps:
        found = found.join(step.select(F.col("node").alias("f"), "to"), F.col("at") == F.col("f"), "left").select("node", F.coalesce("to", "at").alias("at"))
    found = materialise(found.join(last.select(F.col("node").alias("f"), "root"), F.col("at") == F.col("f"), "left").select("node", F.coalesce("root", "at").alias("at")), "components")
    first = found.groupBy(F.col("at").alias("f")).agg(F.min("node").alias("root"))
    return found.join(first, F.col("at") == F.col("f")).select("node", "root")
