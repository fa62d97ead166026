"""Backbones of weighted undirected graphs; edges are (a, b, w) with a < b."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cubespark.sources.store import cut_lineage


def edges_of(matrix: DataFrame, value: str = "proximity") -> DataFrame:
    """The non-zero upper triangle of a symmetric long matrix (a, b, value)."""
    return matrix.where((F.col("a") < F.col("b")) & (F.col(value) != 0)).select("a", "b", F.col(value).alias("w"))


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def disparity_backbone(edges: DataFrame, alpha: float = 0.16) -> DataFrame:
    """Edges that are significant at one end or the other: (1 - w / strength) ** (degree - 1) < alpha (Serrano et al. 2009).
    An end of degree 1 never passes."""
    ends = both_ways(edges).groupBy("a").agg(F.sum("w").alias("s"), F.count("*").alias("k"))
    x, y = ends.select("a", F.col("s").alias("sa"), F.col("k").alias("ka")), ends.select(F.col("a").alias("b"), F.col("s").alias("sb"), F.col("k").alias("kb"))
    rows = edges.join(x, "a").join(y, "b")

    def passes(s: str, k: str):
        return (F.col(k) > 1) & (F.pow(1 - F.col("w") / F.col(s), F.col(k) - 1) < alpha)

    return rows.where(passes("sa", "ka") | passes("sb", "kb")).select("a", "b", "w")


#: Edges that one task takes whole: some megabytes.
SMALL = 1 << 16


def _kruskal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The forest of all edges of a task: best first, unless an edge's ends are joined already."""
    edges = pd.concat(batches, ignore_index=True).sort_values(["w", "a", "b"], ascending=[False, True, True], kind="stable")
    parent: dict = {}

    def root(v: object) -> object:
        while (up := parent.setdefault(v, v)) != v:
            parent[v] = parent[up]
            v = up
        return v

    kept = []
    for a, b in zip(edges["a"], edges["b"], strict=True):
        x, y = root(a), root(b)
        kept.append(x != y)
        parent[x] = y
    yield edges[kept]


def maximum_spanning_forest(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """The forest of the best edges, in the total order (w down, a, b). A graph of at most ``small`` edges is one task. A larger one
    takes Boruvka's rounds: each component takes its best edge to another, until none has one.

    The number of components at least halves in a round. Within a round every component points to the other end of its best
    edge; following pointers twice as far each time finds the component that they meet in.
    """
    order = F.struct((-F.col("w")).alias("w"), F.col("a").alias("a"), F.col("b").alias("b"))
    graph = cut_lineage(edges.select("a", "b", "w"))
    if 0 < graph.count() <= small:
        return graph.repartition(1).mapInPandas(_kruskal, graph.schema)
    label = cut_lineage(graph.select("a").union(graph.select("b")).distinct().select(F.col("a").alias("v"), F.col("a").alias("c")))
    chosen = None
    while True:
        ends = graph.join(label.select(F.col("v").alias("a"), F.col("c").alias("ca")), "a")
        ends = ends.join(label.select(F.col("v").alias("b"), F.col("c").alias("cb")), "b").where("ca <> cb")
        out = ends.select(F.col("ca").alias("c"), F.col("cb").alias("to"), order.alias("o"))
        best = out.unionByName(ends.select(F.col("cb").alias("c"), F.col("ca").alias("to"), order.alias("o")))
        best = cut_lineage(best.groupBy("c").agg(F.min(F.struct("o", "to")).alias("m")).select("c", "m.o", "m.to"))
        if best.isEmpty():
            return chosen if chosen is not None else graph
        picked = best.select("o.a", "o.b", (-F.col("o.w")).alias("w")).distinct()
        chosen = cut_lineage(picked if chosen is None else chosen.unionByName(picked))
        # Two components that chose the same edge point at each other; the smaller of them becomes the root.
        back = best.select(F.col("c").alias("to"), F.col("to").alias("back"))
        point = best.join(back, "to", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("p"))
        point = cut_lineage(point)
        while True:
            further = point.alias("x").join(point.alias("y"), F.col("x.p") == F.col("y.c"), "left")
            further = cut_lineage(further.select("x.c", F.coalesce("y.p", "x.p").alias("p"), (F.coalesce("y.p", "x.p") != F.col("x.p")).alias("moved")))
            moved = not further.where("moved").isEmpty()
            point = further.drop("moved")
            if not moved:
                break
        label = cut_lineage(label.join(point, "c", "left").select("v", F.coalesce("p", "c").alias("c")))


def union_max(*graphs: DataFrame) -> DataFrame:
    """The larger weight of every edge of any graph."""
    out = graphs[0]
    for g in graphs[1:]:
        out = out.unionByName(g)
    return out.groupBy("a", "b").agg(F.max("w").alias("w"))
