"""Connected components of graphs with giant components and hub nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.operators.joins import hot_join, is_few
from verdigris.session import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b), bigint; root is the smallest node of the component.

    Each round: hook every root to the smallest root that an edge leads to, shortcut the hooks until all point at
    roots, then move the edges to the roots and drop loops and repetitions. Every root with a smaller neighbour goes, so
    the edges shrink geometrically; the rounds end when no edge is left. Each round's tables are written to the shared
    folder. A root that owns most nodes, or a node with most edges, is a hot key: the hooks are broadcast if few, else
    salted. Self-loops make isolated nodes; nulls are ignored; an empty table gives an empty table.
    """
    edges = edges.filter("a is not null and b is not null")
    parent = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).groupBy("node").agg(F.first("node").alias("root")), "nodes")
    live = stored(edges.filter("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct(), "edges")
    while not live.isEmpty():
        hooks = stored(live.groupBy("hi").agg(F.min("lo").alias("up")), "hooks")
        few = is_few(hooks)
        while True:  # shortcutting: a hook may lead to a root that itself was hooked
            up = hooks.select(F.col("hi").alias("up"), F.col("up").alias("upper"))
            nxt = stored(hot_join(hooks, up, "up", F.col("hi"), "left", few).select("hi", F.coalesce("upper", "up").alias("up"), F.col("upper").isNotNull().alias("moved")), "hooks")
            done = nxt.filter("moved").isEmpty()
            hooks = nxt.drop("moved")
            if done:
                break
        parent = stored(hot_join(parent.withColumnRenamed("root", "hi"), hooks, "hi", F.col("node"), "left", few).select("node", F.coalesce("up", "hi").alias("root")), "nodes")
        a = hooks.select(F.col("hi").alias("lo"), F.col("up").alias("lo2"))
        b = hooks.select("hi", F.col("up").alias("hi2"))
        moved = hot_join(hot_join(live, a, "lo", F.col("hi"), "left", few), b, "hi", F.col("lo"), "left", few).select(F.coalesce("lo2", "lo").alias("x"), F.coalesce("hi2", "hi").alias("y"))
        live = stored(moved.filter("x <> y").select(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).distinct(), "edges")
    return parent
