"""Connected components and dependency levels of a graph of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fovea.functions.lineage import saved

MAX_ROUNDS = 60
#: Links between cells that are joined on the driver, at most.
FEW_LINKS = 20_000


def star(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """Join each node of ``pairs`` (u, v) with the least of its neighbours in ``at``."""
    least = at.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node, by alternating large and small stars; root is the least node reached."""
    a, b = links.columns
    pairs = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    pairs, mark = saved(pairs, "links"), None
    for _ in range(MAX_ROUNDS):
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, both).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = saved(large, "large-star")
        small = star(large, large)
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        pairs = saved(small.where("u != v").distinct(), "small-star")
        now = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if now == mark:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = now
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")


def few_components(links: list[tuple]) -> list[tuple]:
    """(node, root) of a bounded list of links."""
    root: dict = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [(x, find(x)) for x in list(root)]


def with_component(cells: DataFrame, links: DataFrame) -> DataFrame:
    """``cells`` (column cell) with the component of each; a cell without links is its own.

    Up to ``FEW_LINKS`` links are joined at once, more by rounds of jobs; the
    result is the same.
    """
    links = saved(links, "cell-links")
    few = links.limit(FEW_LINKS + 1).collect()
    if len(few) <= FEW_LINKS:
        kind = links.dtypes[0][1]
        roots = links.sparkSession.createDataFrame(few_components([tuple(x) for x in few]), f"node {kind}, root {kind}")
    else:
        roots = connected_components(links)
    return cells.join(roots, F.col("cell") == F.col("node"), "left").withColumn("component", F.coalesce("root", "cell")).drop("node", "root")


def few_levels(links: list[tuple]) -> list[tuple]:
    """(node, level) of a bounded list of links from lesser to greater nodes."""
    level: dict = {}
    for a, b in sorted(links, key=lambda x: (x[1], x[0])):
        level[b] = max(level.get(b, 0), level.setdefault(a, 0) + 1)
    return list(level.items())


def dependency_levels(cells: DataFrame, links: DataFrame) -> DataFrame:
    """(cell, level): zero without a link (i, j) from a lesser cell i, else one more than the greatest level of these.

    Up to ``FEW_LINKS`` links are walked at once, more by rounds that take off
    the cells whose predecessors are gone, a job a level; the result is the
    same.
    """
    links, cells = saved(links.where("i < j").select("i", "j"), "level-links"), cells.select("cell").distinct()
    few = links.limit(FEW_LINKS + 1).collect()
    if len(few) <= FEW_LINKS:
        kind = links.dtypes[0][1]
        found = links.sparkSession.createDataFrame(few_levels([tuple(x) for x in few]), f"node {kind}, level int")
        return cells.join(found, F.col("cell") == F.col("node"), "left").select("cell", F.coalesce("level", F.lit(0)).alias("level"))
    left, out, level = saved(cells, "level-cells"), None, 0
    while True:
        blocked = saved(links.select(F.col("j").alias("cell")).distinct(), "level-blocked")
        free = saved(left.join(blocked, "cell", "left_anti").withColumn("level", F.lit(level)), "level")
        out = free if out is None else out.unionByName(free)
        left = saved(left.join(blocked, "cell", "left_semi"), "level-cells")
        if left.isEmpty():
            return out
        links = saved(links.join(free.select(F.col("cell").alias("i")), "i", "left_anti"), "level-links")
        level += 1
