"""Connected components by randomised contraction, in joins and aggregations only.

Each round orders the nodes by a hash that changes with the round, maps every node to the first in that order among
itself and its neighbours, and rewrites the edges by that mapping without loops and repeats. Mapping along edges keeps
components whole, and the number of nodes falls by a constant factor a round on average, whatever the graph's shape, so
rounds grow with the logarithm of the input. Every round's tables are written to the shared folder, which cuts lineage;
their rows are counted as they are written, and later rounds take as many tasks as their edges need, since the driver
remembers every task of many rounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quillmesh.llm.common import materialise


EDGES_PER_TASK, LEAST_TASKS = 20_000, 8


def _counted(df: DataFrame, label: str) -> tuple[DataFrame, int]:
    """df written, and its number of rows."""
    seen = Observation()
    return materialise(df.observe(seen, F.count(F.lit(1)).alias("n")), label), seen.get["n"]


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) as components gives of all links, where roots is its result for those before and links are further ones."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    ends = links.select("a", "b").join(of("a"), "a", "left").join(of("b"), "b", "left")
    above = components(ends.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = roots.join(above.select(F.col("node").alias("root"), F.col("root").alias("later")), "root", "left").select("node", F.coalesce("later", "root").alias("root"))
    return materialise(moved.unionAll(above.join(roots, "node", "left_anti").select("node", "root")), "roots")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for all nodes of edges (a, b); nodes have the same root exactly if they are connected."""
    current, left = _counted(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    mappings: list[DataFrame] = []
    while left:
        tasks = max(left // EDGES_PER_TASK, LEAST_TASKS)
        mixed = len(mappings)
        order = lambda c, salt=mixed: F.struct(F.xxhash64(F.col(c), F.lit(salt)).alias("h"), F.col(c).alias("n"))
        both = current.select("a", "b").unionAll(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("least"))
        mapping = materialise(first.select(F.col("a").alias("node"), F.least("least", order("a"))["n"].alias("rep")).coalesce(tasks), "mapping")
        mappings.append(mapping)
        of_a = mapping.select(F.col("node").alias("a"), F.col("rep").alias("ra"))
        of_b = mapping.select(F.col("node").alias("b"), F.col("rep").alias("rb"))
        moved = current.join(of_a, "a").join(of_b, "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
        current, left = _counted(moved.where("a <> b").distinct().coalesce(tasks), "edges")
    if not mappings:
        return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = mappings[-1].select("node", F.col("rep").alias("root"))
    for mapping in reversed(mappings[:-1]):
        later = roots.select(F.col("node").alias("rep"), F.col("root").alias("later"))
        roots = mapping.join(later, "rep", "left").select("node", F.coalesce("later", "rep").alias("root"))
    return materialise(roots, "roots") if len(mappings) > 1 else roots  # once: callers use it several times
