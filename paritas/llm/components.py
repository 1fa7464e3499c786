"""Connected components of a distributed list of links, by random contraction.

In each round every node picks the node of lowest priority within two links, itself included; the
priority is a hash that changes with the round, and two links let a hub's neighbours meet at once. Links are then redrawn between the picks and loops dropped. A constant share of the nodes
vanishes per round in expectation, so the rounds grow with the logarithm of the longest path, whatever
the order of ids. Hubs are pre-aggregated before they are shuffled. Nothing but a count reaches the
driver. Every round is written: a checkpoint would keep the estimate of its plan, in which joins multiply, so
that the sizes by which later rounds are planned would have five times the digits after each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paritas.llm.shared import by_value, checkpoint, written

FINISH = 20_000


def _unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of at most FINISH links."""
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = find(x), find(y)
            parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node that occurs in a link; loops count as nodes of their own."""
    edges = written(links.select(F.col(a).alias("a"), F.col(b).alias("b")), "edges")
    rounds: list[DataFrame] = []
    while edges.count() > FINISH:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        seed = F.lit(len(rounds))
        low = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("b"))).alias("m"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("b"))
        low = written(low.select("a", F.least(F.col("m"), own).alias("m")), "low")
        # the same once more over neighbours' picks; a node's own pick is among its neighbour's candidates
        far = both.join(low.withColumnRenamed("a", "b"), "b").groupBy("a").agg(F.min("m").alias("m"))
        picks = written(far.select("a", F.col("m")["b"].alias("t")), "picks")
        rounds.append(picks)
        ta, tb = picks.select("a", F.col("t").alias("ta")), picks.select(F.col("a").alias("b"), F.col("t").alias("tb"))
        moved = edges.join(ta, "a").join(tb, "b").filter("ta <> tb")
        edges = written(moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")
    kind = dict(edges.dtypes)["a"]
    roots = edges.coalesce(1).mapInArrow(_unite, f"node {kind}, root {kind}")
    for picks in rounds[::-1]:
        up = roots.withColumnRenamed("node", "t")
        roots = picks.join(up, "t", "left").select(F.col("a").alias("node"), F.coalesce("root", "t").alias("root"))
    return checkpoint(roots)


by_value(__name__)
