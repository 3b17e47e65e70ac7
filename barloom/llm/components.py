"""Connected components of a table of links: portions of them are thinned to stars, which large-star and small-star steps
make a forest, and doubling flattens that."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, stars

#: Links of a portion, which a task thins at once.
PORTION = 1 << 18


def _thinned(portion: int):
    """The links (a, b) of each portion as stars: each node with the smallest that it reaches there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def thin() -> pa.RecordBatch:
            found = pa.Table.from_batches(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in stars(found["a"].to_numpy(), found["b"].to_numpy())], names=["a", "b"])

        for batch in batches:
            if held and sum(b.num_rows for b in held) + batch.num_rows > portion:
                yield thin()
            held.append(batch)
        if held:
            yield thin()

    return run


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _most_above(edges: DataFrame) -> int:
    """The most smaller neighbours that a node has; 0 without links."""
    return edges.groupBy("a").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0


def _flat(edges: DataFrame) -> DataFrame:
    """Links of each node with the smallest that it reaches."""
    while _most_above(edges) > 1:
        edges = checkpointed(_small_star(_large_star(edges)))
    moved = True
    while moved:
        parent = edges.select(F.col("a").alias("b"), F.col("b").alias("above"))
        edges = checkpointed(edges.select("a", "b").join(parent, "b", "left").select("a", F.coalesce("above", "b").alias("b"), "above"))
        moved = not edges.where("above is not null").isEmpty()
    return edges.select("a", "b")


def connected_components(links: DataFrame, left: str = "a", right: str = "b", portion: int = PORTION) -> DataFrame:
    """(node, component) for every node that has a link; component is the smallest node it reaches.

    Links are pairs of longs; order, repeats and loops don't matter, and a pair with a null is no link. Portions of the
    links are thinned each by a task; if there is only one, its stars are the components, which saves a small table all
    rounds. Otherwise each round of stars points every node at the smallest neighbour. Once no node has more than one
    smaller neighbour, the links are a forest with the smallest node of each tree at its root, and one join a round
    halves its depth. The number of rounds grows with the logarithm of a component's size. A round's edges go through a
    checkpoint, which cuts the lineage and survives lost executors.
    """
    edges = checkpointed(
        links.select(F.greatest(left, right).alias("a"), F.least(left, right).alias("b"))
        .where(F.col(left).isNotNull() & F.col(right).isNotNull() & (F.col(left) != F.col(right)))
        .distinct()
    )
    portions = -(-edges.count() // portion)
    edges = checkpointed(edges.coalesce(max(1, portions)).mapInArrow(_thinned(portion), "a long, b long"))
    if portions > 1:
        edges = _flat(edges)
    roots = edges.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
