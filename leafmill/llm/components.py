"""Connected components of an edge table, by star contraction; nothing is collected to the driver.

Each task first joins what its own edges join. Then large and small stars take turns (every node is
moved to the least of its neighbours) until all edges are stars around the least node of a component.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.session import stored

#: Edges in a file, about.
FILE_EDGES = 500_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stars of each batch of edges."""
    for batch in batches:
        up: dict[str, str] = {}

        def root(x: str, up: dict[str, str] = up) -> str:
            top = x
            while (y := up.get(top, top)) != top:
                top = y
            while x != top:
                up[x], x = top, up.get(x, x)
            return top

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = sorted((root(a), root(b)))
            if a != b:
                up[b] = a
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array([root(x) for x in nodes], pa.string())], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """(a, b) for each node a that has an edge to others: b is the least node of its component; the least nodes themselves have no row.

    ``edges`` has string columns a and b; direction, repeats and loops don't matter; nulls are left out.
    """
    e = edges.select("a", "b").filter("a <> b").mapInArrow(_local, "a string, b string").filter("a <> b").distinct()
    e, before = stored(e, "stars"), None
    files = e.count() // FILE_EDGES + 1
    while True:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, so that the join may split the partition of a node with very many edges
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).coalesce(files), "least")
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        e = stored(small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.withColumnRenamed("m", "b")).filter("a <> b").distinct().coalesce(files), "stars")
        mark = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return e
        before = mark
