"""Connected components of a table of links, by alternating star steps (Kiveris and others, 2014).

A large-star step links each node's larger neighbours to the smallest node it knows, a small-star step the smaller ones;
links only ever get shorter, and at the end each node is linked to the smallest node of its component. Links stay in
written tables; a node with many links is pre-aggregated to its smallest neighbour, and its rows may be split by the
adaptive join.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import saved

#: Steps needed grow with the logarithm of the longest path; beyond this something is wrong.
MOST_STEPS = 60
#: So few links of numbers or strings are united by one task, with the same result, instead of by a dozen jobs with all their tasks.
FEW_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """``links``: two columns of one orderable type. Gives ``node``, ``component`` (its smallest node) for all linked nodes.

    Self-links, repeated links and links with a null are ignored; no links give no rows.
    """
    a, b = links.columns
    edges = saved(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = _mark(edges)
    if mark[0] <= FEW_LINKS and isinstance(edges.schema["u"].dataType, (T.IntegralType, T.StringType)):
        return saved(_united(edges), "united")
    for _ in range(MOST_STEPS):
        if not mark[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join may split the rows of a node that has very many links
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e"))
        edges = saved(small.select("e.u", "e.v").filter("u != v").distinct(), "links")
        before, mark = mark, _mark(edges)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _united(edges: DataFrame) -> DataFrame:
    """The same by one task: roots are the smallest nodes."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(x: object) -> object:
            while (up := above.setdefault(x, x)) != x:
                above[x] = x = above[up]
            return x

        kinds = pa.null()
        for batch in batches:
            kinds = batch.schema[0].type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(u), root(v)
                above[max(a, b)] = min(a, b)
        if above:
            nodes = list(above)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, kinds), pa.array([root(x) for x in nodes], kinds)], ["node", "component"])

    return edges.repartition(1).mapInArrow(run, f"node {kind}, component {kind}")


def _mark(edges: DataFrame) -> tuple:
    """Number of links and a sum over them; equal before and after a step only if the step changed nothing."""
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]
