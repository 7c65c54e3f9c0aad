"""Connected components by alternating large and small stars, which contract any graph to stars in few rounds."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, joined, saved


def _stars(edges: DataFrame, upwards: bool) -> DataFrame:
    """One star step over (a, b): each node's neighbours are linked to the least of them and itself.

    upwards: of each node's neighbours, the larger ones are linked; else the smaller ones and itself.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if upwards:
        both = both.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        both = both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    known = joined(both, least, ["u"])
    if upwards:
        out = known.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = known.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of the edges (a, b), two columns of longs; label: the least node of its component.

    Loops and repeated edges are harmless; no edges give no rows. Each round is written to the shared folder.
    """
    now = saved(edges.filter("a <> b").select("a", "b").distinct(), "edges")
    while True:
        large = saved(_stars(now, True), "edges")
        then = saved(_stars(large, False), "edges")
        # Both have distinct rows, so that equal numbers and no new row mean equal sets.
        done = then.count() == now.count() and then.join(now, ["a", "b"], "left_anti").isEmpty()
        dropped(edges.sparkSession, now, large)
        now = then
        if done:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("label")).union(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
