"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from passageloom.operators.joins import spread_join
from passageloom.session import materialize


def _stars(pairs: DataFrame) -> DataFrame:
    """``u, v, m``: every pair with the least node of ``u`` and its partners."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return spread_join(pairs, least, ["u"], ["v"], ways=4)


def _large(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(links: DataFrame) -> DataFrame:
    stars = _stars(links)
    moved = stars.select(F.explode(F.array(F.struct(F.col("v").alias("u"), "m"), F.struct("u", "m"))).alias("s"))
    return moved.select(F.col("s.u").alias("u"), F.col("s.m").alias("v")).filter("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the least node) for every node of ``links`` (``u, v``).

    A round of small stars comes first: it leaves few links where nodes have many
    common partners. Every round hangs nodes on smaller ones and is written to the
    shared folder, so lineage stays short; the number of rounds grows with the
    logarithm of the longest path. A node with very many links is spread like any
    other key.
    """
    oriented = links.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    step, before, current = _small(oriented), None, None
    while True:
        seen = Observation()
        marks = (F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        current = materialize(step.observe(seen, *marks), "stars")
        if seen.get == before:
            break
        before = seen.get
        step = _small(_large(current))
    leaves = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return leaves.unionByName(roots)
