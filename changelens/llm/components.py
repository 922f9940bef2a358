"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from changelens.llm.tables import cut, drop_tables, lookup


def _stars(edges: DataFrame, used: list[str]) -> DataFrame:
    """One round: each node's larger neighbours, then its smaller ones, are
    tied to the smallest node around it.

    The smallest ones are aggregated with partial results and looked up, so a
    node with most of the links is dealt to several tasks.
    """
    both = edges.select(F.col("u").alias("c"), "v").unionByName(edges.select(F.col("v").alias("c"), F.col("u").alias("v")))
    least = cut(both.groupBy("c").agg(F.min("v").alias("m")), "least", used)
    large = (
        lookup(both, least, ["c"], spread="v")
        .where(F.col("v") > F.col("c"))
        .select(F.col("v").alias("c"), F.least("m", "c").alias("v"))
        .distinct()
    )
    large = cut(large, "large", used)
    lower = cut(large.groupBy("c").agg(F.min("v").alias("m")), "lower", used)
    tied = lookup(large, lower, ["c"], spread="v")
    small = tied.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return small.unionByName(lower.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reached) for ``u, v`` links.

    Nodes are whole numbers; the component's smallest node has no row of its
    own, nor have nodes without a link.  Rounds grow with the logarithm of the
    longest path; each is written to the shared folder, and dropped after the
    next.
    """
    spark = links.sparkSession
    edges = links.where(F.col("u") != F.col("v")).select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    used: list[str] = []
    edges, last = cut(edges, "links", used), None
    while True:
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == last or state[0] == 0:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        old, used = used, []
        steps: list[str] = []
        edges, last = cut(_stars(edges, steps), "links", used), state
        drop_tables(spark, old + steps)
