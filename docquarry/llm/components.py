"""Connected components of a table of links, by alternating large and small stars.

Every step is a group-by and a join on one end of the links, with the smaller end as the new hub, so a
hub of any degree is spread over the tasks that hold its links. Each round is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.common import checkpoint


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` (the smallest node that can be reached) for each node with a link to another.

    Links with a null end and links of a node to itself say nothing; repeated links count once; no links
    give no rows.
    """
    pairs = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    pairs = checkpoint(pairs.distinct())
    state = _state(pairs)
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hub = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        # Large star: all larger neighbours of a node move to its smallest neighbour.
        large = both.where("v > u").join(hub, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: the smaller neighbours of a node, and it, move to the smallest of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = checkpoint(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(pairs)
        if before == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _state(pairs: DataFrame) -> tuple:
    """Tells one set of links from another; one row, whatever their number."""
    h = F.xxhash64("u", "v")
    return tuple(pairs.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 16))).first())
