"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliploom.llm.common import checkpoint


def connected_components(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """edges (a long, b long) -> (node long, root long): root is the smallest node reachable.

    With `rounds` it stops after so many: nodes of one root are connected, but a component may still
    have several roots.

    Nodes without a link to another node are left out. Each round is two grouped minima (combined
    before the shuffle) joined back to the links; a hub's links are spread by the skew join. Nulls
    and self links are ignored; repeated links count once. Lineage is cut by a reliable checkpoint
    after each round, so a lost executor costs at most one round.
    """
    links = checkpoint(
        edges.filter("a is not null and b is not null and a <> b")
        .select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u"))
        .distinct()
    )
    seen, done = None, 0
    while rounds is None or done < rounds:
        done += 1
        # large star: every larger neighbour of u hangs itself on u's smallest neighbour
        both = links.union(links.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        links = (
            both.filter("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).distinct()
        )
        # small star: u and its smaller neighbours hang on the smallest of them
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        hung = links.join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).filter("u <> v")
        links = checkpoint(hung.union(least.select(F.col("m").alias("v"), "u")).distinct())
        now = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    if rounds is not None:
        links = links.groupBy("u").agg(F.min("v").alias("v"))
    own = links.join(links.select(F.col("u").alias("v")), "v", "left_anti") if rounds is not None else links
    own = own.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(own)
