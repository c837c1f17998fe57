"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.llm.common import cut, narrow_cut


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, src: str = "src", dst: str = "dst", rows: int | None = None) -> DataFrame:
    """(node, component) for every node of the edges; component is the smallest node reachable.

    Alternates the large-star and small-star steps of Kiveris and others (2014): each node hands its
    neighbours the smallest node it knows, until every component is a star about its smallest node. Each
    step is one grouped minimum and one join on the same key, so a node with very many neighbours is
    combined before the shuffle and split by skew-join handling; nothing is gathered in one place. Every
    round is written to the checkpoint folder; no round has more links than the one before.

    Null ends and loops are ignored, repeated edges count once, no edges give an empty result. rows: about how
    many edges there are, if that is known.
    """
    links = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null and a <> b")
    # a is the larger end from here on
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = cut(links) if rows is None else narrow_cut(links, rows)
    before = _fingerprint(links)
    while before[0]:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pairs = large.join(low, "a")
        small = low.select("a", F.col("m").alias("b")).unionByName(pairs.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        links = narrow_cut(small.distinct(), before[0])
        after = _fingerprint(links)
        if after == before:
            break
        before = after
    stars = links.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
