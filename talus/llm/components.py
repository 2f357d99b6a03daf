"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talus.session import cut


def fewer(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """``df`` in no more partitions than ``rows`` rows need: small rounds don't deal out empty files."""
    return df.coalesce(max(1, -(-rows // each)))


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return r.n, r.s


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every vertex of ``edges`` (u, v): the smallest vertex it can reach.

    Each round takes minima by aggregation and joins them back, so a hub is never gathered in one
    group; rounds grow with the logarithm of the longest path. Lineage is cut after each round.
    """
    edges = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(edges)
    while before[0]:
        edges = fewer(edges, before[0])
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = fewer(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), before[0])
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = fewer(fewer(large, before[0]).distinct(), before[0])
        low = fewer(large.groupBy("u").agg(F.min("v").alias("m")), before[0])
        small = fewer(large.join(low, "u"), before[0])
        small = (
            small
            .select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v")
            .where("u <> v")
        )
        edges = cut(fewer(small.distinct(), before[0]))
        after = _state(edges)
        if after == before:
            break
        before = after
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def merged(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components of ``labels`` (id, component) and further ``links`` (u, v).

    Only the links between components are contracted, so each call works on what is new.
    """
    if labels is None:
        return cut(connected_components(links))
    of_u = labels.select(F.col("id").alias("u"), F.col("component").alias("cu"))
    of_v = labels.select(F.col("id").alias("v"), F.col("component").alias("cv"))
    links = links.join(of_u, "u", "left").join(of_v, "v", "left")
    links = cut(links.select("u", "v", F.coalesce("cu", "u").alias("cu"), F.coalesce("cv", "v").alias("cv")))
    links = fewer(links, links.count())
    joined = cut(connected_components(links.select(F.col("cu").alias("u"), F.col("cv").alias("v"))))
    # a component is never above its members, so the smaller is what a vertex had; hubs combine before the shuffle
    named = links.select(F.explode(F.array("u", "v")).alias("id")).select("id", F.col("id").alias("component"))
    every = labels.union(named).groupBy("id").agg(F.min("component").alias("component"))
    renamed = joined.select(F.col("id").alias("component"), F.col("component").alias("now"))
    return cut(every.join(renamed, "component", "left").select("id", F.coalesce("now", "component").alias("component")))
