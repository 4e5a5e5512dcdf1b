"""Connected components of an edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import cut_lineage, drop_path, scratch_path


def _write(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path), path


def _print(edges: DataFrame) -> tuple:
    """Count and digest of a set of edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")),
                           F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b); a component's name is its smallest id.

    Each step maps every node to the smallest id in its neighbourhood; the star edges that
    come out are few (one a node at the end).  The loop ends when a step changes nothing,
    after a number of steps that grows with the logarithm of the longest path.
    """
    stars, path = _write(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                         .distinct(), "edges")
    seen = _print(stars)
    while seen[0]:
        # large star: neighbours above a node go to its smallest neighbour (or itself)
        both = stars.unionAll(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where(F.col("b") > F.col("a"))
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(low, "a")
                 .select(F.explode(F.array(F.struct("a", F.col("m").alias("b")),
                                           F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
                 .select("e.*").where("a <> b").distinct())
        new, new_path = _write(small, "stars")
        drop_path(stars.sparkSession, path)
        stars, path, before, seen = new, new_path, seen, _print(new)
        if seen == before:
            break
    found = stars.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionAll(found.select(F.col("component").alias("id"), "component").distinct())


def cut_components(edges: DataFrame) -> DataFrame:
    return cut_lineage(components(edges), "components")
