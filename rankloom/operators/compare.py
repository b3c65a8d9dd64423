"""Comparing rank vectors, and what range partitioning of a graph would give each part."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bin_of
from .graph import Graph, in_degrees, relabel


def differing(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(id, a, b) of the vertices whose ranks differ by more than the tolerance, or that only one side has."""
    both = a.select("id", F.col("pr").alias("a")).join(b.select("id", F.col("pr").alias("b")), "id", "full")
    return both.where(F.col("a").isNull() | F.col("b").isNull() | (F.abs(F.col("a") - F.col("b")) > tolerance))


def assert_same(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> None:
    first = differing(a, b, tolerance).limit(1).collect()
    if first:
        raise AssertionError(f"ranks differ at {first[0].id}: {first[0].a} and {first[0].b}")


def norm_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The Euclidean norm of the difference; one row."""
    d = a.select("id", F.col("pr").alias("a")).join(b.select("id", F.col("pr").alias("b")), "id")
    return d.agg(F.coalesce(F.sqrt(F.sum((F.col("a") - F.col("b")) ** 2)), F.lit(0.0)).alias("norm"))


def partition_plan(g: Graph, parts: int) -> DataFrame:
    """(part, first_id, nodes, edges): ranges of ids, of equal numbers of vertices, with the edges into each."""
    dense, _ = relabel(g)
    n = dense.vertices.count()
    placed = in_degrees(dense).withColumn("part", bin_of(F.col("id"), parts, F.lit(max(n, 1))))
    return placed.groupBy("part").agg(F.min("id").alias("first_id"), F.count("*").alias("nodes"), F.sum("in_degree").alias("edges"))
