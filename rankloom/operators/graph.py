"""Directed multigraphs as two tables, and what is asked of them without iterating."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import dense_number, running_sum


@dataclass
class Graph:
    """edges(src, dst) is a bag: repeated edges and loops count. vertices(id) may hold isolated ones."""

    edges: DataFrame
    vertices: DataFrame

    @classmethod
    def of(cls, edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
        edges = edges.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))
        if vertices is None:
            vertices = edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
        return cls(edges, vertices)

    def deduplicated(self) -> Graph:
        return Graph(self.edges.distinct(), self.vertices)

    def undirected(self) -> Graph:
        """Each edge both ways; loops once."""
        back = self.edges.where("src != dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        return Graph(self.edges.unionByName(back), self.vertices)


def size(g: Graph) -> DataFrame:
    return g.vertices.agg(F.count("*").alias("n"), F.max("id").alias("max_id")).select("n", g.edges.agg(F.count("*").alias("m")).scalar().alias("m"), "max_id")


def multiplicity(g: Graph) -> DataFrame:
    return g.edges.groupBy("src", "dst").agg(F.count("*").alias("mult"))


def self_loops(g: Graph) -> DataFrame:
    return g.edges.where("src = dst").groupBy(F.col("src").alias("id")).agg(F.count("*").alias("loops"))


def out_degrees(g: Graph) -> DataFrame:
    """(id, out_degree) of all vertices."""
    return _degrees(g, "src", "out_degree")


def in_degrees(g: Graph) -> DataFrame:
    return _degrees(g, "dst", "in_degree")


def _degrees(g: Graph, end: str, name: str) -> DataFrame:
    found = g.edges.groupBy(F.col(end).alias("id")).agg(F.count("*").alias(name))
    return g.vertices.join(found, "id", "left").select("id", F.coalesce(name, F.lit(0)).cast("long").alias(name))


def leaves(g: Graph) -> DataFrame:
    """Vertices without an edge out."""
    return g.vertices.join(g.edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def source_only(g: Graph) -> DataFrame:
    """Vertices without an edge in."""
    return g.vertices.join(g.edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def out_of_range(edges: DataFrame, n: int) -> DataFrame:
    """The edges of which an end isn't in 0 .. n-1; ids are valid below n only."""
    return edges.where(~(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)))


def in_range(edges: DataFrame, n: int) -> DataFrame:
    return edges.where(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))


def relabel(g: Graph) -> tuple[Graph, DataFrame]:
    """The graph on ids 0 .. n-1 in the order of the old ones, and the mapping (id, vid)."""
    mapping = dense_number(g.vertices, ["id"], "vid")
    tail, head = mapping.select(F.col("id").alias("src"), F.col("vid").alias("s")), mapping.select(F.col("id").alias("dst"), F.col("vid").alias("d"))
    edges = g.edges.join(tail, "src").join(head, "dst").select(F.col("s").alias("src"), F.col("d").alias("dst"))
    return Graph(edges, mapping.select(F.col("vid").alias("id"))), mapping


def in_degree_cdf(g: Graph) -> DataFrame:
    """(id, cdf): the edges into all vertices before."""
    return running_sum(in_degrees(g), ["id"], "in_degree", "cdf").select("id", "cdf")


def adjacency(g: Graph, inward: bool = False) -> DataFrame:
    """(id, neighbours): successors, or predecessors, in order; vertices with none have an empty list."""
    own, other = ("dst", "src") if inward else ("src", "dst")
    lists = g.edges.groupBy(F.col(own).alias("id")).agg(F.sort_array(F.collect_list(other)).alias("neighbours"))
    return g.vertices.join(lists, "id", "left").select("id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def with_out_degrees(g: Graph) -> DataFrame:
    """Each edge with the out-degree of its tail."""
    return g.edges.join(g.edges.groupBy("src").agg(F.count("*").alias("od")), "src").select("src", "dst", "od")


def sorted_edges(g: Graph) -> DataFrame:
    """Edges in the order of (head, tail) with their place."""
    return dense_number(g.edges, ["dst", "src"], "place")


def inconsistent_edges(g: Graph, degrees: DataFrame) -> DataFrame:
    """The edges whose tail has out-degree 0, or none, in degrees(id, out_degree)."""
    known = degrees.where("out_degree > 0").select(F.col("id").alias("src"))
    return g.edges.join(known, "src", "left_anti")


def inconsistent(g: Graph, degrees: DataFrame) -> int:
    """The number of such edges."""
    return inconsistent_edges(g, degrees).count()
