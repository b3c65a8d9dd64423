"""One step of the rank computation, as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import DAMPING, base_score
from ..operators.graph import Graph


def weights(g: Graph) -> DataFrame:
    """(src, dst, w): w is the share of its rank that src gives dst. Repeated edges are one row, which is exact."""
    pairs = g.edges.groupBy("src", "dst").agg(F.count("*").alias("mult"))
    total = g.edges.groupBy("src").agg(F.count("*").alias("od"))
    return pairs.join(total, "src").select("src", "dst", (F.col("mult") / F.col("od")).alias("w"))


def uniform(g: Graph, n: int) -> DataFrame:
    """(id, leaf, pr) at the start."""
    tails = g.edges.select(F.col("src").alias("id"), F.lit(False).alias("leaf")).distinct()
    return g.vertices.join(tails, "id", "left").select("id", F.coalesce("leaf", F.lit(True)).alias("leaf"), F.lit(1.0 / max(n, 1)).alias("pr"))


def leaked_mass(state: DataFrame) -> DataFrame:
    """The mass on vertices without an edge out; 0 if there are none."""
    return state.agg(F.coalesce(F.sum(F.when(F.col("leaf"), F.col("pr"))), F.lit(0.0)).alias("leak"))


def inflow(w: DataFrame, state: DataFrame) -> DataFrame:
    """(id, s): what the vertices with edges in receive. Pushing and pulling are the same join and sum."""
    given = w.join(state.select(F.col("id").alias("src"), "pr"), "src")
    return given.groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("pr")).alias("s"))


def advance(w: DataFrame, state: DataFrame, base: Column, damping: float = DAMPING) -> DataFrame:
    """(id, leaf, prev, pr) after a step; vertices without an edge in get the base alone."""
    return state.join(inflow(w, state), "id", "left").select("id", "leaf", F.col("pr").alias("prev"), (base + F.lit(damping) * F.coalesce("s", F.lit(0.0))).alias("pr"))


def one_step(g: Graph, damping: float = DAMPING) -> DataFrame:
    """(id, pr) after the first step from the uniform start, in one plan."""
    n = g.vertices.count()
    state = uniform(g, n)
    base = base_score(leaked_mass(state).scalar(), n, damping)
    return advance(weights(g), state, base, damping).select("id", "pr")
