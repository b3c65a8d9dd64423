"""Edge streams: out- and in-degrees and edge multiplicities kept up to date as edges arrive.

The ranks themselves are a fixpoint over a whole graph and are computed in batch (`plans.solver`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_degrees(edges: DataFrame) -> DataFrame:
    """A streaming edges(src, dst) -> id, out_degree, in_degree; an update for each vertex that changed."""
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"))))
    return edges.select(ends.alias("e")).groupBy("e.id").agg(F.sum("e.o").alias("out_degree"), F.sum("e.i").alias("in_degree"))


def streaming_multiplicity(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("mult"))
