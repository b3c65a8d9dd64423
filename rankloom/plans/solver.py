"""The fixpoint of the ranks: a driver loop over one job for each block of steps.

A step is x' = base + damping A x, where A has the weights and base is one number that depends on the mass
that x has on leaves. So after j steps from a block's start p0

    x_j = damping^j p_j + sum over i < j of base_i damping^(j-1-i) q_(j-1-i),    p_j = A^j p0,  q_j = A^j 1

and within a block nothing has to come back to the driver: one job makes p_1 .. p_B by B joins and sums (a row
from each vertex to itself carries what is there already through them), writes them to the shared folder, which cuts the lineage, and observes their mass on leaves on the way. The
driver gets the block's bases from these few numbers, and x_B is an expression over the columns that the
next block starts from. The q are made once; as the ranks start uniform, the same job is the first block.
The block before is deleted once the next is written.

The weights are dealt by source, sorted and cached (recomputed where an executor is lost), so a step
shuffles only sums by head, combined before they are sent. A source with more than a partition's mean of
edges is dealt to several by its heads, and its rank is sent to each of them: such sources are fewer than
the partitions. `backend="local"` runs the same steps on arrays in one task; it is there to compare with,
and nothing chooses it by itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import DAMPING, TOLERANCE
from ..operators import layouts
from ..operators.graph import Graph
from ..storage import delete, keep, shared_dir
from .steps import uniform, weights

BLOCK = 5
PIECES = 8

#: The variants' numbers of steps, tolerances and treatment of leaves, and the layout that is multiplied.
PRESETS = {
    "push": {"max_iter": 101, "tol": TOLERANCE},
    "pull": {"max_iter": 201},
    "pull_parallel": {"max_iter": 201},
    "pull_simple": {"max_iter": 201},
    "pull_wide": {"max_iter": 201},
    "pull_expanded": {"max_iter": 201},
    "distributed": {"max_iter": 200},
    "csr_scalar": {"max_iter": 200, "dangling": "normalize", "layout": "csr"},
    "csr_vector": {"max_iter": 200, "dangling": "normalize", "layout": "csr"},
    "ell": {"max_iter": 200, "dangling": "normalize", "layout": "ell"},
    "jds": {"max_iter": 200, "dangling": "normalize", "layout": "jds"},
}

#: The stored entries (row, col, val) of a layout.
LAYOUTS = {
    "coo": layouts.coo,
    "csr": lambda g: layouts.csr_to_coo(layouts.csr(g)),
    "ell": layouts.ell,
    "jds": lambda g: layouts.jds(g, PIECES),
}


@dataclass
class Ranks:
    ranks: DataFrame
    iterations: int
    norms: list[float] = field(default_factory=list)

    def trace(self) -> DataFrame:
        """(it, nrm): the change in each step."""
        rows = ", ".join(f"({i + 1}L, {x!r}d)" for i, x in enumerate(self.norms)) or "(0L, 0d)"
        return self.ranks.sparkSession.sql(f"select * from values {rows} as t(it, nrm) where it > 0")


def solve(
    g: Graph, variant: str | None = None, *, max_iter: int | None = None, tol: float | None = None, damping: float = DAMPING,
    dangling: str = "redistribute", dedupe: bool = False, layout: str | None = None, backend: str = "distributed", block: int = BLOCK,
) -> Ranks:
    """Ranks after exactly max_iter steps, or once a step changes them by `tol` at most (Euclidean norm).

    dangling = "redistribute" spreads the mass on leaves over all vertices in each step; "normalize" lets
    it go and divides by the sum at the end. The vector returned is the newest. An empty graph has no ranks.
    layout: the matrix whose stored entries are multiplied (coo, csr, ell, jds); without one, repeated edges
    are first made one weight, which is the same product.
    """
    if variant is not None:
        preset = PRESETS[variant]
        max_iter, tol, dangling = preset["max_iter"] if max_iter is None else max_iter, tol if tol is not None else preset.get("tol"), preset.get("dangling", dangling)
        layout = layout or preset.get("layout")
    if max_iter is None and tol is None:
        raise ValueError("max_iter or tol must be given: the loop would not end")
    if dangling not in ("redistribute", "normalize") or backend not in ("local", "distributed"):
        raise ValueError(f"dangling: {dangling}, backend: {backend}")
    g = g.deduplicated() if dedupe else g
    w = LAYOUTS[layout](g).select(F.col("col").alias("src"), F.col("row").alias("dst"), F.col("val").alias("w")) if layout else weights(g)
    vertices = g.vertices.select("id").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if backend == "local":
            return _local(w, vertices, max_iter, tol, damping, dangling)
        return _distributed(Graph(g.edges, vertices), w, max_iter, tol, damping, dangling, block)
    finally:
        vertices.unpersist()


def iterate(ids: np.ndarray, src: np.ndarray, dst: np.ndarray, share: np.ndarray, max_iter: int | None, tol: float | None, damping: float, dangling: str) -> tuple[np.ndarray, list[float]]:
    """The ranks of the sorted ids and the change in each step; src and dst are places among the ids."""
    n = len(ids)
    leaf = np.ones(n, bool)
    leaf[src] = False
    x, norms = np.full(n, 1.0 / max(n, 1)), []
    while max_iter is None or len(norms) < max_iter:
        leak = x[leaf].sum() if dangling == "redistribute" else 0.0
        before, x = x, (leak + (1 - leak) * (1 - damping)) / max(n, 1) + damping * np.bincount(dst, weights=share * x[src], minlength=n)
        norms.append(float(np.sqrt(((x - before) ** 2).sum())))
        if tol is not None and norms[-1] <= tol:
            break
    return (x / x.sum() if dangling == "normalize" and n else x), norms


def _local(w: DataFrame, vertices: DataFrame, max_iter: int | None, tol: float | None, damping: float, dangling: str) -> Ranks:
    rows = w.unionByName(vertices.select(F.col("id").alias("src"), F.lit(None).cast("long").alias("dst"), F.lit(None).cast("double").alias("w")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        vertex = table.column("dst").is_null().to_numpy()
        src = table.column("src").to_numpy()
        ids, edge = np.sort(src[vertex]), ~vertex
        edges = np.stack([src[edge], table.column("dst").drop_null().to_numpy()])
        order = np.lexsort(edges)  # the same sums on every run
        at = np.searchsorted(ids, edges[:, order])
        x, norms = iterate(ids, at[0], at[1], table.column("w").drop_null().to_numpy()[order], max_iter, tol, damping, dangling)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(norms)) + 1), pa.nulls(len(norms), pa.int64()), pa.array(norms, pa.float64())], names=["it", "id", "x"])
        yield pa.RecordBatch.from_arrays([pa.nulls(len(ids), pa.int64()), pa.array(ids), pa.array(x)], names=["it", "id", "x"])

    made = keep(rows.repartition(1).mapInArrow(run, "it long, id long, x double"))
    norms = [r.x for r in made.where("it is not null").orderBy("it").collect()]  # a row a step
    return Ranks(made.where("it is null").select("id", F.col("x").alias("pr")), len(norms), norms)


class _Matrix:
    """The weights, dealt by source, sorted and cached, with a row of no weight from each vertex to itself."""

    def __init__(self, w: DataFrame, vertices: DataFrame) -> None:
        parts = int(w.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        w = w.unionByName(vertices.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(None).cast("double").alias("w")))
        dealt = w.repartition(parts, "src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
        own = dealt.groupBy("src").agg(F.count("*").alias("n"))
        facts = own.agg(F.sum("n").alias("m"), F.max("n").alias("most")).first()
        mean = max(1024, -(-(facts.m or 0) // parts))
        self.cached, self.hubs, self.key = [dealt], None, ["src"]
        if (facts.most or 0) > mean:  # fewer than `parts` sources
            self.hubs = F.broadcast(keep(own.where(F.col("n") > mean).select("src", F.ceil(F.col("n") / mean).cast("int").alias("_salts"))))
            salt = F.when(F.col("w").isNotNull(), F.pmod(F.xxhash64("dst"), F.col("_salts")).cast("int"))
            salted = dealt.join(self.hubs, "src", "left").withColumn("_salt", F.coalesce(salt, F.lit(0))).drop("_salts")
            self.key = ["src", "_salt"]
            self.cached.append(salted.repartition(parts, *self.key).sortWithinPartitions(*self.key).persist(StorageLevel.MEMORY_AND_DISK))

    def times(self, x: DataFrame, name: str, j: int) -> DataFrame:
        """(id, <name>0 .. <name>j) with <name>(j+1), the product with the last one; a vertex's own row carries the others on."""
        x = x.withColumnRenamed("id", "src")
        if self.hubs is not None:
            x = x.join(self.hubs, "src", "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
        carried = [F.max(F.when(F.col("w").isNull(), F.col(f"{name}{i}"))).alias(f"{name}{i}") for i in range(j + 1)]
        made = F.coalesce(F.sum(F.col("w") * F.col(f"{name}{j}")), F.lit(0.0)).alias(f"{name}{j + 1}")
        return self.cached[-1].join(x, self.key).groupBy(F.col("dst").alias("id")).agg(*carried, made)

    def free(self) -> None:
        for df in self.cached:
            df.unpersist()


def _distributed(g: Graph, w: DataFrame, max_iter: int | None, tol: float | None, damping: float, dangling: str, block: int) -> Ranks:
    spark, matrix = g.edges.sparkSession, _Matrix(w, g.vertices)
    folder = shared_dir(spark, "ranks")
    left = lambda: block if max_iter is None else min(block, max_iter - len(norms))

    def written(base: DataFrame, name: str, start: Column, steps: int, at: int) -> tuple[DataFrame, dict[str, float]]:
        """base with <name>0, the start, and <name>1 .. of the steps; of each its mass on leaves (l) and on all (t)."""
        x = base.select("id", start.alias(f"{name}0"))
        for j in range(steps):
            x = matrix.times(x, name, j)
        state = base.drop("_x").join(x, "id")
        seen, total = Observation(), lambda c: F.coalesce(F.sum(c), F.lit(0.0))
        sums = [total(F.when(F.col("leaf"), F.col(f"{name}{j}"))).alias(f"l{j}") for j in range(steps + 1)]
        state = state.observe(seen, F.count("*").alias("n"), *sums, *[total(f"{name}{j}").alias(f"t{j}") for j in range(steps + 1)])
        state.write.parquet(f"{folder}/{at}")
        return spark.read.schema(state.schema).parquet(f"{folder}/{at}"), seen.get

    norms: list[float] = []
    try:
        n_q = left()
        state, q = written(uniform(g, 1).select("id", "leaf"), "q", F.lit(1.0), n_q, 0)
        n, at = max(q["n"], 1), 0
        ones = [F.col(f"q{j}") for j in range(n_q + 1)]
        p, column = {k: v / n for k, v in q.items()}, [c / n for c in ones]  # the ranks start at 1 / n
        steps, vector, total = n_q, column[0], p["t0"]
        while steps:
            base: list[float] = []
            # of the j-th vector: the parts of q, latest first, and of p
            parts = lambda j: [base[i] * damping ** (j - 1 - i) for i in range(j)]  # noqa: E731, B023
            whole = lambda j, kind: sum(c * q[f"{kind}{j - 1 - i}"] for i, c in enumerate(parts(j))) + damping**j * p[f"{kind}{j}"]  # noqa: E731, B023
            for j in range(steps):
                leak = whole(j, "l") if dangling == "redistribute" else 0.0
                base.append((leak + (1 - leak) * (1 - damping)) / n)
            x = [sum((F.lit(c) * ones[j - 1 - i] for i, c in enumerate(parts(j))), F.lit(damping**j) * column[j]) for j in range(steps + 1)]
            changes = state.agg(*[F.coalesce(F.sum((x[j + 1] - x[j]) ** 2), F.lit(0.0)).alias(f"c{j}") for j in range(steps)]).first()  # a row
            changes = [math.sqrt(c) for c in changes]
            ended = next((j for j, c in enumerate(changes) if tol is not None and c <= tol), None)
            used = steps if ended is None else ended + 1
            norms += changes[:used]
            vector, total = x[used], whole(used, "t")
            steps = left() if ended is None else 0
            if steps:
                state, p = written(state.select("id", "leaf", *[f"q{j}" for j in range(n_q + 1)], vector.alias("_x")), "p", F.col("_x"), steps, at + 1)
                delete(spark, f"{folder}/{at}")
                at, column = at + 1, [F.col(f"p{j}") for j in range(steps + 1)]
    finally:
        matrix.free()
    pr = vector / F.lit(total) if dangling == "normalize" and total else vector
    return Ranks(state.select("id", pr.alias("pr")), len(norms), norms)


def top(ranks: DataFrame, k: int) -> DataFrame:
    """The k highest ranks; of equal ones those with the smallest ids."""
    return ranks.orderBy(F.desc("pr"), "id").limit(k)
