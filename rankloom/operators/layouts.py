"""Sparse-matrix layouts of a graph on ids 0 .. n-1: row = head, column = tail, value = 1 / out-degree of the tail.

Spark's rows have no place, so each array index of a layout is a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import bin_of
from ..storage import keep
from .graph import Graph, in_degrees, with_out_degrees
from .ordered import dense_number, running_sum


def coo(g: Graph) -> DataFrame:
    """(row, col, val); repeated edges are repeated entries."""
    return with_out_degrees(g).select(F.col("dst").alias("row"), F.col("src").alias("col"), (F.lit(1.0) / F.col("od")).alias("val"))


def slots(entries: DataFrame) -> DataFrame:
    """Adds each entry's place within its row, by column."""
    inside = Window.partitionBy("row").orderBy("col")
    return entries.withColumn("slot", (F.row_number().over(inside) - 1).cast("long"))


def row_lengths(g: Graph) -> DataFrame:
    return in_degrees(g).select(F.col("id").alias("row"), F.col("in_degree").alias("len"))


def row_pointers(g: Graph) -> DataFrame:
    """(row, begin) for 0 .. n: empty rows have the next row's begin, and row n the number of entries."""
    begins = running_sum(row_lengths(g), ["row"], "len", "begin").select("row", "begin", (F.col("begin") + F.col("len")).alias("_end"))
    last = begins.agg((F.coalesce(F.max("row"), F.lit(-1)) + 1).alias("row"), F.coalesce(F.max("_end"), F.lit(0)).alias("begin"))
    return begins.select("row", "begin").unionByName(last)


def csr(g: Graph) -> DataFrame:
    """(row, begin, cols, vals) of all rows."""
    return coo_to_csr(coo(g), row_lengths(g))


def coo_to_csr(entries: DataFrame, lengths: DataFrame) -> DataFrame:
    """lengths(row, len) has all rows, empty ones too."""
    begins = running_sum(lengths, ["row"], "len", "begin").select("row", "begin")
    lists = entries.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("col", "val"))).alias("e"))
    out = begins.join(lists, "row", "left").withColumn("e", F.coalesce("e", F.array().cast("array<struct<col:bigint,val:double>>")))
    return out.select("row", "begin", F.col("e.col").alias("cols"), F.col("e.val").alias("vals"))


def csr_to_coo(rows: DataFrame) -> DataFrame:
    return rows.select("row", F.explode(F.arrays_zip("cols", "vals")).alias("e")).select("row", F.col("e.cols").alias("col"), F.col("e.vals").alias("val"))


def ell(g: Graph) -> DataFrame:
    """(slot, row, col, val, place): the stored cells of rows padded to the longest; place = slot * n + row.

    The padding is no rows here: `ell_stats` has its size and `padding` its places by slot. A hub would make
    it the number of rows times the hub's edges.
    """
    return _placed(slots(coo(g)), g.vertices.count())


def csr_to_ell(rows: DataFrame) -> DataFrame:
    """As `ell`; the arrays' places are the slots."""
    cells = rows.select("row", F.posexplode(F.arrays_zip("cols", "vals")).alias("slot", "e"))
    return _placed(cells.select(F.col("slot").cast("long").alias("slot"), "row", F.col("e.cols").alias("col"), F.col("e.vals").alias("val")), rows.count())


def _placed(entries: DataFrame, n: int) -> DataFrame:
    return entries.select("slot", "row", "col", "val", (F.col("slot") * n + F.col("row")).alias("place"))


def padding(g: Graph) -> DataFrame:
    """(slot, padded): the rows that have nothing in a slot of the padded layout."""
    lengths = row_lengths(g).groupBy("len").agg(F.count("*").alias("rows"))  # a row a length
    stored = lengths.where("len > 0").select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("slot"), "rows")
    return stored.groupBy("slot").agg((F.lit(g.vertices.count()) - F.sum("rows")).alias("padded"))


def padded(cells: DataFrame, rows: DataFrame) -> DataFrame:
    """The cells of `ell` with those of the padding, which are 0, for rows(row): a view for small matrices."""
    f = rows.agg(F.count("*").alias("n"), cells.agg(F.max("slot")).scalar().alias("last")).first()
    grid = rows.select("row", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(-1 if f.last is None else f.last).cast("long"))).alias("slot")) if f.last is not None else cells.select("row", "slot")
    filled = grid.join(cells.drop("place"), ["row", "slot"], "left").select("slot", "row", F.coalesce("col", F.lit(0)).cast("long").alias("col"), F.coalesce("val", F.lit(0.0)).alias("val"))
    return _placed(filled, f.n)


def ell_stats(g: Graph) -> DataFrame:
    f = row_lengths(g).agg(F.count("*").alias("num_rows"), F.sum("len").alias("nnz"), F.max("len").alias("width"))
    return f.select("num_rows", "nnz", "width", (F.col("num_rows") * F.col("width")).alias("num_elements"))


def pieces(g: Graph, count: int) -> DataFrame:
    """(row, len, piece) of the rows that aren't empty: bins of equal width in row length."""
    lengths = keep(row_lengths(g).where("len > 0"))
    f = lengths.agg(F.min("len").alias("least"), F.max("len").alias("most")).first()
    least, width = f.least or 0, (f.most or 0) - (f.least or 0) + 1
    return lengths.withColumn("piece", bin_of(F.col("len") - least, count, F.lit(width)))


def jds(g: Graph, count: int) -> DataFrame:
    """(piece, local_row, row, slot, col, val): the stored cells; pieces without rows are dropped, the others numbered anew.

    Each piece is as wide as its longest row (`jds_stats`); the padding is no rows here. Rows within a piece
    are numbered by ranges of (piece, row), so a piece that holds most rows is in no single task.
    """
    placed = keep(pieces(g, count))
    named = placed.groupBy("piece").agg(F.count("*").alias("_rows")).collect()  # `count` rows at most
    begin, numbers, at = [], [], 0
    for i, r in enumerate(sorted(named, key=lambda r: r.piece)):
        numbers += [F.lit(r.piece), F.lit(i).cast("long")]
        begin += [F.lit(r.piece), F.lit(at).cast("long")]
        at += r["_rows"]
    if not named:
        return coo(g).where("false").select(F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("local_row"), "row", F.lit(0).cast("long").alias("slot"), "col", "val")
    rows = dense_number(placed, ["piece", "row"], "_at")
    rows = rows.select("row", F.element_at(F.create_map(*numbers), F.col("piece")).alias("piece"), (F.col("_at") - F.element_at(F.create_map(*begin), F.col("piece"))).alias("local_row"))
    return rows.join(slots(coo(g)), "row").select("piece", "local_row", "row", "slot", "col", "val")


def jds_stats(g: Graph, count: int) -> DataFrame:
    """(piece, rows, nnz, width) of the pieces that have rows."""
    found = pieces(g, count).groupBy("piece").agg(F.count("*").alias("rows"), F.sum("len").alias("nnz"), F.max("len").alias("width"))
    return found.select((F.dense_rank().over(Window.orderBy("piece")) - 1).cast("long").alias("piece"), "rows", "nnz", "width")


def spmv(entries: DataFrame, vector: DataFrame) -> DataFrame:
    """entries(row, col, val) times vector(id, x): (row, y) of the rows that have entries. Padding adds nothing."""
    x = vector.select(F.col("id").alias("col"), "x")
    return entries.join(x, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("x")).alias("y"))


def spmv_csr(rows: DataFrame, vector: DataFrame) -> DataFrame:
    """rows(row, cols, vals) times vector(id, x): (row, y) of all rows, 0 for empty ones."""
    found = spmv(csr_to_coo(rows), vector)
    return rows.select("row").join(found, "row", "left").select("row", F.coalesce("y", F.lit(0.0)).alias("y"))
