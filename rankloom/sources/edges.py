"""Text sources and sinks: edge lists with a header, raw and Pajek graphs, rank files, run logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import rank_text
from ..operators.graph import Graph, out_of_range, relabel
from ..operators.ordered import dense_number, running_sum
from ..storage import keep

INTEGER = r"^[+-]?\d+$"


@dataclass
class EdgeFile:
    """What an edge list holds. `rejects` (line_no, value, reason) has the lines that are no edges of it."""

    graph: Graph
    n: int
    declared_edges: int
    rejects: DataFrame

    def header_mismatch(self) -> int:
        """The declared number of edges less the edges there are."""
        return self.declared_edges - self.graph.edges.count()


def _placed_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, _file, _at) of the text files; their order is that of the files' names and their lines.

    A scan begins with the largest file, not with the first. Spark deals one file's splits in order, so
    the place within the splits follows the file.
    """
    return spark.read.text(path).select("value", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at"))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of the text files, from 0 in the order of the files' names and their lines."""
    return dense_number(keep(_placed_lines(spark, path)), ["_file", "_at"], "line_no").select("line_no", "value")


def _words(value: Column) -> Column:
    return F.filter(F.split(F.trim(F.regexp_replace(value, r"\s+", " ")), " "), lambda w: w != "")


def header(spark: SparkSession, path: str) -> tuple[int, int]:
    """The numbers of vertices and edges in the first line, which is line 0 of `numbered_lines`."""
    words = _placed_lines(spark, path).orderBy("_file", "_at").limit(1).select(_words(F.col("value")).alias("w")).first()
    if words is None or len(words.w) < 2 or not all(x.lstrip("+-").isdigit() for x in words.w[:2]):
        raise ValueError(f"{path}: the first line must be the numbers of vertices and edges")
    return int(words.w[0]), int(words.w[1])


def parse_edges(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(line_no, value) -> (line_no, src, dst) by the first two words, and the lines that have no two integers of 64 bits."""
    w = lines.select("line_no", "value", _words(F.col("value")).alias("w"))
    number = lambda i: F.when(F.get("w", F.lit(i)).rlike(INTEGER), F.get("w", F.lit(i)).try_cast("long"))
    w = w.select("line_no", "value", F.size("w").alias("n"), number(0).alias("src"), number(1).alias("dst"))
    fine = F.col("src").isNotNull() & F.col("dst").isNotNull()
    return w.where(fine).select("line_no", "src", "dst"), w.where(~fine & (F.col("n") > 0)).select("line_no", "value", F.lit("not two integers").alias("reason"))


def read_edge_list(spark: SparkSession, path: str) -> EdgeFile:
    """A header "N\\tM", then "tail\\thead" a line. Ids are valid in 0 .. N-1; M is only compared. All N vertices are there."""
    n, m = header(spark, path)
    lines = numbered_lines(spark, path).where("line_no > 0")
    edges, malformed = parse_edges(lines)
    outside = out_of_range(edges, n).join(lines, "line_no").select("line_no", "value", F.lit("id out of range").alias("reason"))
    kept = edges.where(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1))
    return EdgeFile(Graph.of(kept, spark.range(n)), n, m, malformed.unionByName(outside))


def edge_lines(lines: DataFrame) -> DataFrame:
    """Without comments ("#") and the sections that a line with "*" begins and the next such line ends."""
    marked = running_sum(lines.withColumn("_mark", F.col("value").startswith("*").cast("int")), ["line_no"], "_mark", "_before")
    return marked.where("_mark = 0 and _before % 2 = 0").where(~F.col("value").startswith("#")).drop("_mark", "_before")


def read_raw_graph(spark: SparkSession, path: str, keep_isolated: bool = False) -> tuple[Graph, DataFrame, DataFrame]:
    """A raw list of pairs or a Pajek file: the graph on dense ids, the mapping (id, vid), and the rejects.

    With keep_isolated the vertices that a Pajek section declares are there without edges too.
    """
    lines = numbered_lines(spark, path)
    edges, rejects = parse_edges(edge_lines(lines))
    vertices = None
    if keep_isolated:
        declared = lines.join(edge_lines(lines), "line_no", "left_anti").where(~F.col("value").startswith("*") & ~F.col("value").startswith("#"))
        own = declared.select(F.get(_words(F.col("value")), F.lit(0)).try_cast("long").alias("id")).where("id is not null")
        vertices = own.unionByName(edges.select(F.explode(F.array("src", "dst")).alias("id"))).distinct()
    graph, mapping = relabel(Graph.of(edges, vertices))
    return graph, mapping, rejects


def prepared_lines(g: Graph, n: int, m: int) -> DataFrame:
    """The lines of a prepared edge list, in order: the header and the edges by (head, tail)."""
    head = g.edges.sparkSession.sql(f"select cast(-1 as bigint) at, '{n}\t{m}' value")
    edges = dense_number(g.edges, ["dst", "src"], "at").select("at", F.concat_ws("\t", "src", "dst").alias("value"))
    return head.unionByName(edges)


def write_prepared(g: Graph, path: str) -> None:
    """The prepared edge list in parts whose names sort in order; parts joined are the file."""
    n, m = g.vertices.count(), g.edges.count()
    prepared_lines(g, n, m).orderBy("at").select("value").write.text(path)


def prepared_name(path: str) -> str:
    stem, dot, ending = path.rpartition(".")
    return f"{stem}_out.{ending}" if dot else f"{path}_out"


def write_ranks(ranks: DataFrame, path: str) -> None:
    """One rank a line, by id, with 12 decimals; appended to what is there."""
    ranks.orderBy("id").select(rank_text(F.col("pr")).alias("value")).write.mode("append").text(path)


def read_ranks(spark: SparkSession, path: str) -> DataFrame:
    """(id, pr): ids are the lines' numbers."""
    return numbered_lines(spark, path).select(F.col("line_no").alias("id"), F.col("value").try_cast("double").alias("pr"))


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of logs/*.txt"""
    return spark.read.text(path).select(F.input_file_name().alias("file"), F.col("value").alias("line"))
