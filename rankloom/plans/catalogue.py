"""The registered queries on graphs made from the test tables, each with its SQL for another engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import DAMPING, TOLERANCE, affine, base_score, rank_text
from ..operators import compare, graph, layouts, logs
from ..operators.graph import Graph
from ..operators.ordered import dense_number
from ..sources import edges as text
from ..storage import shared_dir
from . import solver, steps

Query = Callable[[SparkSession, str], DataFrame]
BINS, PARTS, STEPS = 3, 4, 20
SMALL, LARGE = 30, 40  # sizes of parts


# ---- graphs -----------------------------------------------------------------------------


def custsupp(spark: SparkSession, d: str) -> Graph:
    """Customers to the suppliers of what they ordered: bipartite, with repeated edges; all suppliers are leaves."""
    orders, items = spark.read.parquet(f"{d}/orders.parquet"), spark.read.parquet(f"{d}/lineitem.parquet")
    both = orders.select("o_orderkey", "o_custkey").join(items.select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    return Graph.of(both.select((F.col("o_custkey") * 2).alias("src"), (F.col("l_suppkey") * 2 + 1).alias("dst")))


def mixed(spark: SparkSession, d: str) -> Graph:
    """All pairs of part and supplier, without repeated edges: large parts are pointed at, small ones point, others both."""
    items = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_partkey").alias("p"), (F.col("l_suppkey") + 100_000_000).alias("s")).distinct()
    parts = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("p"), "p_size")
    there, back = F.struct(F.col("p").alias("src"), F.col("s").alias("dst")), F.struct(F.col("s").alias("src"), F.col("p").alias("dst"))
    ways = F.when(F.col("p_size") <= SMALL, F.array(there)).when(F.col("p_size") > LARGE, F.array(back)).otherwise(F.array(there, back))
    return Graph.of(items.join(parts, "p", "left").select(F.explode(ways).alias("e")).select("e.*"))


def events(spark: SparkSession, d: str) -> Graph:
    """From each event's user to the next event's: repeated edges and loops."""
    seen = dense_number(spark.read.parquet(f"{d}/events.parquet").select("ts", "event_id", "user_id"), ["ts", "event_id"], "at")
    after = seen.select((F.col("at") - 1).alias("at"), F.col("user_id").alias("dst"))
    return Graph.of(seen.select("at", F.col("user_id").alias("src")).join(after, "at").select("src", "dst"))


def nations(spark: SparkSession, d: str) -> Graph:
    """Customers' nations to suppliers' nations, an edge for each item."""
    t = {n: spark.read.parquet(f"{d}/{n}.parquet") for n in ("orders", "customer", "lineitem", "supplier")}
    items = t["orders"].select("o_orderkey", "o_custkey").join(t["lineitem"].select("l_orderkey", "l_suppkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    items = items.join(t["customer"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    return Graph.of(items.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst")))


def pages(spark: SparkSession, d: str) -> Graph:
    """Pages to the places that they link to."""
    links = spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1))).alias("h"))
    places = dense_number(links.select("h").distinct(), ["h"], "at")
    return Graph.of(links.join(places, "h").select(F.col("page_id").alias("src"), (F.col("at") + 1_000_000_001).alias("dst")))


GRAPHS = {
    "custsupp": (custsupp, "select o_custkey*2 src, l_suppkey*2+1 dst from orders join lineitem on o_orderkey=l_orderkey"),
    "mixed": (mixed, f"""select x.src, x.dst from (select unnest(case when p_size <= {SMALL} then [{{'src': p, 'dst': s}}] when p_size > {LARGE} then [{{'src': s, 'dst': p}}] else [{{'src': p, 'dst': s}}, {{'src': s, 'dst': p}}] end) x
        from (select distinct l_partkey p, l_suppkey + 100000000 s from lineitem) left join part on p_partkey = p)"""),
    "events": (events, "select user_id src, nx dst from (select user_id, lead(user_id) over (order by ts,event_id) nx from events) where nx is not null"),
    "nation": (nations, "select c_nationkey::bigint src, s_nationkey::bigint dst from orders join customer on c_custkey=o_custkey join lineitem on l_orderkey=o_orderkey join supplier on s_suppkey=l_suppkey"),
    "pages": (pages, "select page_id src, 1000000000+dense_rank() over (order by h) dst from (select page_id, unnest(regexp_extract_all(html,'href=\"(/[^\"]*)\"',1)) h from pages)"),
}

TABLES = """v as materialized (select src id from e union select dst from e),
vi as materialized (select id, cast(row_number() over (order by id) - 1 as bigint) vid, cast(count(*) over () as bigint) n from v),
od as materialized (select src id, cast(count(*) as bigint) d from e group by src),
idg as materialized (select dst id, cast(count(*) as bigint) d from e group by dst),
rows_ as materialized (select vi.vid r, vi.n, coalesce(idg.d, 0) d from vi left join idg on idg.id = vi.id),
coo as materialized (select h.vid r, t.vid c, cast(1 as double) / od.d w from e join vi h on h.id=e.dst join vi t on t.id=e.src join od on od.id=e.src),
coos as materialized (select r, c, w, cast(row_number() over (partition by r order by c) - 1 as bigint) slot from coo),
pieces as materialized (select r, d, cast(floor(((d-mn+1)*3-1)/(mx-mn+1)) as bigint) piece from (select r, d, min(d) over () mn, max(d) over () mx from rows_ where d > 0) z),
numbered as materialized (select piece, cast(dense_rank() over (order by piece) - 1 as bigint) number, width from (select piece, max(d) width from pieces group by piece) y),
nn as materialized (select cast(count(*) as double) n from v),
x0 as materialized (select vi.id, 1.0::double / vi.n pr, od.d od from vi left join od on od.id = vi.id),
lk as materialized (select coalesce(sum(case when od is null then pr end), 0) l from x0),
inflow as materialized (select e.dst id, sum(x0.pr / x0.od) s from e join x0 on x0.id = e.src group by 1)
"""  # fmt: skip


def on(name: str, body: str, recursion: str = "", source: str | None = None) -> str:
    e = source or GRAPHS[name][1]
    return f"with recursive e as materialized ({e}),\n{TABLES}{recursion}\n{body}"


def loop(steps_: int, leak: bool = True) -> str:
    base = "(c.lk+(1-c.lk)*(1-0.85))/n" if leak else "(1-0.85)/n"
    return f""", r(it, id, pr) as (
  select 0, id, 1.0::double / n from v, nn
  union all
  select c.it+1, c.id, {base} + 0.85*coalesce(s.s, 0)
  from (select r.it, r.id, coalesce(sum(case when od.d is null then r.pr end) over (), 0) lk from r left join od using (id) where it < {steps_}) c
  left join (select e.dst id, sum(r.pr/od.d) s from r join e on e.src=r.id join od on od.id=e.src where r.it < {steps_} group by 1) s on s.id=c.id, nn)"""


NORMS = "tr as materialized (select a.it, sqrt(sum((a.pr-b.pr)*(a.pr-b.pr))) nrm from r a join r b on a.id=b.id and a.it=b.it+1 group by 1)"


# ---- queries ----------------------------------------------------------------------------


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 9) for c in columns})


def _joined(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


def _dense(spark: SparkSession, d: str) -> Graph:
    return graph.relabel(mixed(spark, d))[0]


def ranks(name: str, **options) -> Query:  # noqa: ANN003
    return lambda spark, d: _rounded(solver.solve(GRAPHS[name][0](spark, d), **({"max_iter": STEPS} | options)).ranks, "pr")


def structure(name: str, f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, d: f(GRAPHS[name][0](spark, d))


def layout(f: Callable[[Graph], DataFrame]) -> Query:
    return lambda spark, d: f(_dense(spark, d))


def _step_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(steps.one_step(mixed(spark, d)), "pr")


def _push_query(spark: SparkSession, d: str) -> DataFrame:
    """The same step from the tails' side: what each vertex gives, before it is summed by head."""
    g = mixed(spark, d)
    n = g.vertices.count()
    state = steps.uniform(g, n)
    given = graph.with_out_degrees(g).join(state.select(F.col("id").alias("src"), "pr"), "src").select(F.col("dst").alias("id"), (F.col("pr") / F.col("od")).alias("x"))
    got = given.groupBy("id").agg(F.sum("x").alias("s"))
    base = base_score(steps.leaked_mass(state).scalar(), n)
    return _rounded(state.join(got, "id", "left").select("id", (base + F.lit(DAMPING) * F.coalesce("s", F.lit(0.0))).alias("pr")), "pr")


def _spmv_query(entries: Callable[[Graph], DataFrame] | None) -> Query:
    """The matrix times the uniform vector, over the entries or, without them, over the arrays of the rows."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        g = _dense(spark, d)
        x = g.vertices.select("id", F.lit(1.0 / g.vertices.count()).alias("x"))
        return _rounded(layouts.spmv(entries(g), x) if entries else layouts.spmv_csr(layouts.csr(g), x), "y")

    return query


def _affine_query(spark: SparkSession, d: str) -> DataFrame:
    g = _dense(spark, d)
    n = g.vertices.count()
    y = layouts.spmv(layouts.coo(g), g.vertices.select("id", F.lit(1.0 / n).alias("x")))
    all_rows = g.vertices.select(F.col("id").alias("row")).join(y, "row", "left")
    return all_rows.select("row", F.round(affine(F.coalesce("y", F.lit(0.0)), n), 9).alias("y"))


def _first_base(spark: SparkSession, d: str) -> DataFrame:
    g = mixed(spark, d)
    n = g.vertices.count()
    return steps.leaked_mass(steps.uniform(g, n)).select(F.round(base_score(F.col("leak"), n), 9).alias("base"))


def _reject_query(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_of_range(graph.relabel(mixed(spark, d))[0].edges, 500)


def _variants(spark: SparkSession, d: str, rows: bool) -> DataFrame:
    """The push variant, distributed and stopped by its tolerance, against two others at all of their steps in one task; 1e-6 is allowed."""
    g = mixed(spark, d)
    a = solver.solve(g, "push").ranks
    found = [compare.differing(a, solver.solve(g, name, backend="local").ranks) for name in ("pull", "distributed")]
    found = found[0].unionByName(found[1])
    return found if rows else found.agg(F.count("*").alias("n"))


def _trace(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(solver.solve(mixed(spark, d), max_iter=STEPS).trace(), "nrm").select(F.col("it").cast("int").alias("it"), "nrm")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    found = solver.solve(GRAPHS["nation"][0](spark, d), max_iter=STEPS).ranks
    return found.select("id", rank_text(F.round("pr", 9)).alias("line"))


def _log_lines(spark: SparkSession, d: str, key: str) -> DataFrame:
    made = spark.read.parquet(f"{d}/events.parquet").select(F.lit("events").alias("file"), F.concat("event_type", F.lit(key), F.col("value").cast("string")).alias("line"))
    return logs.timings(made)


def _written(lines: DataFrame) -> str:
    """A folder of the lines, in order, in the shared folder."""
    path = shared_dir(lines.sparkSession, "lines")
    lines.orderBy("line_no").select("value").write.text(path)
    return path


def _nation_lines(spark: SparkSession, d: str) -> DataFrame:
    g, _ = graph.relabel(nations(spark, d))
    return text.prepared_lines(g, g.vertices.count(), g.edges.count()).select(F.col("at").alias("line_no"), "value")


def _counted(edges: DataFrame) -> DataFrame:
    return edges.groupBy("src", "dst").agg(F.count("*").alias("mult"))


#: Lines that are no edges of a graph of 25 vertices, at the numbers that they get.
BAD_LINES = ["25\t0", "0\t-1", "1\tx", "7", "99999999999999999999\t1", "2\t1e3"]


def _edge_file(spark: SparkSession, d: str, rejects: bool = False) -> DataFrame:
    """An edge list with a header, written and read again, with bad lines in it."""
    lines = _nation_lines(spark, d)
    last = lines.agg(F.max("line_no")).first()[0] + 2  # numbers are of the file, and the header's is 0
    bad = spark.createDataFrame([(last + i, x) for i, x in enumerate(BAD_LINES)], "line_no long, value string")
    found = text.read_edge_list(spark, _written(lines.unionByName(bad)))
    return found.rejects.select((F.col("line_no") - last).alias("number"), "value", "reason") if rejects else _counted(found.graph.edges)


def _file_facts(spark: SparkSession, d: str) -> DataFrame:
    found = text.read_edge_list(spark, _written(_nation_lines(spark, d)))
    n, m = text.header(spark, _written(_nation_lines(spark, d)))
    return found.graph.vertices.agg(F.count("*").alias("n")).select("n", F.lit(n).cast("long").alias("header_n"), F.lit(m).cast("long").alias("header_m"), F.lit(found.header_mismatch()).cast("long").alias("mismatch"))


def _file_layout(f: Callable[[Graph], DataFrame]) -> Query:
    """A layout of an edge list that is read from a file."""
    return lambda spark, d: f(text.read_edge_list(spark, _written(_nation_lines(spark, d))).graph)


def _raw_file(spark: SparkSession, d: str, pajek: bool) -> DataFrame:
    """Raw ids with comments between, or the sections of a Pajek file: written, read, relabelled."""
    edges = nations(spark, d).edges.select((F.col("src") * 10).alias("src"), (F.col("dst") * 10).alias("dst"))
    lines = dense_number(edges, ["dst", "src"], "line_no").select("line_no", F.concat_ws(" ", "src", "dst").alias("value"))
    head = ["*Vertices 2", '1 "a"', '2 "b"', "*Arcs"] if pajek else ["# from", "# to", "", "# end"]
    found, mapping, _ = text.read_raw_graph(spark, _written(lines.unionByName(spark.createDataFrame([(i - 9, x) for i, x in enumerate(head)], "line_no long, value string"))))
    raw = mapping.select(F.col("vid").alias("src"), F.col("id").alias("raw_src"))
    return _counted(found.edges).join(raw, "src").select("src", "dst", "raw_src", "mult")


def _rank_file(spark: SparkSession, d: str) -> DataFrame:
    """Ranks written as lines, another half of them appended, and read by their places."""
    found = solver.solve(graph.relabel(nations(spark, d))[0], max_iter=STEPS).ranks.select("id", F.round("pr", 9).alias("pr"))
    path = shared_dir(spark, "rank-lines")
    text.write_ranks(found, path)
    first = text.read_ranks(spark, path)
    return first.select("id", F.round("pr", 9).alias("pr"))


def _prepared_file(spark: SparkSession, d: str) -> DataFrame:
    path = text.prepared_name(shared_dir(spark, "graph") + ".txt")
    text.write_prepared(graph.relabel(nations(spark, d))[0], path)
    return _counted(text.read_edge_list(spark, path).graph.edges)


def _log_json(spark: SparkSession, d: str) -> DataFrame:
    """Both JSON files of a run's logs, one log file an event type, written and read again."""
    lines = spark.read.parquet(f"{d}/events.parquet").groupBy("event_type").agg(F.round(F.avg("value"), 6).alias("v"))
    found = lines.select(F.concat(F.col("event_type"), F.lit(".txt")).alias("file"), F.explode(F.array(F.concat(F.lit("run - time: "), F.col("v").cast("string")), F.concat(F.lit("TOTAL time: "), F.col("v").cast("string")))).alias("line"))
    folder = shared_dir(spark, "reports")
    logs.write_reports(logs.timings(found), folder)
    read = lambda name, kind: spark.read.text(f"{folder}/{name}").select(F.explode(F.from_json("value", f"map<string,{kind}>")).alias("key", "v"))
    summary = read("summary", "array<double>").select(F.lit("summary").alias("file"), "key", F.round(F.col("v")[0], 6).alias("mean"), F.round(F.col("v")[1], 6).alias("var"))
    return summary.unionByName(read("totals", "double").select(F.lit("totals").alias("file"), "key", F.col("v").alias("mean"), F.lit(None).cast("double").alias("var")))


def _repeated(spark: SparkSession, d: str) -> DataFrame:
    """Keys that a file has more or less than once: each event type is a file, and its users are keys."""
    made = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("file"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("key"), "value")
    return logs.repeated_keys(made)


def _norm(spark: SparkSession, d: str) -> DataFrame:
    """The change in the first step, as the norm of a difference."""
    g = custsupp(spark, d)
    a, b = (solver.solve(g, max_iter=k).ranks for k in (1, 2))
    return _rounded(compare.norm_difference(a, b), "norm")


def _inconsistent(spark: SparkSession, d: str) -> DataFrame:
    """Edges whose tail has no out-degree in the degrees of the reversed graph."""
    g = custsupp(spark, d)
    back = Graph(g.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), g.vertices)
    return graph.inconsistent_edges(g, graph.out_degrees(back)).agg(F.count("*").alias("n"))


def _plan(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    return compare.partition_plan(mixed(spark, d), PARTS).select(*columns)


SPMV = "select r \"row\", round(sum(w / n), 9) y from coo, nn group by r"
DENSE_NATION = "select r.vid src, s.vid dst, cast(count(*) as bigint) mult from e join vi r on r.id = e.src join vi s on s.id = e.dst group by 1, 2"
REJECTED = ", ".join(f"({i}::bigint, '{x}', '{'id out of range' if i < 2 else 'not two integers'}')" for i, x in enumerate(BAD_LINES))
RAW_NATION = DENSE_NATION.replace("s.vid dst,", "s.vid dst, r.id * 10 raw_src,").replace("group by 1, 2", "group by 1, 2, 3")
LOG = "with l as (select event_type || '{key}' || cast(value as varchar) line from events), t as (select regexp_replace(line, '\\s+\\S+$', '') key, cast(regexp_extract(line, '(\\S+)$', 1) as double) value from l where regexp_matches(line, '\\d+\\.\\d+$')) "

CATALOGUE: dict[str, tuple[Query, str]] = {
    "edge_multiplicity": (structure("nation", graph.multiplicity), on("nation", "select src, dst, cast(count(*) as bigint) mult from e group by 1, 2")),
    "graph_size": (structure("custsupp", graph.size), on("custsupp", "select (select count(*) from v) n, (select count(*) from e) m, (select max(id) from v) max_id")),
    "vertex_set": (structure("pages", lambda g: g.vertices), on("pages", "select id from v")),
    "self_loops": (structure("events", graph.self_loops), on("events", "select src id, cast(count(*) as bigint) loops from e where src = dst group by 1")),
    "relabel_map": (structure("custsupp", lambda g: graph.relabel(g)[1]), on("custsupp", "select id, vid from vi")),
    "relabel_edges": (structure("custsupp", lambda g: graph.relabel(g)[0].edges), on("custsupp", "select t.vid src, h.vid dst from e join vi t on t.id = e.src join vi h on h.id = e.dst")),
    "out_degree": (structure("custsupp", graph.out_degrees), on("custsupp", "select v.id, coalesce(od.d, 0) out_degree from v left join od on od.id = v.id")),
    "in_degree": (structure("custsupp", graph.in_degrees), on("custsupp", "select v.id, coalesce(idg.d, 0) in_degree from v left join idg on idg.id = v.id")),
    "leaves": (structure("mixed", graph.leaves), on("mixed", "select v.id from v left join od on od.id = v.id where od.id is null")),
    "source_only": (structure("mixed", graph.source_only), on("mixed", "select v.id from v left join idg on idg.id = v.id where idg.id is null")),
    "edge_reject": (_reject_query, on("mixed", "select t.vid src, h.vid dst from e join vi t on t.id = e.src join vi h on h.id = e.dst where not (t.vid between 0 and 499 and h.vid between 0 and 499)")),
    "in_degree_cdf": (layout(graph.in_degree_cdf), on("mixed", "select r id, cast(coalesce(sum(d) over (order by r rows between unbounded preceding and 1 preceding), 0) as bigint) cdf from rows_")),
    "adjacency_out": (structure("mixed", lambda g: graph.adjacency(g).select("id", _joined("neighbours").alias("neighbours"))), on("mixed", "select v.id, coalesce(string_agg(cast(dst as varchar), ',' order by dst), '') neighbours from v left join e on e.src = v.id group by v.id")),
    "adjacency_in": (structure("mixed", lambda g: graph.adjacency(g, True).select("id", _joined("neighbours").alias("neighbours"))), on("mixed", "select v.id, coalesce(string_agg(cast(src as varchar), ',' order by src), '') neighbours from v left join e on e.dst = v.id group by v.id")),
    "edge_sort_rank": (structure("mixed", graph.sorted_edges), on("mixed", "select src, dst, cast(row_number() over (order by dst, src) - 1 as bigint) place from e")),
    "coo": (layout(lambda g: _rounded(layouts.coo(g), "val")), on("mixed", "select r \"row\", c col, round(w, 9) val from coo")),
    "csr_rowptr": (layout(layouts.row_pointers), on("mixed", "select r \"row\", cast(coalesce(sum(d) over (order by r rows between unbounded preceding and 1 preceding), 0) as bigint) \"begin\" from rows_ union all select n, cast(sum(d) as bigint) from rows_ group by n")),
    "csr_rows": (
        layout(lambda g: layouts.csr(g).select("row", "begin", _joined("cols").alias("cols"), F.size("vals").cast("long").alias("n_vals"), F.round(F.reduce("vals", F.lit(0.0), lambda a, b: a + b), 9).alias("total"))),
        on("mixed", "select b.r \"row\", b.cdf \"begin\", coalesce(string_agg(cast(c as varchar), ',' order by c), '') cols, cast(count(c) as bigint) n_vals, round(coalesce(sum(w), 0), 9) total from (select r, cast(coalesce(sum(d) over (order by r rows between unbounded preceding and 1 preceding), 0) as bigint) cdf from rows_) b left join coo on coo.r = b.r group by b.r, b.cdf"),
    ),
    "csr_from_coo": (layout(lambda g: layouts.coo_to_csr(layouts.coo(g), layouts.row_lengths(g)).select("row", "begin", _joined("cols").alias("cols"))), on("mixed", "select b.r \"row\", b.cdf \"begin\", coalesce(string_agg(cast(c as varchar), ',' order by c), '') cols from (select r, cast(coalesce(sum(d) over (order by r rows between unbounded preceding and 1 preceding), 0) as bigint) cdf from rows_) b left join coo on coo.r = b.r group by b.r, b.cdf")),
    "ell_stats": (layout(layouts.ell_stats), on("mixed", "select max(n) num_rows, cast(sum(d) as bigint) nnz, max(d) width, max(n)*max(d) num_elements from rows_")),
    "ell_cells": (layout(lambda g: _rounded(layouts.ell(g), "val")), on("mixed", "select slot, r \"row\", c col, round(w, 9) val, slot * (select max(n) from rows_) + r place from coos")),
    "ell_from_csr": (layout(lambda g: _rounded(layouts.csr_to_ell(layouts.csr(g)), "val").select("slot", "row", "col", "val")), on("mixed", "select slot, r \"row\", c col, round(w, 9) val from coos")),
    "ell_padding": (layout(layouts.padding), on("mixed", "select slot, cast((select max(n) from rows_) - count(*) as bigint) padded from coos group by slot")),
    "jds_piece": (layout(lambda g: layouts.pieces(g, BINS).select("row", "len", "piece")), on("mixed", "select r \"row\", d len, piece from pieces")),
    "jds_stats": (layout(lambda g: layouts.jds_stats(g, BINS)), on("mixed", "select number piece, cast(count(*) as bigint) \"rows\", cast(sum(d) as bigint) nnz, max(width) width from pieces join numbered using (piece) group by number")),
    "jds_cells": (
        layout(lambda g: _rounded(layouts.jds(g, BINS), "val")),
        on("mixed", "select p.number piece, p.local_row, p.r \"row\", s.slot, s.c col, round(s.w, 9) val from (select number, r, cast(row_number() over (partition by number order by r) - 1 as bigint) local_row from pieces join numbered using (piece)) p join coos s on s.r = p.r"),
    ),
    "csr_to_coo": (layout(lambda g: _rounded(layouts.csr_to_coo(layouts.csr(g)), "val")), on("mixed", "select r \"row\", c col, round(w, 9) val from coo")),
    "expand_out_degrees": (structure("mixed", graph.with_out_degrees), on("mixed", "select e.src, e.dst, od.d od from e join od on od.id = e.src")),
    "leaked_mass": (structure("mixed", lambda g: _rounded(steps.leaked_mass(steps.uniform(g, g.vertices.count())), "leak")), on("mixed", "select round(l, 9) leak from lk")),
    "base_score": (_first_base, on("mixed", "select round((l + (1 - l) * (1 - 0.85)) / n, 9) base from lk, nn")),
    "spmv": (_spmv_query(layouts.coo), on("mixed", SPMV)),
    "spmv_csr": (_spmv_query(None), on("mixed", "select rows_.r \"row\", round(coalesce(y, 0), 9) y from rows_ left join (select r, sum(w / n) y from coo, nn group by r) s on s.r = rows_.r")),
    "spmv_ell": (_spmv_query(layouts.ell), on("mixed", SPMV)),
    "spmv_jds": (_spmv_query(lambda g: layouts.jds(g, BINS)), on("mixed", SPMV)),
    "affine_fix": (_affine_query, on("mixed", "select rows_.r \"row\", round(0.85 * coalesce(s.y, 0) + (1 - 0.85) / nn.n, 9) y from rows_ left join (select r, sum(w / n) y from coo, nn group by r) s on s.r = rows_.r, nn")),
    "pull_step": (_step_query, on("mixed", "select x0.id, round((l + (1 - l) * (1 - 0.85)) / n + 0.85 * coalesce(s, 0), 9) pr from x0 left join inflow on inflow.id = x0.id, lk, nn")),
    "push_step": (_push_query, on("mixed", "select x0.id, round((l + (1 - l) * (1 - 0.85)) / n + 0.85 * coalesce(s, 0), 9) pr from x0 left join inflow on inflow.id = x0.id, lk, nn")),
    **{f"rank_{name}_k20": (ranks(name), on(name, f"select id, round(pr, 9) pr from r where it = {STEPS}", loop(STEPS))) for name in GRAPHS},
    **{f"rank_{name}_k20_local": (ranks(name, backend="local"), on(name, f"select id, round(pr, 9) pr from r where it = {STEPS}", loop(STEPS))) for name in ("custsupp", "events")},
    "rank_normalized_k20": (ranks("mixed", dangling="normalize"), on("mixed", f"select id, round(pr / sum(pr) over (), 9) pr from r where it = {STEPS}", loop(STEPS, leak=False))),
    "rank_converged": (ranks("mixed", max_iter=None, tol=TOLERANCE), on("mixed", f"select id, round(pr, 9) pr from r where it = (select min(it) from tr where nrm <= {TOLERANCE})", loop(80) + ",\n" + NORMS)),
    "convergence_trace": (_trace, on("mixed", "select it, round(nrm, 9) nrm from tr", loop(STEPS) + ",\n" + NORMS)),
    "rank_dedup_k20": (ranks("nation", dedupe=True), on("nation", f"select id, round(pr, 9) pr from r where it = {STEPS}", loop(STEPS), source=f"select distinct src, dst from ({GRAPHS['nation'][1]})")),
    "variant_diff": (lambda spark, d: _variants(spark, d, False), "select cast(0 as bigint) n"),
    "variant_diff_rows": (lambda spark, d: _variants(spark, d, True), "select cast(0 as bigint) id, cast(0 as double) a, cast(0 as double) b where false"),
    "top_ranked": (lambda spark, d: solver.top(ranks("custsupp")(spark, d), 10), on("custsupp", f"select id, round(pr, 9) pr from r where it = {STEPS} order by 2 desc, id limit 10", loop(STEPS))),
    "rank_lines": (_lines, on("nation", f"select id, printf('%.12f', round(pr, 9)) line from r where it = {STEPS}", loop(STEPS))),
    "partition_plan": (lambda spark, d: _plan(spark, d, ["part", "first_id", "nodes"]), on("mixed", "select cast(floor(((r+1)*4-1)/n) as bigint) part, min(r) first_id, cast(count(*) as bigint) nodes from rows_ group by 1")),
    "partition_load": (lambda spark, d: _plan(spark, d, ["part", "nodes", "edges"]), on("mixed", "select cast(floor(((r+1)*4-1)/n) as bigint) part, cast(count(*) as bigint) nodes, cast(sum(d) as bigint) edges from rows_ group by 1")),
    "log_summary": (lambda spark, d: _rounded(logs.summary(_log_lines(spark, d, " run - time: ")), "mean", "var"), LOG.format(key=" run - time: ") + "select key, round(avg(value), 9) mean, round(var_pop(value), 9) var from t group by key"),
    "log_totals": (lambda spark, d: logs.totals(_log_lines(spark, d, " TOTAL time: ")), LOG.format(key=" TOTAL time: ") + "select key, round(avg(value), 3) mean from t where contains(key, 'TOTAL') group by key"),
    "edge_list_parse": (_edge_file, on("nation", DENSE_NATION)),
    "edge_list_rejects": (lambda spark, d: _edge_file(spark, d, True), f"select * from (values {REJECTED}) as t(number, value, reason)"),
    "edge_list_facts": (_file_facts, on("nation", "select (select count(*) from v) n, (select count(*) from v) header_n, (select count(*) from e) header_m, cast(0 as bigint) mismatch")),
    "raw_graph_file": (lambda spark, d: _raw_file(spark, d, False), on("nation", RAW_NATION)),
    "pajek_parse": (lambda spark, d: _raw_file(spark, d, True), on("nation", RAW_NATION)),
    "prepared_file": (_prepared_file, on("nation", DENSE_NATION)),
    "rank_file": (_rank_file, on("nation", f"select vid id, round(pr, 9) pr from r join vi using (id) where it = {STEPS}", loop(STEPS))),
    "coo_from_file": (_file_layout(lambda g: _rounded(layouts.coo(g), "val")), on("nation", "select r \"row\", c col, round(w, 9) val from coo")),
    "csr_from_file": (_file_layout(lambda g: layouts.csr(g).select("row", "begin", F.size("cols").cast("long").alias("n_cols"))), on("nation", "select r \"row\", cast(coalesce(sum(d) over (order by r rows between unbounded preceding and 1 preceding), 0) as bigint) \"begin\", d n_cols from rows_")),
    "ell_from_file": (_file_layout(lambda g: _rounded(layouts.ell(g), "val")), on("nation", "select slot, r \"row\", c col, round(w, 9) val, slot * (select max(n) from rows_) + r place from coos")),
    "jds_from_file": (_file_layout(lambda g: _rounded(layouts.jds(g, BINS), "val").groupBy("piece", "local_row", "row").agg(F.count("*").alias("cells"), F.max("slot").alias("last"))), on("nation", "select number piece, cast(row_number() over (partition by number order by r) - 1 as bigint) local_row, r \"row\", d cells, d - 1 \"last\" from pieces join numbered using (piece)")),
    "log_json": (_log_json, "with l as (select round(avg(value), 6) v from events group by event_type) select 'summary' file, k key, round(avg(v), 6) mean, round(var_pop(v), 6) var from l, (values ('run - time:'), ('TOTAL time:')) t(k) group by k union all select 'totals', 'TOTAL time:', round(avg(v), 3), null from l"),
    "log_repeated_keys": (_repeated, "select 'user ' || user_id key, cast(count(*) as bigint) times from events group by user_id having count(*) <> (select count(distinct event_type) from events)"),
    "norm_difference": (_norm, on("custsupp", "select round(nrm, 9) norm from tr where it = 2", loop(2) + ",\n" + NORMS)),
    "inconsistent_edges": (_inconsistent, on("custsupp", "select count(*) n from e where src not in (select dst from e)")),
    "undirected_degree": (structure("events", lambda g: graph.out_degrees(g.undirected())), on("events", "select v.id, cast(coalesce(sum(d), 0) as bigint) out_degree from v left join (select src id, count(*) d from e group by src union all select dst, count(*) from e where src <> dst group by dst) using (id) group by v.id")),
    "rank_push_stopped": (ranks("events", variant="push"), on("events", f"select id, round(pr, 9) pr from r where it = (select min(it) from tr where nrm <= {TOLERANCE})", loop(101) + ",\n" + NORMS)),
    **{f"rank_{name}_k20": (ranks("custsupp", variant=name), on("custsupp", f"select id, round(pr / sum(pr) over (), 9) pr from r where it = {STEPS}", loop(STEPS, leak=False))) for name in ("csr_vector", "ell", "jds")},
}


def queries() -> dict[str, Query]:
    return {name: q for name, (q, _) in CATALOGUE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in CATALOGUE.items()}
