"""Hand-sized graphs: degrees, layouts and the defects that these operators must not have."""

import itertools

import pytest
from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rankloom.functions import bin_of
from rankloom.operators import compare, graph, layouts, logs
from rankloom.operators.graph import Graph
from rankloom.operators.ordered import dense_number, running_sum

GRAPHS = {
    "T1": (3, [(0, 1), (1, 2), (2, 0)]),
    "T2": (3, [(0, 1), (0, 2), (1, 2)]),
    "T3": (3, [(0, 1), (0, 1), (0, 2), (1, 0), (2, 0)]),
    "T4": (2, [(0, 0), (0, 1), (1, 0)]),
    "T5": (5, [(3, 0), (4, 1), (3, 1)]),
    "T6": (3, [(0, 1), (1, 0)]),
    "T7": (4, [(0, 2), (1, 2), (2, 3), (3, 3)]),
}


def make(spark, n, edges):
    return Graph.of(spark.createDataFrame(edges, "src long, dst long"), spark.range(n))


def test_degrees_leaves_and_sources(spark):
    g = make(spark, *GRAPHS["T2"])
    assert rows(graph.out_degrees(g)) == [(0, 2), (1, 1), (2, 0)]
    assert rows(graph.in_degrees(g)) == [(0, 0), (1, 1), (2, 2)]
    assert rows(graph.leaves(g)) == [(2,)]
    assert rows(graph.source_only(g)) == [(0,)]
    assert rows(graph.size(g)) == [(3, 3, 2)]
    assert graph.inconsistent(g, graph.out_degrees(g)) == 0
    assert graph.inconsistent(g, graph.out_degrees(g).where("id <> 0")) == 2


def test_repeated_edges_loops_and_both_ways(spark):
    g = make(spark, *GRAPHS["T3"])
    assert rows(graph.multiplicity(g))[0] == (0, 1, 2)
    assert g.deduplicated().edges.count() == 4
    loops = make(spark, *GRAPHS["T4"])
    assert rows(graph.self_loops(loops)) == [(0, 1)]
    assert rows(loops.undirected().edges) == [(0, 0), (0, 1), (0, 1), (1, 0), (1, 0)]


def test_id_n_is_out_of_range(spark):
    edges = spark.createDataFrame([(0, 3), (3, 0), (-1, 0), (0, 2)], "src long, dst long")
    assert graph.out_of_range(edges, 3).count() == 3
    assert rows(graph.in_range(edges, 3)) == [(0, 2)]


@pytest.mark.parametrize(("name", "pointers"), [("T5", [0, 1, 3, 3, 3, 3]), ("T7", [0, 0, 0, 2, 4])])
def test_row_pointers_cover_empty_rows(spark, name, pointers):
    g = make(spark, *GRAPHS[name])
    assert [r.begin for r in layouts.row_pointers(g).orderBy("row").collect()] == pointers


@pytest.mark.parametrize("name", GRAPHS)
def test_layouts_hold_the_same_entries(spark, name):
    g = make(spark, *GRAPHS[name])
    want = rows(layouts.coo(g))
    assert rows(layouts.csr_to_coo(layouts.csr(g)), "row", "col", "val") == want
    assert rows(layouts.ell(g).where("val > 0"), "row", "col", "val") == want
    assert rows(layouts.csr_to_ell(layouts.csr(g))) == rows(layouts.ell(g))
    stats = layouts.ell_stats(g).first()
    full = layouts.padded(layouts.ell(g), g.vertices.select(F.col("id").alias("row")))
    assert full.count() == (stats.num_elements or 0)
    assert rows(full.where("val > 0"), "row", "col", "val") == want
    assert sum(r.padded for r in layouts.padding(g).collect()) == (stats.num_elements or 0) - len(want)
    for pieces in (1, 3, 8):
        cells = layouts.jds(g, pieces)
        assert rows(cells.where("val > 0"), "row", "col", "val") == want
        stats = layouts.jds_stats(g, pieces).collect()
        assert sum(r.nnz for r in stats) == len(want)
        assert sorted(r.piece for r in stats) == list(range(len(stats)))
        assert cells.count() == len(want) <= sum(r.rows * r.width for r in stats)
        assert all(r.slot < {x.piece: x.width for x in stats}[r.piece] for r in cells.collect())


def test_empty_graph(spark):
    g = make(spark, 0, [])
    assert graph.size(g).first().n == 0
    assert rows(layouts.row_pointers(g)) == [(0, 0)]
    for made in (layouts.ell(g), layouts.jds(g, 3), layouts.csr(g), graph.adjacency(g), graph.in_degree_cdf(g), compare.partition_plan(g, 3)):
        assert made.count() == 0


def test_bins_follow_their_borders(spark):
    got = spark.range(1, 11).select("id", bin_of(graph.F.col("id") - 1, 3, graph.F.lit(10)).alias("p"))
    assert [r.p for r in got.orderBy("id").collect()] == [0, 0, 0, 1, 1, 1, 2, 2, 2, 2]
    for width, bins in itertools.product((1, 2, 5, 7), (1, 2, 3, 8)):
        got = spark.range(width).select("id", bin_of(graph.F.col("id"), bins, graph.F.lit(width)).alias("p"))
        for r in got.collect():
            assert r.p * width // bins <= r.id < (r.p + 1) * width // bins


def test_adjacency_and_relabel(spark):
    g = Graph.of(spark.createDataFrame([(70, 5), (5, 900), (70, 900), (70, 900)], "src long, dst long"))
    dense, mapping = graph.relabel(g)
    assert rows(mapping) == [(5, 0), (70, 1), (900, 2)]
    assert rows(dense.edges) == [(0, 2), (1, 0), (1, 2), (1, 2)]
    assert rows(graph.adjacency(dense)) == [(0, [2]), (1, [0, 2, 2]), (2, [])]
    assert rows(graph.adjacency(dense, inward=True)) == [(0, [1]), (1, []), (2, [0, 1, 1])]
    assert [r.place for r in graph.sorted_edges(dense).orderBy("dst", "src").collect()] == [0, 1, 2, 3]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-50, 50), max_size=40))
def test_running_sums(spark, values):
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "v long, i long")
    got = [r.s for r in running_sum(df, ["v", "i"], "v", "s").orderBy("v", "i").collect()]
    want = [0, *itertools.accumulate(sorted(values))][:-1] if values else []
    assert got == want
    assert [r.n for r in dense_number(df, ["v", "i"], "n").orderBy("v", "i").collect()] == list(range(len(values)))


def test_partition_plan_covers_all(spark):
    g = make(spark, *GRAPHS["T5"])
    assert rows(compare.partition_plan(g, 2)) == [(0, 0, 2, 3), (1, 2, 3, 0)]


def test_log_lines(spark):
    lines = [("a", "step one: 0.5"), ("b", "step  one: 1.5"), ("a", "TOTAL x: 2.00049"), ("b", "TOTAL x: 2.0"), ("a", "no number: 0.5."), ("a", "whole: 7"), ("b", "")]
    found = logs.timings(spark.createDataFrame(lines, "file string, line string"))
    assert rows(logs.summary(found)) == [("TOTAL x:", 2.000245, pytest.approx(6.0025e-08)), ("step one:", 1.0, 0.25)]
    assert rows(logs.totals(found)) == [("TOTAL x:", 2.0)]
    assert logs.repeated_keys(found).count() == 0
    assert logs.to_json(logs.totals(found)).first().json == '{"TOTAL x:":2.0}'


def test_comparison_flags_what_is_missing(spark):
    a = spark.createDataFrame([(0, 0.5), (1, 0.5)], "id long, pr double")
    b = spark.createDataFrame([(0, 0.5), (1, 0.4), (2, 0.1)], "id long, pr double")
    assert [r[0] for r in rows(compare.differing(a, b))] == [1, 2]
    with pytest.raises(AssertionError):
        compare.assert_same(a, b)
    compare.assert_same(a, a)
    assert compare.norm_difference(a, b).first().norm == pytest.approx(0.1)
