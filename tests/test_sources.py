"""Text files: edge lists, raw and Pajek graphs, rank files, and an edge stream."""

import json

import pytest
from conftest import rows

from rankloom.operators import logs
from rankloom.operators.graph import Graph
from rankloom.sources import edges as text
from rankloom.streaming import streaming_degrees, streaming_multiplicity


def put(path, content):
    path.write_text(content)
    return str(path)


def test_edge_list_with_bad_lines(spark, tmp_path):
    f = put(tmp_path / "g.txt", "4\t9\n0\t1\n1 2 0.5\n\n4\t0\n-1\t2\n3\tx\n3\t3\n1\t99999999999999999999\n")
    got = text.read_edge_list(spark, f)
    assert (got.n, got.declared_edges) == (4, 9)
    assert rows(got.graph.edges) == [(0, 1), (1, 2), (3, 3)]
    assert got.graph.vertices.count() == 4
    assert got.header_mismatch() == 6
    assert rows(got.rejects) == [(4, "4\t0", "id out of range"), (5, "-1\t2", "id out of range"), (6, "3\tx", "not two integers"), (8, "1\t99999999999999999999", "not two integers")]


def test_more_lines_than_declared(spark, tmp_path):
    got = text.read_edge_list(spark, put(tmp_path / "g.txt", "2\t1\n0\t1\n1\t0\n"))
    assert got.graph.edges.count() == 2
    assert got.header_mismatch() == -1


def test_header_must_be_numbers(spark, tmp_path):
    with pytest.raises(ValueError, match="first line"):
        text.header(spark, put(tmp_path / "g.txt", "a b\n"))


def test_header_is_the_first_file_s_though_a_later_one_is_larger(spark, tmp_path):
    (tmp_path / "g").mkdir()
    for name, content in (("part-00000", "3\t5\n0\t1\n"), ("part-00001", "1\t2\n1\t2\n2\t0\n"), ("part-00002", "2\t1\n")):
        put(tmp_path / "g" / name, content)
    assert text.header(spark, str(tmp_path / "g")) == (3, 5)
    got = text.read_edge_list(spark, str(tmp_path / "g"))
    assert rows(got.graph.edges) == [(0, 1), (1, 2), (1, 2), (2, 0), (2, 1)]
    assert (got.graph.vertices.count(), got.rejects.count(), got.header_mismatch()) == (3, 0, 0)


def test_raw_graph_with_comments(spark, tmp_path):
    g, mapping, rejects = text.read_raw_graph(spark, put(tmp_path / "g.txt", "# c\n10 30\n30\t20 7\n# d\n10 30\n"))
    assert rows(mapping) == [(10, 0), (20, 1), (30, 2)]
    assert rows(g.edges) == [(0, 2), (0, 2), (2, 1)]
    assert rejects.count() == 0


def test_ids_beyond_64_bits_are_rejects(spark, tmp_path):
    g, mapping, rejects = text.read_raw_graph(spark, put(tmp_path / "g.txt", "10 30\n99999999999999999999 10\n"))
    assert rows(mapping) == [(10, 0), (30, 1)]
    assert rows(g.edges) == [(0, 1)]
    assert rows(rejects, "line_no") == [(1,)]


def test_pajek_sections(spark, tmp_path):
    f = put(tmp_path / "g.net", '*Vertices 3\n1 "a"\n2 "b"\n9 "c"\n*Arcs\n1 2\n2 1\n')
    g, _, _ = text.read_raw_graph(spark, f)
    assert (g.vertices.count(), rows(g.edges)) == (2, [(0, 1), (1, 0)])
    g, mapping, _ = text.read_raw_graph(spark, f, keep_isolated=True)
    assert rows(mapping) == [(1, 0), (2, 1), (9, 2)]


def test_prepared_graph_reads_back(spark, tmp_path):
    g = Graph.of(spark.createDataFrame([(0, 1), (2, 0), (0, 1)], "src long, dst long"))
    text.write_prepared(g, str(tmp_path / "out"))
    got = text.read_edge_list(spark, str(tmp_path / "out"))
    assert rows(got.graph.edges) == rows(g.edges)
    assert got.header_mismatch() == 0
    assert text.prepared_name("a.b.txt") == "a.b_out.txt"


def test_rank_file_appends(spark, tmp_path):
    ranks = spark.createDataFrame([(1, 0.25), (0, 0.75)], "id long, pr double")
    text.write_ranks(ranks, str(tmp_path / "r"))
    assert rows(text.read_ranks(spark, str(tmp_path / "r"))) == [(0, 0.75), (1, 0.25)]
    text.write_ranks(ranks, str(tmp_path / "r"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "r")).collect()) == ["0.250000000000"] * 2 + ["0.750000000000"] * 2


def test_logs(spark, tmp_path):
    put(tmp_path / "a.txt", "x: 1.5\n")
    assert [r.line for r in text.read_logs(spark, str(tmp_path / "*.txt")).collect()] == ["x: 1.5"]


def test_edge_stream(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 2), (1, 2)], "src long, dst long").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "e"))
    query = streaming_degrees(stream).writeStream.format("memory").queryName("degrees").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("degrees")) == [(0, 2, 0), (1, 1, 1), (2, 0, 2)]


def test_edge_stream_multiplicity(spark, tmp_path):
    spark.createDataFrame([(0, 1), (0, 1), (1, 2)], "src long, dst long").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("src long, dst long").parquet(str(tmp_path / "e"))
    query = streaming_multiplicity(stream).writeStream.format("memory").queryName("mult").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert rows(spark.table("mult")) == [(0, 1, 2), (1, 2, 1)]


def test_reports_are_two_files_and_keys_are_there_once(spark, tmp_path):
    found = spark.createDataFrame([("a", "x", 1.0), ("b", "x", 2.0), ("a", "TOTAL t", 0.5), ("b", "TOTAL t", 0.25)], "file string, key string, value double")
    logs.write_reports(found, str(tmp_path / "out"))
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/summary")).collect()] == [{"x": [1.5, 0.25], "TOTAL t": [0.375, 0.015625]}]
    assert [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out/totals")).collect()] == [{"TOTAL t": 0.375}]
    with pytest.raises(ValueError, match="x"):
        logs.write_reports(found.where("not (file = 'b' and key = 'x')"), str(tmp_path / "again"))
