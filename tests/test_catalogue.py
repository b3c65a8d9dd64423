"""Each registered query of the library's own against its SQL."""

import pytest

from rankloom.plans import catalogue

SLOW = {"variant_diff", "variant_diff_rows"}


@pytest.mark.parametrize("name", sorted(set(catalogue.CATALOGUE) - SLOW))
def test_same_rows_as_sql(spark, sf, duck, name):
    query, sql = catalogue.CATALOGUE[name]
    df = query(spark, sf)
    found = duck.execute(sql)
    columns = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(range(len(columns)), key=columns.__getitem__)
    want = sorted([tuple(r[i] for i in order) for r in found.fetchall()], key=str)
    assert sorted([tuple(r[c] for c in sorted(columns)) for r in df.collect()], key=str) == want


#: Queries that write an edge list with a header and read it again.
FILES = ["coo_from_file", "ell_from_file", "edge_list_parse", "edge_list_rejects", "prepared_file", "jds_from_file", "csr_from_file", "edge_list_facts"]


@pytest.mark.parametrize("name", FILES)
def test_same_rows_from_several_files(spark, sf, duck, name):
    """Small graphs are written as one file; of a large one's files the first isn't the largest."""
    options = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in options}
    for k, v in options.items():
        spark.conf.set(k, v)
    try:
        test_same_rows_as_sql(spark, sf, duck, name)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(catalogue.CATALOGUE) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 160
