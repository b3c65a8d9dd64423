"""The fixpoint on hand-sized graphs, in both backends, and its stopping rules."""

import pytest
from conftest import rows
from test_graph import GRAPHS, make

from rankloom.operators.compare import assert_same
from rankloom.plans import steps
from rankloom.plans.solver import PRESETS, solve, top

#: Ranks after one and two steps and in the limit.
EXPECTED = {
    "T1": ([1 / 3] * 3, [1 / 3] * 3, [1 / 3] * 3, 1),
    "T2": ([0.144444444, 0.286111111, 0.569444444], [0.211342593, 0.272731481, 0.515925926], [0.197579649, 0.281551, 0.52086935], 14),
    "T3": ([0.616666667, 0.238888889, 0.144444444], [0.375833333, 0.399444444, 0.224722222], [0.486486486, 0.325675676, 0.187837838], 90),
    "T4": ([0.7125, 0.2875], [0.6221875, 0.3778125], [0.649122807, 0.350877193], 18),
    "T5": ([0.217, 0.387, 0.132, 0.132, 0.132], [0.21122, 0.32342, 0.15512, 0.15512, 0.15512], [0.212686567, 0.339552239, 0.149253731, 0.149253731, 0.149253731], 14),
    "T6": ([0.427777778, 0.427777778, 0.144444444], [0.454537037, 0.454537037, 0.090925926], [0.465116279, 0.465116279, 0.069767442], 13),
}


def vector(found):
    return [r.pr for r in found.ranks.orderBy("id").collect()]


@pytest.mark.parametrize("name", EXPECTED)
def test_known_vectors(spark, name):
    g = make(spark, *GRAPHS[name])
    one, two, limit, n_steps = EXPECTED[name]
    assert vector(solve(g, max_iter=1)) == pytest.approx(one, abs=1e-9)
    assert vector(solve(g, max_iter=2)) == pytest.approx(two, abs=1e-9)
    assert vector(solve(g, max_iter=300, backend="local")) == pytest.approx(limit, abs=1e-9)
    assert vector(solve(g, max_iter=300, dangling="normalize", backend="local")) == pytest.approx(limit, abs=1e-9)
    assert solve(g, tol=2e-7, backend="local").iterations == n_steps
    assert [r.pr for r in steps.one_step(g).orderBy("id").collect()] == pytest.approx(one, abs=1e-9)


@pytest.mark.parametrize(("name", "options"), [("T3", {}), ("T5", {"dangling": "normalize"}), ("T3", {"dedupe": True})])
def test_backends_agree(spark, name, options):
    g = make(spark, *GRAPHS[name])
    a = solve(g, max_iter=3, backend="local", **options)
    b = solve(g, max_iter=3, backend="distributed", **options)
    assert_same(a.ranks, b.ranks, 1e-12)
    assert a.norms == pytest.approx(b.norms, abs=1e-12)
    assert rows(a.trace(), "it") == [(1,), (2,), (3,)]
    for block in (1, 2, 7):
        c = solve(g, max_iter=3, block=block, **options)
        assert_same(a.ranks, c.ranks, 1e-12)
        assert a.norms == pytest.approx(c.norms, abs=1e-12)


@pytest.mark.parametrize("layout", ["coo", "csr", "ell", "jds"])
def test_layouts_give_the_same_ranks(spark, layout):
    for name in ("T3", "T5"):
        g = make(spark, *GRAPHS[name])
        assert_same(solve(g, max_iter=4).ranks, solve(g, max_iter=4, layout=layout).ranks, 1e-12)


def test_a_hub_is_dealt_to_several(spark):
    edges = [(0, i) for i in range(1, 3001)] + [(i, 0) for i in range(1, 2000)] + [(i, i + 1) for i in range(1, 50)]
    g = make(spark, 3001, edges)
    a, b = solve(g, max_iter=4, backend="local"), solve(g, max_iter=4)
    assert_same(a.ranks, b.ranks, 1e-12)
    assert a.norms == pytest.approx(b.norms, abs=1e-12)


def test_mass_is_kept_and_all_get_the_base(spark):
    g = make(spark, *GRAPHS["T5"])
    pr = vector(solve(g, max_iter=7))
    assert sum(pr) == pytest.approx(1, abs=1e-12)
    assert min(pr) >= 0.15 / 5 - 1e-12


def test_duplicates_count_unless_told(spark):
    g = make(spark, *GRAPHS["T3"])
    assert vector(solve(g, max_iter=300, dedupe=True, backend="local")) == pytest.approx([0.486486486, 0.256756757, 0.256756757], abs=1e-9)


def test_presets_stop_where_they_should(spark):
    g = make(spark, *GRAPHS["T2"])
    for name, p in PRESETS.items():
        got = solve(g, name, backend="local").iterations
        assert got == (14 if "tol" in p else p["max_iter"])


def test_distributed_stops_where_local_does(spark):
    g = make(spark, *GRAPHS["T2"])
    a, b = solve(g, "push", backend="local"), solve(g, "push")
    assert a.iterations == b.iterations == 14
    assert a.norms == pytest.approx(b.norms, abs=1e-12)
    assert_same(a.ranks, b.ranks, 1e-12)


def test_options_are_checked(spark):
    g = make(spark, *GRAPHS["T1"])
    with pytest.raises(ValueError, match="max_iter or tol"):
        solve(g)
    with pytest.raises(ValueError, match="dangling"):
        solve(g, max_iter=1, dangling="no")


def test_empty_graph_has_no_ranks(spark):
    g = make(spark, 0, [])
    for backend in ("local", "distributed"):
        assert solve(g, max_iter=2, backend=backend).ranks.count() == 0


def test_ties_go_by_id(spark):
    g = make(spark, *GRAPHS["T1"])
    assert [r.id for r in top(solve(g, max_iter=2).ranks, 2).collect()] == [0, 1]
