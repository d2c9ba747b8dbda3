"""Counting and rule properties on the sf0.001 fixture and on hand-made baskets."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.helpers import tables
from trolley import queries as Q
from trolley.config import DEFAULT
from trolley.operators import mining as M
from trolley.plans.market_basket import BasketRun


@pytest.fixture(scope="module")
def run(spark):
    return Q.run(spark, SF_SMALL)


def test_item_freq_sums_to_basket_sizes(run):
    total = run.item_freq.agg(F.sum("freq")).first()[0]
    assert total == run.baskets.agg(F.sum("size")).first()[0]


def test_pair_freq_sums_to_pairs_in_baskets_without_support(spark):
    r = Q.run(spark, SF_SMALL, DEFAULT.with_(support_item=0.0))
    total = r.pair_freq.agg(F.sum("freq")).first()[0]
    want = r.baskets.agg(F.sum(F.col("size") * (F.col("size") - 1) / 2)).first()[0]
    assert total == want


def test_pair_freq_bounded_by_item_freq(run):
    f = {r.item: r.freq for r in run.item_freq.collect()}
    for r in run.pair_freq.collect():
        assert r.a < r.b
        assert 0 < r.freq <= min(f[r.a], f[r.b])


def test_lift_is_symmetric(run):
    lift = {(r.a, r.b): r.lift for r in run.rules.collect()}
    for (a, b), v in lift.items():
        assert math.isclose(v, lift[(b, a)], rel_tol=1e-12)


def test_rules_against_formula(spark):
    baskets = [["a", "b"], ["a", "b", "c"], ["a", "c"], ["b", "c"], ["a", "b"]]
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    t = tables(spark, lines)
    cfg = DEFAULT.with_(taxo=False, support_item=0.0, smooth_k=0.5)
    r = BasketRun(spark, t, cfg, materialize=False)
    n, k = len(baskets), 0.5
    freq = {x: sum(x in b for b in baskets) for x in "abc"}
    pairs = {(x, y): sum(x in b and y in b for b in baskets) for x, y in combinations("abc", 2)}
    p_item = {x: (f + k) / (n + k * len(freq)) for x, f in freq.items()}
    p_pair = {xy: (f + k) / (n + k * len(pairs)) for xy, f in pairs.items()}
    got = {(x.a, x.b): (x.confidence, x.lift) for x in r.rules.collect()}
    for (x, y), p in p_pair.items():
        assert math.isclose(got[(x, y)][0], p / p_item[y])
        assert math.isclose(got[(y, x)][0], p / p_item[x])
        assert math.isclose(got[(x, y)][1], p / p_item[y] / p_item[x])


def test_thresholds_are_strict(spark):
    baskets = [["a", "b"]] * 2 + [["a", "c"]] * 2
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    t = tables(spark, lines)
    # b and c sit exactly at 0.5 * 4 = 2 baskets: not frequent (strict >)
    r = BasketRun(spark, t, DEFAULT.with_(taxo=False, support_item=0.5), materialize=False)
    assert sorted(x.item for x in r.frequent.collect()) == ["a"]


def test_candidate_pairs_count(run):
    row = M.candidate_pairs(run.frequent).first()
    assert row.candidate_pairs == row.frequent_items * (row.frequent_items - 1) // 2


def test_subsets_count(spark):
    t = tables(spark, [(1, 1, x, 1.0) for x in "abcd"])
    r = BasketRun(spark, t, DEFAULT.with_(taxo=False, support_item=0.0), materialize=False)
    got = M.basket_subsets(r.baskets, 6).collect()
    assert len(got) == 2**4 - 1
    assert all(g.freq == 1 and g.subset == sorted(g.subset) for g in got)
    # longer than len_max: the basket alone
    got3 = M.basket_subsets(r.baskets, 3).collect()
    assert [g.subset for g in got3] == [["a", "b", "c", "d"]]


def test_interaction_median_even_and_odd(spark):
    pairs = spark.createDataFrame(
        [("a", "b", 1), ("a", "c", 4), ("a", "d", 10), ("e", "f", 3), ("e", "g", 8)],
        "a string, b string, freq long",
    )
    names = spark.createDataFrame([("a", "A")], "item string, name string")
    got = {r.item: r for r in M.item_interaction(pairs, F.lit(10), names, 0.0, 2).collect()}
    assert got["a"].median == 4.0 and got["a"].n == 3 and got["a"].list == "10 4"
    assert got["e"].median == 5.5 and got["e"].name is None
    assert math.isclose(got["a"].stddev, math.sqrt(((1 - 5) ** 2 + (4 - 5) ** 2 + (10 - 5) ** 2) / 3))


def test_no_broadcast_hints(run):
    pairs = M.pair_freq(run.baskets, run.frequent, run.cfg)
    rules = M.association_rules(run.pair_prob_smoothed, run.frequent_prob, run.cfg)
    for df in (pairs, rules):
        assert "strategy=broadcast" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_pair_plan_has_no_cartesian(run):
    plan = M.pair_freq(run.baskets, run.frequent, run.cfg)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("support", [0.0, 0.3])
def test_pair_freq_long_baskets_in_chunks(spark, support):
    import string

    long1 = list(string.ascii_lowercase[:11])  # 11 items: chunks of 3 anchors
    baskets = [long1, ["a", "b"], ["b", "c", "d"], long1[3:], ["a", "k"], ["z", "a"]]
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    cfg = DEFAULT.with_(taxo=False, cartsize_max=None, support_item=support)
    run = BasketRun(spark, tables(spark, lines), cfg, materialize=False)
    got = {(r.a, r.b): r.freq for r in M.pair_freq(run.baskets, run.frequent, cfg, chunk=3).collect()}
    n = len(baskets)
    freq = {}
    for b in baskets:
        for x in set(b):
            freq[x] = freq.get(x, 0) + 1
    frequent = {x for x, f in freq.items() if f > support * n}
    want = {}
    for b in baskets:
        for p in combinations(sorted(set(b) & frequent), 2):
            want[p] = want.get(p, 0) + 1
    assert got == want


def test_frequent_subsets_count_every_basket(spark):
    long = list("abcdefg")
    data = [long, ["a", "b"], ["b", "c"], ["a", "b", "c"], ["z", "y"]]
    lines = [(1, r, i, 1.0) for r, items in enumerate(data) for i in items]
    run = BasketRun(spark, tables(spark, lines), DEFAULT.with_(taxo=False, cartsize_max=None), materialize=False)
    got = {tuple(r.subset): r.freq for r in run.frequent_subsets(0.2, 3).collect()}
    want = {}
    for items in data:
        for n in (1, 2, 3):
            for c in combinations(sorted(items), n):
                want[c] = want.get(c, 0) + 1
    assert got == {c: f for c, f in want.items() if f > 0.2 * len(data)}
    assert got[("a", "b")] == 3 and got[("a", "b", "c")] == 2


def test_interaction_list_is_whole_by_default(spark):
    lines = [(1, r, i, 1.0) for r, i in ((0, "a"), (0, "b"), (0, "c"), (0, "d"), (1, "a"), (1, "b"))]
    run = BasketRun(spark, tables(spark, lines), DEFAULT.with_(taxo=False), materialize=False)
    names = spark.createDataFrame([("a", "A")], "item string, name string")
    whole = {r.item: r.list for r in M.item_interaction(run.pair_freq, run.n_baskets, names).collect()}
    cut = {r.item: r.list for r in M.item_interaction(run.pair_freq, run.n_baskets, names, list_max=1).collect()}
    assert (whole["a"], cut["a"]) == ("2 1 1", "2")


def test_only_candidates_are_staged(spark):
    """A set is written only if each of its subsets one smaller is supported; results equal enumeration up to five items."""
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(7)
    baskets = [rng.sample("abcdefghij", rng.randint(1, 8)) for _ in range(60)]
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    run = BasketRun(spark, tables(spark, lines), DEFAULT.with_(taxo=False, cartsize_min=1, cartsize_max=None))
    staged = {}

    def stage(name, df):
        staged[name] = run.store.put(name, df)
        return staged[name]

    support = 0.2
    got = {tuple(r.subset): r.freq for r in M.frequent_subsets(run.baskets, run.n_baskets, support, 5, stage).collect()}
    counts = Counter(c for b in baskets for n in range(1, 6) for c in combinations(sorted(b), n))
    want = {c: f for c, f in counts.items() if f > support * len(baskets)}
    assert got == want and max(map(len, want)) >= 3
    for n in (3, 4, 5):
        candidates = {c for c in counts if len(c) == n and all(s in want for s in combinations(c, n - 1))}
        rows = {tuple(r.subset) for r in staged[f"subsets_{n}"].collect()}
        assert rows == candidates
    assert staged["subsets_3"].count() < sum(f for c, f in counts.items() if len(c) == 3)


@pytest.mark.parametrize("long, few", [(64, 1 << 16), (3, 0)])
def test_staged_sets_are_counts(spark, long, few):
    """A level writes one row per set, not one per basket and set; rare items, long baskets and late candidates included."""
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(11)
    baskets = [rng.sample("abcdefgh", rng.randint(1, 7)) + ([f"rare{i}"] if i % 3 == 0 else []) for i in range(60)]
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    run = BasketRun(spark, tables(spark, lines), DEFAULT.with_(taxo=False, cartsize_min=1, cartsize_max=None))
    staged = {}

    def stage(name, df):
        staged[name] = run.store.put(name, df)
        return staged[name]

    got = {tuple(r.subset): r.freq for r in M.frequent_subsets(run.baskets, run.n_baskets, 0.2, 4, stage, long, few).collect()}
    counts = Counter(c for b in baskets for n in range(1, 5) for c in combinations(sorted(b), n))
    assert got == {c: f for c, f in counts.items() if f > 0.2 * len(baskets)} and max(map(len, got)) >= 3
    for n in (2, 3, 4):
        rows = [tuple(r.subset) for r in staged[f"subsets_{n}"].collect()]
        assert len(rows) == len(set(rows))


def test_blocks_of_a_long_basket_hold_few_items(spark):
    run = BasketRun(spark, tables(spark, [(1, 1, f"{i:03d}", 1.0) for i in range(100)]), DEFAULT.with_(taxo=False, cartsize_max=None, support_item=0.0))
    got = {(r.a, r.b) for r in M.pair_freq(run.baskets, run.frequent, run.cfg, chunk=7).collect()}
    assert got == {(f"{i:03d}", f"{j:03d}") for i in range(100) for j in range(i + 1, 100)}
