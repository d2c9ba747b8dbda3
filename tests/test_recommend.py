"""Recommender and leave-one-out evaluation against a brute-force enumeration."""

import math
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.helpers import tables
from trolley import queries as Q
from trolley.config import DEFAULT
from trolley.operators import recommend as R
from trolley.plans.market_basket import BasketRun


def brute_scores(cart, rules, p, variant):
    """Scores by enumeration: dict candidate -> log score (None = score 0).

    rules: {(a, x): confidence}; p: {x: P(x)}. ``best`` literally searches
    every non-empty subset of the cart.
    """
    vocab = sorted({a for a, _ in rules} | {x for _, x in rules})
    out = {}
    for x in vocab:
        if x in cart:
            continue
        if variant == "best":
            subsets = [c for i in range(1, len(cart) + 1) for c in combinations(cart, i)]
        else:
            subsets = [tuple(cart)]
        best = None
        for s in subsets:
            factors = [rules[(a, x)] for a in s if (a, x) in rules]
            if not factors:
                continue
            v = math.log(p[x]) + sum(math.log(f) for f in factors)
            best = v if best is None or v > best else best
        if best is None and variant == "classic":
            continue
        out[x] = best
    return out


def brute_top(scores, n):
    key = sorted(scores, key=lambda x: (scores[x] is None, -round(scores[x], 9) if scores[x] is not None else 0, x))
    return key[:n]


@pytest.fixture(scope="module")
def small(spark):
    baskets = [
        ["a", "b", "c"], ["a", "b"], ["b", "c", "d"], ["a", "c"], ["a", "d"],
        ["b", "d"], ["a", "b", "d"], ["c", "e"], ["a", "b", "c", "d"], ["e", "z"],
    ]
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    t = tables(spark, lines)
    cfg = DEFAULT.with_(taxo=False, support_item=0.15, smooth_k=0.01, topn=3)
    return baskets, BasketRun(spark, t, cfg)


def _model(run):
    rules = {(r.a, r.b): r.confidence for r in run.rules.collect()}
    n = run.baskets.count()
    p = {r.item: r.freq / n for r in run.item_freq.collect()}
    return rules, p


@pytest.mark.parametrize("variant", ["classic", "subset", "best"])
@pytest.mark.parametrize("n", [2, 50])
def test_recommendations_match_enumeration(spark, small, variant, n):
    baskets, run0 = small
    run = BasketRun(spark, run0.tables, run0.cfg.with_(topn=n))
    rules, p = _model(run)
    got = {}
    for r in run.recommendations(variant).collect():
        got.setdefault(r.receipt, {})[r.rank] = (r.item, r.log_score)
    for i, b in enumerate(baskets):
        scores = brute_scores(sorted(set(b)), rules, p, variant)
        want = brute_top(scores, n)
        have = [got.get(i, {})[k] for k in sorted(got.get(i, {}))]
        assert [x for x, _ in have] == want, (i, variant)
        for x, v in have:
            assert (v is None and scores[x] is None) or math.isclose(v, scores[x], rel_tol=1e-9)


def _loo(baskets, rules, p, n, variant="subset"):
    vocab = {a for a, _ in rules} | {x for _, x in rules}
    for key, b in baskets:
        b = sorted(set(b))
        for label in b:
            if label in vocab and len(b) > 1:
                top = brute_top(brute_scores([x for x in b if x != label], rules, p, variant), n)
                yield key, label, top, top.index(label) + 1 if label in top else 0


@pytest.mark.parametrize("subset", [True, False])
def test_leave_one_out_top_lists(spark, small, subset):
    baskets, run0 = small
    run = BasketRun(spark, run0.tables, run0.cfg.with_(subset=subset))
    rules, p = _model(run)
    got = sorted((r.receipt, r.label, r.top_items, r.hit_rank) for r in run.ranked.collect())
    assert got == sorted(_loo(enumerate(baskets), rules, p, 3, "subset" if subset else "classic"))


def test_distinct_baskets_null_registers_and_large_ids(spark, small):
    baskets, run0 = small
    big = 2**53 + 1
    lines = [(None if i % 2 else 1, big + i, x, 1.0) for i, b in enumerate(baskets + baskets[:3]) for x in b]
    run = BasketRun(spark, tables(spark, lines), run0.cfg)
    rules, p = _model(run)
    got = sorted((r.receipt - big, r.label, r.top_items, r.hit_rank) for r in run.ranked.collect())
    assert got == sorted(_loo(enumerate(baskets + baskets[:3]), rules, p, 3))
    distinct = BasketRun(spark, tables(spark, lines), run0.cfg.with_(unique=True))
    rules, p = _model(distinct)
    got = sorted((r.label, r.top_items, r.hit_rank) for r in distinct.ranked.collect())
    assert got == sorted(t[1:] for t in _loo(enumerate(baskets), rules, p, 3))


def test_evaluation_identities(spark):
    run = Q.run(spark, SF_SMALL)
    o = run.eval_overall.first()
    assert math.isclose(o.accuracy + o.mae, 1.0)
    hits = run.eval_hits_by_rank.groupBy("item").agg(F.sum("hits").alias("h"))
    per = run.eval_per_item.select("item", "tp", "nX")
    for r in per.join(hits, "item").collect():
        assert r.h == r.tp <= r.nX
    conf = run.eval_confusion.collect()
    assert all(c.tp + c.tn + c.fp + c.fn == o.n for c in conf)


def test_zero_sized_evaluation(spark):
    t = tables(spark, [(1, 1, "a", 1.0)])
    run = BasketRun(spark, t, DEFAULT.with_(taxo=False, cartsize_min=1))
    o = run.eval_overall.first()
    assert (o.n, o.tp, o.accuracy, o.mae) == (0, 0, 0.0, 0.0)


@pytest.mark.parametrize("variant", ["classic", "subset", "best"])
@pytest.mark.parametrize("n,cells", [(3, 1 << 21), (3, 7), (40, 1 << 21)])
def test_held_out_lists_of_every_variant(spark, small, variant, n, cells, monkeypatch):
    """Blocks of any size, short and long lists: the same as enumerating each held-out cart."""
    baskets, run0 = small
    monkeypatch.setattr(R, "BLOCK_CELLS", cells)
    rules, p = _model(run0)
    got = R.ranked_samples(run0.baskets, run0.rule_vectors, variant, n).collect()
    have = sorted((r.receipt, r.label, r.top_items, r.hit_rank) for r in got)
    assert have == sorted(_loo(enumerate(baskets), rules, p, n, variant))
    for r in got:
        scores = brute_scores([x for x in sorted(set(baskets[r.receipt])) if x != r.label], rules, p, variant)
        for x, v in zip(r.top_items, r.top_logs):
            assert (v is None and scores[x] is None) or math.isclose(v, scores[x], rel_tol=1e-9)


def test_one_basket_with_a_third_of_all_rows(spark):
    """A basket of every item, beside many small ones that hold two thirds of the rows."""
    import random

    rng = random.Random(3)
    items = [f"i{k:03d}" for k in range(300)]
    baskets = [items] + [rng.sample(items[:40], 2) for _ in range(300)]
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    cfg = DEFAULT.with_(taxo=False, support_item=0.0, cartsize_max=None, topn=4)
    run = BasketRun(spark, tables(spark, lines), cfg)
    got = {(r.receipt, r.label): (r.top_items, r.hit_rank) for r in run.ranked.collect()}
    assert len(got) == sum(map(len, baskets))
    rules, p = _model(run)
    # The hot basket without one item lacks that item only.
    assert all(got[0, x] == ([x], 1) for x in items)
    for i in range(1, 25):
        for label in baskets[i]:
            cart = [x for x in baskets[i] if x != label]
            top = brute_top(brute_scores(cart, rules, p, "subset"), 4)
            assert got[i, label] == (top, top.index(label) + 1 if label in top else 0)


def test_equal_scores_are_ordered_by_item(spark):
    """Candidates that score alike keep item order, whatever order the rules come in."""
    baskets = [["a", x] for x in ("d", "b", "c")] * 5
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    run = BasketRun(spark, tables(spark, lines), DEFAULT.with_(taxo=False, support_item=0.1, topn=3))
    assert {tuple(r.top_items) for r in run.ranked.where("label <> 'a'").collect()} == {("b", "c", "d")}


def test_no_rules(spark):
    run = BasketRun(spark, tables(spark, [(1, 1, "a", 1.0), (1, 1, "b", 1.0)]), DEFAULT.with_(taxo=False, lift_threshold=1e9))
    assert run.ranked.collect() == [] and run.recommendations("subset").collect() == [] and run.recommendations("best").collect() == []


def _rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("variant", ["classic", "subset", "best"])
def test_no_row_carries_a_vector(spark, small, variant):
    """Groups of baskets get the vectors once; the join, for vocabularies too wide for that, gives the same rows."""
    _, run0 = small
    for scored in (R.recommend, R.ranked_samples):
        whole, joined = (scored(run0.baskets, run0.rule_vectors, variant, 3, whole=w) for w in (R.WHOLE, 0))
        plans = [df._jdf.queryExecution().optimizedPlan().toString() for df in (whole, joined)]
        assert ["Join LeftOuter" in p for p in plans] == [False, True]
        assert "collect_list" not in plans[0] and "FlatMapCoGroupsInArrow" in plans[0]
        assert _rows(whole) == _rows(joined) != []


def test_many_groups_and_items_outside_the_vocabulary(spark, small, monkeypatch):
    from trolley.plans import groups as G

    _, run0 = small
    baskets = run0.baskets.unionByName(
        spark.createDataFrame([(7, 1, ["a", "?"], 2), (7, 2, ["?", "!"], 2), (None, None, ["a", "b"], 2)], run0.baskets.schema)
    )
    want = _rows(R.ranked_samples(baskets, run0.rule_vectors, "subset", 3))
    assert {r[2] for r in want if r[:2] == (7, 1)} == {"a"} and not [r for r in want if r[:2] == (7, 2)]
    monkeypatch.setattr(G, "GROUP", 1)
    n = run0.rule_vectors.count()
    rows = baskets.select("register", "receipt", "items")
    spread = G.with_whole(rows, 10**4, run0.rule_vectors, 1, lambda a, b: a.append_column("n", [[b.num_rows] * a.num_rows]),
                          "register int, receipt bigint, items array<string>, n bigint", 1)
    got = spread.collect()
    assert len(got) == rows.count() and {r.n for r in got} == {n}
