"""Basket preparation on hand-made rows (the edge cases of FIXTURES §5)."""

from pyspark.sql import functions as F

from tests.helpers import tables, ts
from trolley.config import DEFAULT
from trolley.operators import baskets as B

TAXO = [
    # cat0, cat1, cat0_name, cat1_name, item
    ("1", "1", "FOOD", "BREAD", "a1"),
    ("1", "1", "FOOD", "BREAD", "a2"),
    ("1", "2", "FOOD", "MILK", "b1"),
    ("2", "123", "FUEL", "DIESEL", "c1"),  # 3-digit id: code is '02123', not cut
    ("3", "4", "SHOP", "TOYS", "d1"),
]


def _lines():
    return [
        # storno to exactly zero: x1 disappears
        (1, 10, "x1", 2.0), (1, 10, "x1", -2.0), (1, 10, "a1", 1.0), (1, 10, "b1", 1.0),
        # partly cancelled stays; a1 netted negative, a2 keeps category 0101
        (1, 11, "b1", 3.0), (1, 11, "b1", -1.0), (1, 11, "a1", 1.0), (1, 11, "a1", -2.0),
        (1, 11, "a2", 1.0),
        # unknown item -> '0000'; 3-digit category id
        (2, 12, "zz", 1.0), (2, 12, "c1", 1.0),
        # null register
        (None, 13, "a1", 1.0), (None, 13, "d1", 1.0),
        # register 3
        (3, 14, "a1", 1.0), (3, 14, "d1", 1.0),
        # basket of one
        (1, 15, "a1", 1.0),
    ]


def test_netting_and_categories(spark):
    t = tables(spark, _lines(), taxonomy=TAXO)
    got = {
        (r.register, r.receipt): r.items
        for r in B.build_baskets(t, DEFAULT.with_(cartsize_min=1)).collect()
    }
    assert got[(1, 10)] == ["0101", "0102"]
    assert got[(1, 11)] == ["0101", "0102"]  # a1 netted out, a2 maps to the same code
    assert got[(2, 12)] == ["0000", "02123"]
    assert got[(None, 13)] == ["0101", "0304"]
    assert got[(1, 15)] == ["0101"]


def test_raw_items_without_taxonomy(spark):
    t = tables(spark, _lines(), taxonomy=TAXO)
    got = {
        (r.register, r.receipt): r.items
        for r in B.build_baskets(t, DEFAULT.with_(taxo=False, cartsize_min=1)).collect()
    }
    assert got[(1, 10)] == ["a1", "b1"]
    assert got[(1, 11)] == ["a2", "b1"]


def test_register_filter_keeps_null_for_shop(spark):
    t = tables(spark, _lines(), taxonomy=TAXO)
    shop = {r.receipt for r in B.register_filter(t.lines, "shop").collect()}
    espresso = {r.receipt for r in B.register_filter(t.lines, "espresso").collect()}
    assert 13 in shop and 14 not in shop
    assert espresso == {14}
    assert {r.receipt for r in B.register_filter(t.lines, "shop1").collect()} == {10, 11, 15}


def test_size_bounds_inclusive(spark):
    lines = []
    for receipt, n in [(1, 1), (2, 2), (3, 6), (4, 7)]:
        lines += [(1, receipt, f"i{k}", 1.0) for k in range(n)]
    t = tables(spark, lines)
    got = {r.receipt: r.size for r in B.build_baskets(t, DEFAULT.with_(taxo=False)).collect()}
    assert got == {2: 2, 3: 6}


def test_time_range_open_and_deduplicated(spark):
    lines = [(1, r, i, 1.0) for r in (1, 2, 3) for i in ("p", "q")]
    headers = [
        (1, 1, ts("1997-05-01 10:00:00"), 5),
        (1, 1, ts("1997-06-01 10:00:00"), 5),  # duplicate header: one basket only
        (1, 2, ts("1996-01-01 00:00:00"), 5),  # exactly on the lower bound: out
        (1, 3, ts("1999-12-31 23:59:59"), 5),
    ]
    t = tables(spark, lines, headers)
    cfg = DEFAULT.with_(taxo=False, timerange=("1996-01-01", "2000-01-01"))
    got = sorted(r.receipt for r in B.build_baskets(t, cfg).collect())
    assert got == [1, 3]


def test_unique_baskets(spark):
    lines = [(1, r, i, 1.0) for r in (1, 2) for i in ("q", "p")] + [(1, 3, "p", 1.0), (1, 3, "z", 1.0)]
    t = tables(spark, lines)
    got = sorted(r.items for r in B.build_baskets(t, DEFAULT.with_(taxo=False, unique=True)).collect())
    assert got == [["p", "q"], ["p", "z"]]


def test_drop_item(spark):
    lines = [(1, 1, "a1", 1.0), (1, 1, "b1", 1.0), (1, 1, "d1", 1.0)]
    t = tables(spark, lines, taxonomy=TAXO)
    got = B.build_baskets(t, DEFAULT.with_(drop_item="0101")).collect()
    assert [r.items for r in got] == [["0102", "0304"]]


def test_lookups_take_smallest_on_duplicates(spark):
    catalog = [("a1", "zeta", "d"), ("a1", "alpha", "d"), ("b1", "milk", "m")]
    t = tables(spark, [], catalog=catalog, taxonomy=TAXO + [("1", "9", "FOOD", "X", "a1")])
    names = {r.item: r.name for r in B.item_names(t.catalog).collect()}
    assert names == {"a1": "alpha", "b1": "milk"}
    cats = {r.item: r.category for r in B.item_category(t.taxonomy).collect()}
    assert cats["a1"] == "0101" and cats["c1"] == "02123"
    cn = {r.category: r.name for r in B.category_names(t.taxonomy).collect()}
    assert cn["0101"] == "FOOD-BREAD"


def _fence_brute(hist, k=3.0):
    """Tukey fence by walking the size list (sizes > 1, ascending)."""
    import math

    hist = sorted((s, f) for s, f in hist if s > 1)
    n = sum(f for _, f in hist)

    def first_above(x):
        run = 0
        for s, f in hist:
            run += f
            if run > x:
                return s

    q1, q3 = first_above(0.25 * (n - 1)), first_above(0.75 * (n - 1))
    return q1, q3, math.floor(q1 - k * (q3 - q1)), math.ceil(q3 + k * (q3 - q1))


def test_size_fence_matches_walk(spark):
    for hist in ([(1, 5), (2, 3), (3, 2), (4, 1)], [(2, 1), (3, 4), (4, 1)], [(2, 2), (5, 4), (9, 4)]):
        sizes = spark.createDataFrame(hist, "size int, freq long")
        r = B.basket_size_fence(sizes, 3.0).first()
        assert (r.q1, r.q3, r.lower, r.upper) == _fence_brute(hist)
    # n mod 4 = 2 (n = 6): the upper quartile is not percentile_disc(0.75)
    assert sum(f for s, f in [(2, 1), (3, 4), (4, 1)]) % 4 == 2


def test_histograms(spark):
    lines = [(1, 1, "a", 1.0), (1, 1, "b", 1.0), (1, 2, "a", 1.0), (2, 2, "a", 1.0)]
    t = tables(spark, lines)
    got = {(r.c, r.f) for r in B.receipt_length_hist(t.lines).collect()}
    assert got == {(2, 1), (1, 2)}


def test_taxonomy_build_null_ids(spark):
    catalog = [("a1", "bread", "food"), ("q9", "odd", "misc")]
    ids = spark.createDataFrame([("1", "1", "a1")], "cat0_id string, cat1_id string, item string")
    t = tables(spark, [], catalog=catalog)
    rows = {r.item: r for r in B.taxonomy_build(t.catalog, ids).collect()}
    assert rows["a1"].cat0_name == "cn0_1" and rows["a1"].store == "0"
    assert rows["q9"].cat0_name is None and rows["q9"].cat0_id is None


def test_preview_is_ordered_and_limited(spark):
    lines = [(1, r, "a", 1.0) for r in range(1, 30)]
    t = tables(spark, lines)
    got = [r.receipt for r in B.table_preview(t.lines, ["register", "receipt"], 10, 5).collect()]
    assert got == [11, 12, 13, 14, 15]


def test_scan_prunes_columns(spark):
    from trolley.sources.fixtures import lines

    plan = lines(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_returnflag:string>" in plan


def test_receipts_filter_pushed_to_scan(spark):
    from trolley.sources.fixtures import headers

    df = B.receipts_in_range(headers(spark, "/root/testdata/sf0.001"), "1996-01-01", "2000-01-01")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in plan
    assert F is not None


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_time_range_is_applied_below_the_first_aggregate(spark):
    lines = [(1, 1, "a", 1.0), (1, 1, "b", 1.0), (1, 2, "a", 1.0), (1, 2, "b", 1.0)]
    headers = [(1, 1, ts("2000-01-02"), 5), (1, 2, ts("2001-01-02"), 5)]
    cfg = DEFAULT.with_(taxo=False, timerange=("2000-01-01", "2000-12-31"))
    b = B.build_baskets(tables(spark, lines, headers), cfg.with_(cartsize_max=None))
    assert [r.receipt for r in b.collect()] == [1]
    plan = _plan(b)  # top of the tree first: a join printed after the last aggregate lies below it
    assert plan.rindex("LeftSemi") > plan.rindex("Aggregate")


def test_too_long_receipt_is_dropped_before_any_set_is_collected(spark):
    lines = [(1, 0, f"i{k}", 1.0) for k in range(60)]
    lines += [(r % 3 + 1, r, f"i{r % 7 + k}", 1.0) for r in range(1, 61) for k in range(2)]
    lines += [(None, None, "x", 1.0), (None, None, "y", 1.0)]
    b = B.build_baskets(tables(spark, lines), DEFAULT.with_(taxo=False))
    got = b.collect()
    assert sorted((r.receipt is None, r.receipt) for r in got if r.receipt is not None) == [(False, r) for r in range(1, 61)]
    assert [r["items"] for r in got if r.receipt is None] == [["x", "y"]]
    plan = _plan(b)
    assert plan.index("collect_set") < plan.index("LeftSemi")


def test_decimal_quantities_net_to_zero_and_totals_keep_their_cents(spark):
    from trolley.sources.tables import conform

    raw = spark.createDataFrame(
        [(1, 1, "a", 0.1), (1, 1, "a", 0.2), (1, 1, "a", -0.3), (1, 1, "b", 1.0)],
        "register int, receipt bigint, item string, qty double",
    )
    assert [r.item for r in B.net_lines(conform(raw, "lines")[0]).collect()] == ["b"]
    totals = spark.createDataFrame([(1, 1, 12.34), (1, 2, 12.99)], "register int, receipt bigint, total double")
    heads = conform(totals.selectExpr("*", "timestamp_ntz'2000-01-01' AS ts"), "headers")[0]
    assert [tuple(r) for r in B.receipt_total_hist(heads).collect()] == [(1, 2)]
