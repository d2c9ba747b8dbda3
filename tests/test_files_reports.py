"""File sources/sinks, training sets, classifiers and report tables."""

import os
import tempfile

from tests.helpers import tables, ts
from trolley.config import DEFAULT
from trolley.operators import classify as C
from trolley.operators import reports as P
from trolley.plans.market_basket import BasketRun
from trolley.sources import files as S


def _dir():
    return tempfile.mkdtemp(prefix="trolley-test-")


def test_carts_roundtrip_strips_trailing_tab(spark):
    b = spark.createDataFrame([(["a", "b"],), (["c"],)], "items array<string>")
    p = os.path.join(_dir(), "carts")
    S.write_carts(b, p)
    raw = sorted(r.value for r in spark.read.text(p).collect())
    assert raw == ["a\tb\t", "c\t"]
    got = sorted((r.items, r.size) for r in S.read_carts(spark, p).collect())
    assert got == [(["a", "b"], 2), (["c"], 1)]


def test_taxonomy_tsv_header_names(spark):
    t = tables(spark, [], taxonomy=[("1", "123", "FOOD", "BREAD", "a1")])
    p = os.path.join(_dir(), "taxo")
    S.write_taxonomy_tsv(t.taxonomy, p)
    header = spark.read.text(p).first().value
    assert header.split("\t") == ["cat0.id", "cat1.id", "cat0.name", "cat1.name", "TOVAR"]
    assert [tuple(r) for r in S.read_taxonomy_tsv(spark, p).collect()] == [
        ("1", "123", "FOOD", "BREAD", "a1")
    ]


def test_tsv_roundtrip_with_schema(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([("a", 3), ("b", 1)], "item string, freq long")
    p = os.path.join(_dir(), "freq")
    S.write_tsv(df, p)
    schema = T.StructType([T.StructField("item", T.StringType()), T.StructField("freq", T.LongType())])
    assert sorted(tuple(r) for r in S.read_tsv(spark, p, schema).collect()) == [("a", 3), ("b", 1)]


def _train_run(spark):
    baskets = [["a", "b", "c"], ["a", "b"], ["a", "c"], ["b"], ["a", "b", "c"], ["d", "a"]]
    lines = [(1, i, x, 1.0) for i, b in enumerate(baskets) for x in b]
    return BasketRun(spark, tables(spark, lines), DEFAULT.with_(taxo=False, support_item=0.2))


def test_item_index_and_training_rows(spark):
    r = _train_run(spark)
    # Size filter 2..: basket [b] goes. freq: a 5, b 3, c 3, d 1 (not frequent:
    # 1 <= 0.2 * 5). Index by (freq, item) ascending: b 1, c 2, a 3.
    idx = {x.item: x.idx for x in r.item_index.collect()}
    assert idx == {"b": 1, "c": 2, "a": 3}
    got = sorted((x.label, tuple(x.indices)) for x in r.training_rows.collect())
    want = sorted(
        [(3.0, (1, 2)), (1.0, (2, 3)), (2.0, (1, 3))] * 2  # two baskets a b c
        + [(3.0, (1,)), (1.0, (3,))]  # a b
        + [(3.0, (2,)), (2.0, (3,))]  # a c
    )  # d a: no other frequent item, no row
    assert got == want


def test_libsvm_one_based(spark):
    rows = spark.createDataFrame([(2.0, [1, 3]), (1.0, [2])], "label double, indices array<int>")
    p = os.path.join(_dir(), "svm")
    S.write_libsvm_text(rows, p)
    assert sorted(r.value for r in spark.read.text(p).collect()) == ["1.0 2:1", "2.0 1:1 3:1"]
    data = S.read_libsvm(spark, p, 3)
    got = sorted((r.label, tuple(r.features.indices.tolist())) for r in data.collect())
    assert got == [(1.0, (1,)), (2.0, (0, 2))]


def test_register_only_items(spark):
    lines = [
        (3, 1, "x", 1.0), (3, 1, "y", 1.0),
        (3, 2, "x", 1.0), (3, 2, "w", 1.0),
        (1, 3, "y", 1.0), (1, 3, "w", 1.0),
        (2, 4, "q", 1.0), (2, 4, "w", 1.0),
    ]
    r = BasketRun(spark, tables(spark, lines), DEFAULT.with_(taxo=False), materialize=False)
    assert [(x.item, x.freq) for x in P.register_only_items(r.baskets).collect()] == [("x", 2)]


def test_pair_category_padding(spark):
    pairs = spark.createDataFrame([("0102", "02123", 4), ("101", "0102", 1)], "a string, b string, freq long")
    taxo = [("1", "2", "FOOD", "MILK", "m"), ("2", "123", "FUEL", "DIESEL", "d"), ("1", "01", "F", "X", "q")]
    t = tables(spark, [], taxonomy=taxo)
    got = {(r.a, r.b): (r.cat1_a, r.cat1_b) for r in P.pair_freq_category(pairs, t.taxonomy).collect()}
    assert got[("0102", "02123")] == ("MILK" + " " * 16, "DIESEL" + " " * 14)
    assert got[("0101", "0102")] == ("X" + " " * 19, "MILK" + " " * 16)


def test_item_freq_since(spark):
    lines = [(1, 1, "a", 1.0), (1, 1, "b", 1.0), (1, 2, "a", 1.0), (1, 2, "c", 1.0)]
    headers = [(1, 1, ts("1997-03-01 00:00:00"), 1), (1, 2, ts("1999-03-01 00:00:00"), 1)]
    catalog = [("a", "A", "x"), ("b", "B", "x"), ("c", "C", "x"), ("e", "E", "x")]
    t = tables(spark, lines, headers, catalog)
    r = BasketRun(spark, t, DEFAULT.with_(taxo=False, support_item=0.0), materialize=False)
    got = {x.item: (x.freq_all, x.fs_1996, x.fs_1998) for x in r.item_freq_since([1996, 1998]).collect()}
    assert got == {"a": (2, 2, 1), "b": (1, 1, 0), "c": (1, 1, 1), "e": (0, 0, 0)}


def test_split_does_not_depend_on_partitions(spark):
    data = _train_run(spark).training_data
    sides = [{r.row_key for r in C.train_test_split(data.repartition(n))[1].collect()} for n in (4, 7)]
    assert sides[0] == sides[1]
    keys = [r.row_key for r in data.collect()]
    assert len(keys) == len(set(keys))
