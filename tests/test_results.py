"""Result files, their order, rejects, restart from files, and the job on real tables."""

import json

import pytest
from pyspark.sql import functions as F

from tests.helpers import tables, ts
from trolley import job
from trolley.config import DEFAULT
from trolley.plans import results
from trolley.plans.market_basket import BasketRun
from trolley.sources import results as X
from trolley.sources.tables import read_tables

BASKETS = [["a", "b", "c"], ["a", "b"], ["b", "c", "d"], ["a", "c"], ["a", "d"], ["b", "d"], ["a", "b", "d"], ["c", "e"], ["a", "b"]]
LINES = [(1, i, x, 1.0) for i, b in enumerate(BASKETS) for x in b]
CATALOG = [(x, x.upper(), "d") for x in "abcd"]
TAXONOMY = [("1", "2", "FOOD", "MILK", x) for x in "abcde"]
CFG = DEFAULT.with_(taxo=False, support_item=0.15, topn=3)


@pytest.fixture(scope="module")
def done(spark, tmp_path_factory):
    run = BasketRun(spark, tables(spark, LINES, [], CATALOG), CFG)
    path = str(tmp_path_factory.mktemp("results"))
    return run, path, results.export(run, path)


def lines_of(path, name):
    """The file's lines in the order of its part files, read without Spark."""
    import glob

    out = []
    for part in sorted(glob.glob(f"{path}/{results.FILES[name]}/part-*")):
        with open(part, encoding="utf-8") as f:
            out += f.read().splitlines()
    return out


def test_files_are_in_order_with_one_header(done):
    run, path, rows = done
    freq = {}
    for b in BASKETS:
        for x in b:
            freq[x] = freq.get(x, 0) + 1
    assert lines_of(path, "items") == [f"{x}\t{n}" for x, n in sorted(freq.items(), key=lambda p: (-p[1], p[0]))]
    pairs = lines_of(path, "pairs")
    assert pairs == sorted(pairs) and len(pairs) == rows["pairs"]
    rules = lines_of(path, "rules")
    assert rules[0] == "A\tB\tconfidence\tlift" and len(rules) == rows["rules"] + 1
    confidences = [float(r.split("\t")[2]) for r in rules[1:]]
    assert confidences == sorted(confidences, reverse=True)
    assert all(len(r.split("\t")[2]) == 10 for r in rules[1:])
    interaction = lines_of(path, "interaction")
    assert interaction[0].split("\t") == X.INTERACTION_HEADER
    a = next(r for r in interaction if r.split("\t")[1] == "a").split("\t")
    # a with b 4, c 2, d 2: mean 8/3, median 2, deviation sqrt(8/9)
    assert a == ["A", "a", "3", "4", "   2.66667", "2", "   0.94281", "4 2 2"]
    assert len(lines_of(path, "carts")) == len(BASKETS)
    recalls = [float(r.split("\t")[5]) for r in lines_of(path, "evaluation")]
    assert recalls == sorted(recalls, reverse=True) and len(recalls) == rows["evaluation"]


def test_reading_back_in_order(spark, done):
    run, path, _ = done
    got = X.read_lines(spark, f"{path}/{results.FILES['rules']}", run._put).orderBy("pos").collect()
    assert [r.line for r in got] == lines_of(path, "rules") and [r.pos for r in got] == list(range(1, len(got) + 1))


def test_many_part_files_keep_the_order(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k")).repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        X.write_lines(df, str(tmp_path / "t"), [F.col("k")], [X.Desc(F.col("k"))], ["head"])
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    parts = sorted((tmp_path / "t").glob("part-*"))
    lines = [line for p in parts for line in p.read_text().splitlines()]
    assert len([p for p in parts if p.stat().st_size]) > 1
    assert lines == ["head"] + [str(k) for k in range(4999, -1, -1)]


@pytest.mark.parametrize("stage", results.STAGES)
def test_restart_from_any_stage(spark, done, stage):
    run, path, rows = done
    again, rejects = results.resume(spark, path, run.tables, stage)
    assert rejects.count() == 0 and again.cfg == run.cfg
    key = ["a", "b"]
    assert again.rules.orderBy(key).collect() == run.rules.orderBy(key).collect()
    # Baskets that repeat stay apart, though the files have no receipts.
    assert again.eval_overall.collect() == run.eval_overall.collect()
    assert again.eval_per_item.collect() == run.eval_per_item.collect()


def test_bad_lines_are_rejected_not_nulled(spark, done, tmp_path):
    run, path, _ = done
    (tmp_path / "items").write_text("a\t3\nb\tmany\nc\nd\t4\tx\ne\t5\n")
    good, bad = X.read_checked(spark, str(tmp_path / "items"), X.ITEMS, run._put)
    assert sorted(map(tuple, good.collect())) == [("a", 3), ("e", 5)]
    assert sorted(map(tuple, bad.collect())) == [("b\tmany", "not a bigint: freq"), ("c", "cells: 1"), ("d\t4\tx", "cells: 3")]


def test_files_that_do_not_match_the_manifest(spark, done, tmp_path):
    import shutil

    run, path, _ = done
    copy = str(tmp_path / "copy")
    shutil.copytree(path, copy)
    spark.createDataFrame([("a\t3",), ("b\tx",)], "value string").coalesce(1).write.mode("overwrite").text(f"{copy}/freq_item.tsv")
    with pytest.raises(ValueError, match="freq_item.tsv has 1 rows"):
        results.resume(spark, copy, run.tables)
    _, rejects = results.resume(spark, copy, run.tables, strict=False)
    assert [tuple(r) for r in rejects.collect()] == [("freq_item.tsv", "b\tx", "not a bigint: freq")]
    with pytest.raises(ValueError, match="stage"):
        results.resume(spark, copy, run.tables, "rules")


def write_feed(spark, path, qty="decimal(18,3)"):
    t = tables(spark, LINES, [(1, i, ts("1997-03-01 00:00:00"), 5) for i in range(len(BASKETS))], CATALOG, TAXONOMY)
    feed = {"lines": t.lines.withColumn("qty", F.col("qty").cast(qty)), "headers": t.headers, "catalog": t.catalog, "taxonomy": t.taxonomy}
    for name, df in feed.items():
        df.write.parquet(f"{path}/{name}")
    return {name: f"{path}/{name}" for name in feed}


def test_contract_rejects_and_missing_columns(spark, tmp_path):
    paths = write_feed(spark, str(tmp_path / "feed"))
    odd = spark.createDataFrame(
        [(1, 1, "a", "2.5", "extra"), (1, 1, "b", "lots", "extra"), (1, None, "c", "1", "extra"), (None, 2, "d", "1.0005", "extra")],
        "register int, receipt bigint, item string, qty string, more string",
    )
    odd.write.parquet(str(tmp_path / "odd"))
    t, rejects = read_tables(spark, **(paths | {"lines": str(tmp_path / "odd")}))
    assert sorted((r.item, str(r.qty)) for r in t.lines.collect()) == [("a", "2.500"), ("d", "1.001")]
    got = sorted((r.table, json.loads(r.row)["item"], r.reason) for r in rejects.collect())
    assert got == [("lines", "b", "not a value: qty"), ("lines", "c", "missing: receipt")]
    spark.range(1).write.parquet(str(tmp_path / "none"))
    with pytest.raises(ValueError, match="catalog: item, name, descr; taxonomy: cat0_id"):
        read_tables(spark, **(paths | {"catalog": str(tmp_path / "none"), "taxonomy": str(tmp_path / "none")}))


def test_job_and_its_restart(spark, tmp_path):
    paths = write_feed(spark, str(tmp_path / "feed"))
    argv = [a for n, p in paths.items() for a in (f"--{n}", p)] + ["--out", str(tmp_path / "out")]
    options = job.parser().parse_args([*argv, "--no-taxo", "--support-item", "0.15", "--topn", "3", "--cartsize-max", "none"])
    rows = job.run_job(spark, options)
    cfg, files = X.read_manifest(spark, str(tmp_path / "out"))
    assert cfg == CFG.with_(cartsize_max=None) and files == rows and rows["carts"] == len(BASKETS)
    again = job.run_job(spark, job.parser().parse_args([*argv, "--resume", "pairs"]))
    assert again == rows
    for name in ("items", "pairs", "rules", "interaction", "evaluation"):
        assert lines_of(str(tmp_path / "out" / "resumed"), name) == lines_of(str(tmp_path / "out"), name)
