"""Export of a run's results and a run restarted from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files as S
from ..sources import results as X
from ..sources.fixtures import Tables
from .market_basket import BasketRun
from .numbering import numbered

#: Files a run can be restarted from, in the order it makes them.
STAGES = ("carts", "items", "pairs")
FILES = {
    "carts": "carts.tsv",
    "items": "freq_item.tsv",
    "pairs": "freq_pair.tsv",
    "interaction": "interaction.tsv",
    "rules": "confidence_ab.tsv",
    "evaluation": "eval_nb.tsv",
}


def export(run: BasketRun, path: str) -> dict[str, int]:
    """Writes the results of a run under ``path``; returns the rows of each file.

    carts: one line per basket; items by frequency; pairs by their items;
    interaction by item; rules by confidence and lift; evaluation by recall (the
    counts of hits at each rank that has any come last). The manifest is written
    last: a folder without one is not whole.
    """
    from ..operators import mining as M

    place = {name: f"{path}/{file}" for name, file in FILES.items()}
    interaction = M.item_interaction(run.pair_freq, run.n_baskets, run.names, run.cfg.support_pair, run.cfg.interaction_list_max)
    hits = run.eval_hits_by_rank.where(F.col("hits") > 0).groupBy("item").agg(
        F.array_sort(F.collect_list(F.struct("rank", "hits"))).alias("h")
    )
    evaluation = run.eval_per_item.join(hits, "item", "left")
    S.write_carts(run.baskets, place["carts"])
    c = F.col
    X.write_lines(run.item_freq, place["items"], [c("item"), c("freq")], [X.Desc(c("freq")), c("item")])
    X.write_lines(run.pair_freq, place["pairs"], [c("a"), c("b"), c("freq")], [c("a"), c("b")])
    median = F.when(c("n") % 2 == 1, c("median").cast("long").cast("string")).otherwise(F.format_string("%.1f", c("median")))
    X.write_lines(
        interaction, place["interaction"],
        [c("name"), c("item"), c("n"), c("max"), X.fixed("avg"), median, X.fixed("stddev"), c("list")],
        [c("item")], X.INTERACTION_HEADER,
    )
    X.write_lines(
        run.rules, place["rules"], [c("a"), c("b"), X.fixed("confidence"), X.fixed("lift")],
        [X.Desc(F.round("confidence", 9)), X.Desc(F.round("lift", 9)), c("a"), c("b")], X.RULES_HEADER,
    )
    counts = F.concat_ws("\t", F.transform("h", lambda x: x["hits"].cast("string")))
    recall = F.coalesce(X.fixed("recall"), F.lit(""))
    X.write_lines(
        evaluation, place["evaluation"],
        [c("name"), c("item"), c("n"), c("nX"), c("tp"), F.when(F.length(counts) > 0, F.concat_ws("\t", recall, counts)).otherwise(recall)],
        [X.Desc(F.round("recall", 9)), c("item")],
    )
    sizes = {
        "carts": run.baskets, "items": run.item_freq, "pairs": run.pair_freq, "interaction": interaction, "rules": run.rules, "evaluation": run.eval_per_item,
    }
    rows = {name: df.count() for name, df in sizes.items()}
    X.write_manifest(run.spark, path, run.cfg, rows)
    return rows


def resume(spark: SparkSession, path: str, tables: Tables, stage: str = "pairs", strict: bool = True) -> tuple[BasketRun, DataFrame]:
    """(run, rejects): a run whose stages up to ``stage`` come from exported files; the rest is computed.

    Baskets get their line's number as receipt. rejects (file, line, reason) are
    lines that are no rows; with ``strict`` a file whose rows are not as many as
    the manifest says is an error. ``tables`` give names and, in later reports, times.
    """
    if stage not in STAGES:
        raise ValueError(f"stage must be one of {STAGES}")
    cfg, files = X.read_manifest(spark, path)
    run = BasketRun(spark, tables, cfg)
    rejects = spark.createDataFrame([], "file string, line string, reason string")
    wanted = STAGES[: STAGES.index(stage) + 1]
    found: dict[str, DataFrame] = {}
    carts = numbered(S.read_carts(spark, f"{path}/{FILES['carts']}"), [F.col("items")], run._put, "receipt")
    found["carts"] = run._put(carts.select(F.lit(None).cast("int").alias("register"), "receipt", "items", "size"))
    for name, schema in (("items", X.ITEMS), ("pairs", X.PAIRS)):
        if name in wanted:
            found[name], bad = X.read_checked(spark, f"{path}/{FILES[name]}", schema, run._put)
            rejects = rejects.unionByName(bad.select(F.lit(FILES[name]).alias("file"), "line", "reason"))
    if strict:
        for name, df in found.items():
            n = df.count()
            if n != files[name]:
                raise ValueError(f"{FILES[name]} has {n} rows, the manifest says {files[name]}")
    # What a cached property has in the instance is not computed again.
    for name, attribute in zip(STAGES, ("baskets", "item_freq", "pair_freq")):
        if name in wanted:
            run.__dict__[attribute] = found[name]
    return run, rejects
