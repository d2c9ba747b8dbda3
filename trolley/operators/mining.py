"""Item and pair counts, smoothed probabilities and association rules.

Joins carry no hints: Spark picks their strategy from the sizes it measures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BasketConfig
from ..functions.arrays import block_pairs, subsets
from .recommend import with_id


def basket_count(baskets: DataFrame) -> Column:
    """N, the number of baskets, as a scalar subquery."""
    return baskets.select(F.count("*")).scalar()


def item_freq(baskets: DataFrame) -> DataFrame:
    """Baskets holding each item, in no order."""
    return (
        baskets.select(F.explode("items").alias("item"))
        .groupBy("item")
        .agg(F.count("*").alias("freq"))
    )


def item_prob(freq: DataFrame, n_baskets: Column) -> DataFrame:
    """P(X) = freq / N."""
    return freq.select("item", "freq", (F.col("freq") / n_baskets).alias("prob"))


def item_share(freq: DataFrame) -> DataFrame:
    """Share of all item occurrences, freq / sum(freq), largest first."""
    total = freq.select(F.sum("freq")).scalar()
    return freq.select("item", "freq", (F.col("freq") / total).alias("share")).orderBy(
        F.desc("share"), "item"
    )


def frequent_items(freq: DataFrame, n_baskets: Column, support: float) -> DataFrame:
    """Items with freq > support * N (strict)."""
    return freq.where(F.col("freq") > F.lit(float(support)) * n_baskets)


def candidate_pairs(frequent: DataFrame) -> DataFrame:
    """Number of frequent items F and of candidate pairs a < b, F (F - 1) / 2.

    Only the count is reported; the pairs themselves are never enumerated —
    pair counting works from the pairs that actually occur in baskets.
    """
    return frequent.agg(F.count("*").alias("frequent_items")).select(
        "frequent_items",
        (F.col("frequent_items") * (F.col("frequent_items") - 1) / 2)
        .cast("bigint")
        .alias("candidate_pairs"),
    )


# Items per block of a long basket.
PAIR_CHUNK = 32


def pair_freq(
    baskets: DataFrame, frequent: DataFrame, cfg: BasketConfig, chunk: int = PAIR_CHUNK
) -> DataFrame:
    """(a, b, freq): baskets holding both frequent items a < b; only freq > 0.

    Infrequent items leave the baskets first, so no pair is made that is then
    thrown away. Every basket is cut into blocks of ``chunk`` items and each pair of
    blocks is a row of its own, dealt by (basket, blocks): a huge basket does not
    put its quadratic pair count on one task, and no row holds more than two
    blocks. Pairs are counted with map-side partial counts, so one that a third of
    all baskets hold costs one row per map task.
    """
    b = with_id(baskets)
    if cfg.support_item > 0:
        b = (
            b.select("basket_id", F.explode("items").alias("item"))
            .join(frequent.select("item"), "item", "left_semi")
            .groupBy("basket_id")
            .agg(F.array_sort(F.collect_list("item")).alias("items"))
        )
    last = F.ceil(F.size("items") / chunk).cast("int") - 1
    rows = (
        b.where(F.size("items") > 1)
        .select("basket_id", "items", F.explode(F.sequence(F.lit(0), last)).alias("i"))
        .select("basket_id", "items", "i", F.explode(F.sequence(F.col("i"), last)).alias("j"))
        .select(
            "basket_id", "i", "j",
            F.slice("items", F.col("i") * chunk + 1, chunk).alias("left"),
            F.slice("items", F.col("j") * chunk + 1, chunk).alias("right"),
        )
    )
    return (
        rows.repartition("basket_id", "i", "j")
        .select(F.explode(block_pairs("left", "right", F.col("i") == F.col("j"))).alias("p"))
        .groupBy(F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.count("*").alias("freq"))
    )


def smoothed(freq: Column, n_baskets: Column, n_kinds: Column, k: float) -> Column:
    """(f + k) / (N + k * n_kinds), or f / N without smoothing."""
    if k > 0:
        return (freq + F.lit(float(k))) / (n_baskets + F.lit(float(k)) * n_kinds)
    return freq / n_baskets


def item_prob_smoothed(freq: DataFrame, n_baskets: Column, k: float) -> DataFrame:
    """Smoothed P(X); the item count in the denominator covers all items."""
    n_item = freq.select(F.count("*")).scalar()
    return freq.select("item", smoothed(F.col("freq"), n_baskets, n_item, k).alias("prob"))


def pair_prob_smoothed(
    pairs: DataFrame, n_baskets: Column, k: float, support_pair: float
) -> DataFrame:
    """Smoothed P(AB) of pairs with freq > support_pair * N.

    The pair count in the denominator is taken before that filter.
    """
    n_pair = pairs.select(F.count("*")).scalar()
    kept = pairs.where(F.col("freq") > F.lit(float(support_pair)) * n_baskets)
    return kept.select("a", "b", smoothed(F.col("freq"), n_baskets, n_pair, k).alias("prob"))


def association_rules(
    pair_prob: DataFrame, frequent_prob: DataFrame, cfg: BasketConfig
) -> DataFrame:
    """Directed rules (a, b, confidence = P(a given b), lift).

    Each pair gives two rows. For row (x, y): confidence = P(xy) / P(y) and
    lift = confidence / P(x), so lift is the same both ways. Strict lift and
    confidence thresholds, in no order.
    """
    probs = frequent_prob.select("item", "prob")
    pa = probs.select(F.col("item").alias("a"), F.col("prob").alias("pa"))
    pb = probs.select(F.col("item").alias("b"), F.col("prob").alias("pb"))
    j = pair_prob.join(pa, "a").join(pb, "b")
    both = j.select(
        F.explode(
            F.array(
                F.struct(
                    F.col("a").alias("x"), F.col("b").alias("y"), "prob",
                    F.col("pa").alias("px"), F.col("pb").alias("py"),
                ),
                F.struct(
                    F.col("b").alias("x"), F.col("a").alias("y"), "prob",
                    F.col("pb").alias("px"), F.col("pa").alias("py"),
                ),
            )
        ).alias("r")
    )
    conf = F.col("r.prob") / F.col("r.py")
    rules = both.select(
        F.col("r.x").alias("a"),
        F.col("r.y").alias("b"),
        conf.alias("confidence"),
        (conf / F.col("r.px")).alias("lift"),
    )
    return rules.where(
        (F.col("lift") > F.lit(float(cfg.lift_threshold)))
        & (F.col("confidence") > F.lit(float(cfg.confidence_threshold)))
    )


def order_rules(rules: DataFrame) -> DataFrame:
    return rules.orderBy(F.desc("confidence"), F.desc("lift"), "a", "b")


def rule_items(rules: DataFrame) -> DataFrame:
    """Items on either side of a rule: the recommender's vocabulary."""
    return (
        rules.select(F.col("a").alias("item"))
        .union(rules.select(F.col("b").alias("item")))
        .distinct()
    )


def item_interaction(
    pairs: DataFrame,
    n_baskets: Column,
    names: DataFrame,
    support_pair: float = 0.0,
    list_max: int | None = None,
) -> DataFrame:
    """Per item, statistics of the pair counts with its partners.

    n partners, max, mean, exact median, population standard deviation, and
    the partner counts (descending, space separated): all, or the largest
    ``list_max``, a report width. The narrow list uses row_number <= list_max,
    which Spark limits per group before the shuffle.
    """
    kept = pairs.where(F.col("freq") > F.lit(float(support_pair)) * n_baskets)
    both = kept.select(F.col("a").alias("item"), "freq").unionByName(
        kept.select(F.col("b").alias("item"), "freq")
    )
    stats = both.groupBy("item").agg(
        F.count("*").alias("n"),
        F.max("freq").alias("max"),
        F.avg("freq").alias("avg"),
        F.median("freq").cast("double").alias("median"),
        F.stddev_pop("freq").alias("stddev"),
    )
    shown = both
    if list_max is not None:
        w = Window.partitionBy("item").orderBy(F.desc("freq"))
        shown = both.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= list_max)
    top = (
        shown.groupBy("item")
        .agg(F.sort_array(F.collect_list("freq"), asc=False).alias("top"))
        .select("item", F.concat_ws(" ", F.col("top").cast("array<string>")).alias("list"))
    )
    return (
        stats.join(top, "item")
        .join(names, "item", "left")
        .select("name", "item", "n", "max", "avg", "median", "stddev", "list")
    )


def basket_subsets(baskets: DataFrame, len_max: int = 6) -> DataFrame:
    """(subset, size, freq) by the whole-cart rule of the job.

    A basket of up to ``len_max`` items adds each of its subsets, a longer one
    only itself. For supports over every basket see :func:`frequent_subsets`.
    """
    return (
        baskets.select(F.explode(subsets("items", len_max)).alias("subset"))
        .groupBy("subset")
        .agg(F.count("*").alias("freq"))
        .select("subset", F.size("subset").alias("size"), "freq")
    )


# Items of a basket from which its rows are dealt anew, and candidates up to which rows meet them before they are counted.
LONG_BASKET = 64
FEW_CANDIDATES = 1 << 16


def frequent_subsets(
    baskets: DataFrame,
    n_baskets: Column,
    support: float,
    k: int,
    stage: Callable[[str, DataFrame], DataFrame],
    long: int = LONG_BASKET,
    few: int = FEW_CANDIDATES,
) -> DataFrame:
    """(subset, size, freq): sets of up to ``k`` items with freq > support * N, over every basket.

    Level by level: supported sets that differ in their last item join to
    candidates, and a candidate stays only if each of its subsets one smaller is
    supported. A basket's sets carry its later items with them and grow by these in
    their row, so no level joins the baskets again. Grown sets are counted with
    partial counts; what is shuffled and staged is counts of sets, and the rows
    of sets that begin a candidate. ``stage`` writes what the next level reads.
    """
    bound = F.lit(float(support)) * n_baskets
    counts = stage("subsets_1", item_freq(baskets))
    often = counts.where(F.col("freq") > bound)
    kept = baskets.select("items")
    if not counts.where(F.col("item").isNull() | ~(F.col("freq") > bound)).isEmpty():
        held = with_id(baskets).select("basket_id", F.explode("items").alias("item"))
        held = held.join(often, "item", "left_semi").groupBy("basket_id")
        kept = stage("kept", held.agg(F.array_sort(F.collect_list("item")).alias("items")))
    kept = kept.select(F.array().cast("array<string>").alias("subset"), F.col("items").alias("rest"))
    # A long basket's sets are dealt to all tasks, with the later items of each.
    rows = grown_sets(kept.where(F.size("rest") <= long)).unionByName(
        grown_sets(kept.where(F.size("rest") > long)).repartition("subset", "rest")
    )
    often = stage("often_1", often.select(F.array("item").alias("subset"), "freq"))
    found = often
    for size in range(2, k + 1):
        wanted = None
        if size > 2:
            wanted = stage(f"candidates_{size}", candidate_sets(often, size))
            heads = wanted.select(F.slice("subset", 1, size - 1).alias("subset")).distinct()
            rows = stage(f"level_{size - 1}", rows.where(F.size("rest") > 0).join(heads, "subset", "left_semi"))
        rows = grown_sets(rows)
        sets = rows
        # Few candidates leave few rows to count; many cost less to meet once the rows are counted.
        early = wanted is not None and wanted.count() <= few
        if early:
            sets = rows = rows.join(wanted, "subset", "left_semi")
        counts = sets.groupBy("subset").agg(F.count("*").alias("freq"))
        if wanted is not None and not early:
            counts = counts.join(wanted, "subset", "left_semi")
        counts = stage(f"subsets_{size}", counts)
        often = stage(f"often_{size}", counts.where(F.col("freq") > bound))
        found = found.unionByName(often)
    return found.select("subset", F.size("subset").alias("size"), "freq")


def grown_sets(rows: DataFrame) -> DataFrame:
    """(subset, rest): each set with each later item of its basket added, and the items after that one."""
    each = rows.select("subset", "rest", F.posexplode("rest").alias("i", "item"))
    later = F.slice("rest", F.col("i") + 2, F.size("rest"))
    return each.select(F.concat("subset", F.array("item")).alias("subset"), later.alias("rest"))


def candidate_sets(often: DataFrame, size: int) -> DataFrame:
    """(subset): sets of ``size`` items all of whose subsets one smaller are in ``often`` (subset, sorted)."""
    head = F.slice("subset", 1, size - 2)
    ends = often.select(head.alias("head"), F.element_at("subset", -1).alias("x"))
    grown = ends.join(ends.select("head", F.col("x").alias("y")), "head").where(F.col("x") < F.col("y"))
    grown = grown.select(F.concat("head", F.array("x", "y")).alias("subset"))
    # The two subsets that lack one of the last items are supported by the way the set was made.
    for gone in range(size - 2):
        rest = F.filter("subset", lambda _, i: i != gone)
        grown = grown.withColumn("rest", rest).join(often.select(F.col("subset").alias("rest")), "rest", "left_semi").drop("rest")
    return grown.select("subset")
