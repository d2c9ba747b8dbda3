"""Leave-one-out evaluation of the recommender.

A sample is a basket with one of its vocabulary items held out as the label;
the rest of the basket (items outside the vocabulary included) is the cart
and must not be empty. The recommender ranks candidates for the cart; a hit
is the label appearing in the top n.

The lists come from ``recommend.ranked_samples``; the statistics are grouped
aggregates over them (map-side partial counts, one row per label after the
shuffle). No per-item jobs, no collect.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



def loo_positions(baskets: DataFrame, vocab: DataFrame) -> DataFrame:
    """(register, receipt, items, pos, label): one row per held-out vocabulary item.

    ``items`` is the whole basket; the cart is ``items`` without position
    ``pos``. Only baskets of two or more items give a non-empty cart.
    ``vocab`` (item) is the rule vocabulary; Spark sizes the semi join (a
    broadcast when the vocabulary stage table is small).
    """
    return (
        baskets.where(F.size("items") > 1)
        .select("register", "receipt", "items", F.posexplode("items").alias("pos", "label"))
        .join(vocab.select(F.col("item").alias("label")), "label", "left_semi")
    )


def cart_of(items: str = "items", pos: str = "pos") -> Column:
    return F.filter(F.col(items), lambda x, i: i != F.col(pos))


def leave_one_out(baskets: DataFrame, vocab: DataFrame) -> DataFrame:
    """(register, receipt, label, items): the cart left after holding out label."""
    return loo_positions(baskets, vocab).select(
        "register", "receipt", "label", cart_of().alias("items")
    )


def topn_recs(ranked: DataFrame) -> DataFrame:
    """Long form: (register, receipt, label, rank, item, log_score)."""
    z = F.arrays_zip(F.col("top_items").alias("item"), F.col("top_logs").alias("log_score"))
    return ranked.select("register", "receipt", "label", F.posexplode(z).alias("pos", "c")).select(
        "register",
        "receipt",
        "label",
        (F.col("pos") + 1).alias("rank"),
        F.col("c.item").alias("item"),
        F.col("c.log_score").alias("log_score"),
    )


def _label_counts(ranked: DataFrame, vocab: DataFrame, topn: int) -> DataFrame:
    """Per vocabulary item: nX samples with that label, tp hits, hits per rank.

    Items that are never a label keep zero counts.
    """
    cols = ["nX", "tp"] + [f"hits_{r}" for r in range(1, topn + 1)]
    hits = [F.count_if(F.col("hit_rank") == r).alias(f"hits_{r}") for r in range(1, topn + 1)]
    counts = ranked.groupBy(F.col("label").alias("item")).agg(
        F.count("*").alias("nX"), F.count_if(F.col("hit_rank") > 0).alias("tp"), *hits
    )
    return vocab.select("item").join(counts, "item", "left").select(
        "item", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in cols]
    )


def eval_per_item(
    ranked: DataFrame, vocab: DataFrame, names: DataFrame, topn: int
) -> DataFrame:
    """(name, item, n, nX, tp, recall) per vocabulary item, best recall first.

    recall = tp / nX, null when the item is never a label.
    """
    n_all = ranked.select(F.count("*")).scalar()
    per = _label_counts(ranked, vocab, topn)
    return (
        per.join(names, "item", "left")
        .select(
            "name",
            "item",
            n_all.alias("n"),
            "nX",
            "tp",
            F.try_divide(F.col("tp"), F.col("nX")).alias("recall"),
        )
        .orderBy(F.desc("recall"), "item")
    )


def eval_hits_by_rank(ranked: DataFrame, vocab: DataFrame, topn: int) -> DataFrame:
    """(item, rank, hits) for rank 1..topn, zeros included."""
    per = _label_counts(ranked, vocab, topn)
    pairs = F.array(
        *[F.struct(F.lit(r).alias("rank"), F.col(f"hits_{r}").alias("hits")) for r in range(1, topn + 1)]
    )
    return per.select("item", F.explode(pairs).alias("h")).select(
        "item", F.col("h.rank").alias("rank"), F.col("h.hits").alias("hits")
    )


def eval_overall(ranked: DataFrame) -> DataFrame:
    """(n, tp, accuracy, mae): accuracy = tp / n, mae = 1 - accuracy, 0 for n = 0."""
    agg = ranked.agg(
        F.count("*").alias("n"), F.count_if(F.col("hit_rank") > 0).alias("tp")
    )
    return agg.select(
        "n",
        "tp",
        F.coalesce(F.try_divide(F.col("tp"), F.col("n")), F.lit(0.0)).alias("accuracy"),
        F.coalesce(F.try_divide(F.col("n") - F.col("tp"), F.col("n")), F.lit(0.0)).alias("mae"),
    )


def eval_confusion(ranked: DataFrame, vocab: DataFrame, topn: int) -> DataFrame:
    """One-vs-rest counts per vocabulary item and the derived rates.

    tp: label X, X recommended; fp: other label, X recommended; fn: label X,
    not recommended; tn: the rest. Recommendation counts come from one
    explode of the top lists, so this is two grouped aggregates.
    """
    n_all = ranked.select(F.count("*")).scalar()
    per = _label_counts(ranked, vocab, topn).select("item", "nX", "tp")
    rec = (
        ranked.select(F.explode("top_items").alias("item"))
        .groupBy("item")
        .agg(F.count("*").alias("n_rec"))
    )
    j = per.join(rec, "item", "left").select(
        "item", "nX", "tp", F.coalesce("n_rec", F.lit(0)).alias("n_rec")
    )
    tp, fp, fn = F.col("tp"), F.col("n_rec") - F.col("tp"), F.col("nX") - F.col("tp")
    tn = n_all - tp - fp - fn

    def safe(x, y):
        return F.coalesce(F.try_divide(x, y), F.lit(0.0))

    out = j.select("item", tp.alias("tp"), tn.alias("tn"), fp.alias("fp"), fn.alias("fn"))
    out = out.select(
        "*",
        safe(F.col("tp") + F.col("tn"), n_all).alias("accuracy"),
        safe(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
    )
    return out.withColumn(
        "f1",
        safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )
