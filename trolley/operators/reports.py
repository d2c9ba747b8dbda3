"""Report tables: counts joined with names, sales since cut-off dates,
items sold at one register only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import ljust, rjust
from .baskets import category_short_names, catalog_distinct


def item_freq_named(freq: DataFrame, names: DataFrame) -> DataFrame:
    """(item, freq, name)."""
    return freq.join(names, "item", "left").select("item", "freq", "name")


def pair_freq_named(pairs: DataFrame, names: DataFrame) -> DataFrame:
    """(a, b, freq, name_a, name_b), most frequent first."""
    na = names.select(F.col("item").alias("a"), F.col("name").alias("name_a"))
    nb = names.select(F.col("item").alias("b"), F.col("name").alias("name_b"))
    return (
        pairs.join(na, "a", "left")
        .join(nb, "b", "left")
        .select("a", "b", "freq", "name_a", "name_b")
        .orderBy(F.desc("freq"), "a", "b")
    )


def pair_freq_category(pairs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(a, b, freq, cat1_a, cat1_b) with codes padded to 4 and names to 20.

    A code listed with two names gives two rows, as a join does.
    """
    short = category_short_names(taxonomy).select(
        rjust("category", 4).alias("category"), ljust("cat1_name", 20).alias("cat1_name")
    ).dropDuplicates()
    sa = short.select(F.col("category").alias("a"), F.col("cat1_name").alias("cat1_a"))
    sb = short.select(F.col("category").alias("b"), F.col("cat1_name").alias("cat1_b"))
    padded = pairs.select(rjust("a", 4).alias("a"), rjust("b", 4).alias("b"), "freq")
    return (
        padded.join(sa, "a", "left")
        .join(sb, "b", "left")
        .select("a", "b", "freq", "cat1_a", "cat1_b")
        .orderBy(F.desc("freq"), "a", "b")
    )


def receipt_times(headers: DataFrame) -> DataFrame:
    """Latest header timestamp per receipt (a receipt may have several headers)."""
    return headers.groupBy("register", "receipt").agg(F.max("ts").alias("ts"))


def item_freq_since(
    baskets: DataFrame, headers: DataFrame, catalog: DataFrame, years: list[int]
) -> DataFrame:
    """Per catalog item: baskets overall and baskets after 1 January of each year.

    A basket counts for a cut-off when a header of its receipt is later than
    the cut (open interval). One pass: baskets get their receipt time by a
    join on the receipt key, then one grouped count with a conditional count
    per cut-off; the catalog is joined once at the end and missing counts are 0.
    """
    t = receipt_times(headers).select(
        F.col("register").alias("_h_register"), F.col("receipt").alias("_h_receipt"), "ts"
    )
    cond = F.col("register").eqNullSafe(F.col("_h_register")) & (
        F.col("receipt") == F.col("_h_receipt")
    )
    timed = baskets.join(t, cond, "left").select(F.explode("items").alias("item"), "ts")
    cuts = [
        F.count_if(F.col("ts") > F.lit(f"{y}-01-01").cast("timestamp_ntz")).alias(f"fs_{y}")
        for y in years
    ]
    counts = timed.groupBy("item").agg(F.count("*").alias("freq_all"), *cuts)
    cols = ["freq_all"] + [f"fs_{y}" for y in years]
    return catalog_distinct(catalog).join(counts, "item", "left").select(
        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in cols],
        "item",
        "name",
        "descr",
    )


def register_only_items(baskets: DataFrame, only: int = 3, others: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Items sold at register ``only`` and never at ``others``, with their count there."""
    per = baskets.select("register", F.explode("items").alias("item"))
    at_only = per.where(F.col("register") == only).groupBy("item").agg(F.count("*").alias("freq"))
    at_others = per.where(F.col("register").isin(list(others))).select("item")
    return at_only.join(at_others, "item", "left_anti").orderBy(F.desc("freq"), "item")
