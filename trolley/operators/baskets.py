"""Basket preparation: from receipt lines to one item set per receipt.

Order of work (as the job defines it): lines are netted per item within a
receipt (cancellations carry a negative quantity), items with a positive net
are mapped to their category, categories are de-duplicated, and the basket
size is the number of distinct categories.

A time range is applied to the lines, before anything is summed. Size bounds
are checked on counts of distinct items per receipt, summed map-side, before
any set is collected, so a receipt with too many items never becomes an array.
The taxonomy join carries no broadcast hint: the taxonomy grows with the
catalog, so Spark's size check (autoBroadcastJoinThreshold, and AQE at run
time) picks broadcast or a skew-aware sort-merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BasketConfig
from ..functions.text import rjust
from ..sources.fixtures import Tables

KEYS = ["register", "receipt"]


# ---------------------------------------------------------------- lookups


def catalog_distinct(catalog: DataFrame) -> DataFrame:
    """Distinct (item, name, descr) triples of the catalog."""
    return catalog.select("item", "name", "descr").distinct()


def item_names(catalog: DataFrame) -> DataFrame:
    """item -> name; one name per item (the smallest, when the catalog repeats)."""
    return catalog.groupBy("item").agg(F.min("name").alias("name"))


def category_code(cat0: Column | str, cat1: Column | str) -> Column:
    """Two-digit, zero-padded ids joined: ('1', '7') -> '0107'; never truncated."""
    return F.concat(rjust(cat0, 2), rjust(cat1, 2))


def item_category(taxonomy: DataFrame) -> DataFrame:
    """item -> category code, the smallest code when an item is listed twice."""
    return (
        taxonomy.select(
            "item", category_code(F.col("cat0_id"), F.col("cat1_id")).alias("category")
        )
        .groupBy("item")
        .agg(F.min("category").alias("category"))
    )


def category_names(taxonomy: DataFrame) -> DataFrame:
    """category -> 'cat0_name-cat1_name', one row per code."""
    return (
        taxonomy.select(
            category_code(F.col("cat0_id"), F.col("cat1_id")).alias("category"),
            F.concat_ws("-", "cat0_name", "cat1_name").alias("name"),
        )
        .groupBy("category")
        .agg(F.min("name").alias("name"))
    )


def category_short_names(taxonomy: DataFrame) -> DataFrame:
    """Distinct (category, cat1_name) pairs."""
    return taxonomy.select(
        category_code(F.col("cat0_id"), F.col("cat1_id")).alias("category"),
        "cat1_name",
    ).dropDuplicates()


def vocabulary_names(tables: Tables, cfg: BasketConfig) -> DataFrame:
    """(item, name) for whatever a basket holds: categories or catalog items."""
    if cfg.taxo:
        return category_names(tables.taxonomy).withColumnRenamed("category", "item")
    return item_names(tables.catalog)


# ---------------------------------------------------------------- lines


def register_filter(lines: DataFrame, register: str) -> DataFrame:
    """all | shop (every register but 3, null included) | espresso (3) | shop1 | shop2."""
    r = F.col("register")
    conditions = {
        "shop": ~r.eqNullSafe(3),
        "espresso": r == 3,
        "shop1": r == 1,
        "shop2": r == 2,
    }
    if register == "all":
        return lines
    return lines.where(conditions[register])


def net_lines(lines: DataFrame) -> DataFrame:
    """Quantity summed per item of a receipt; only positive nets remain."""
    return (
        lines.groupBy("register", "receipt", "item")
        .agg(F.sum("qty").alias("qty"))
        .where(F.col("qty") > 0)
    )


def category_lines(
    net: DataFrame, item_cat: DataFrame, unknown: str = "0000"
) -> DataFrame:
    """Net lines with their category; items missing from the taxonomy get ``unknown``."""
    return net.join(item_cat, "item", "left").select(
        "register",
        "receipt",
        "item",
        "qty",
        F.coalesce(F.col("category"), F.lit(unknown)).alias("category"),
    )


# ---------------------------------------------------------------- baskets


def basket_items(tables: Tables, cfg: BasketConfig) -> DataFrame:
    """Long form of the baskets, unsized: (register, receipt, item), maybe repeated.

    ``item`` is the category code when ``cfg.taxo`` is set, else the raw item;
    several items of one category give repeated rows, removed when the
    basket is collected as a set.
    """
    lines = register_filter(tables.lines, cfg.register)
    if cfg.timerange:
        lines = restrict_to_receipts(lines, receipts_in_range(tables.headers, *cfg.timerange))
    net = net_lines(lines)
    if cfg.taxo:
        mapped = category_lines(net, item_category(tables.taxonomy), cfg.unknown_category)
        rows = mapped.select("register", "receipt", F.col("category").alias("item"))
    else:
        rows = net.select("register", "receipt", "item")
    if cfg.drop_item is not None:
        rows = rows.where(F.col("item") != F.lit(cfg.drop_item))
    return rows


def collect_baskets(items: DataFrame, lo: int, hi: int | None) -> DataFrame:
    """(register, receipt, items ARRAY sorted, size) with lo <= size <= hi.

    With an upper bound, receipts are sized first (partial counts) and only
    the items of those within bounds are collected: a receipt holding a third
    of all lines is dropped as rows, which a skewed join splits over tasks.
    """
    if hi is not None:
        items = items.distinct()
        sizes = items.groupBy("register", "receipt").agg(F.count("item").alias("n"))
        fit = sizes.where(F.col("n").between(lo, hi)).select(
            F.col("register").alias("_r_register"), F.col("receipt").alias("_r_receipt")
        )
        same = F.col("register").eqNullSafe(F.col("_r_register")) & F.col("receipt").eqNullSafe(F.col("_r_receipt"))
        items = items.join(fit, same, "left_semi")
    b = items.groupBy("register", "receipt").agg(
        F.array_sort(F.collect_set("item")).alias("items")
    )
    size = F.size("items")
    return b.where(size >= lo).select("register", "receipt", "items", size.cast("int").alias("size"))


def receipts_in_range(headers: DataFrame, lo: str, hi: str) -> DataFrame:
    """Headers with lo < ts < hi (both ends open); filter reaches the scan."""
    lo_ts = F.lit(lo).cast("timestamp_ntz")
    hi_ts = F.lit(hi).cast("timestamp_ntz")
    return headers.where((F.col("ts") > lo_ts) & (F.col("ts") < hi_ts)).select(
        "register", "receipt", "ts"
    )


def receipt_time_span(in_range: DataFrame) -> DataFrame:
    """First and last timestamp and the number of headers in range."""
    return in_range.agg(
        F.min("ts").alias("ts_min"),
        F.max("ts").alias("ts_max"),
        F.count("*").alias("n"),
    )


def restrict_to_receipts(df: DataFrame, receipts: DataFrame) -> DataFrame:
    """Rows whose (register, receipt) has a header in ``receipts``.

    A semi join: a receipt with two matching headers still counts once. The
    register compares null-safe, as the job's string keys did.
    """
    r = receipts.select(
        F.col("register").alias("_r_register"), F.col("receipt").alias("_r_receipt")
    )
    cond = F.col("register").eqNullSafe(F.col("_r_register")) & (
        F.col("receipt") == F.col("_r_receipt")
    )
    return df.join(r, cond, "left_semi")


def build_baskets(tables: Tables, cfg: BasketConfig) -> DataFrame:
    """The basket table the mining steps read.

    Columns: register, receipt, items (sorted array), size. With
    ``cfg.unique`` the receipt keys are dropped and only distinct item sets
    remain (register and receipt are then null).
    """
    baskets = collect_baskets(basket_items(tables, cfg), cfg.cartsize_min, cfg.cartsize_max)
    if cfg.unique:
        baskets = unique_baskets(baskets)
    return baskets


def unique_baskets(baskets: DataFrame) -> DataFrame:
    """Distinct item sets; arrays are sorted, so equal sets compare equal."""
    return baskets.select("items", "size").distinct().select(
        F.lit(None).cast("int").alias("register"),
        F.lit(None).cast("bigint").alias("receipt"),
        "items",
        "size",
    )


# ---------------------------------------------------------------- histograms


def receipt_length_hist(lines: DataFrame) -> DataFrame:
    """Raw receipt length c (lines, no netting) and how many receipts have it (f)."""
    per_receipt = lines.groupBy("register", "receipt").agg(F.count("*").alias("c"))
    return (
        per_receipt.groupBy("c")
        .agg(F.count("*").alias("f"))
        .orderBy(F.desc("f"), "c")
    )


def receipt_total_hist(headers: DataFrame) -> DataFrame:
    """How many headers share a (register, total), and how often each count occurs."""
    per_total = headers.groupBy("register", "total").agg(F.count("*").alias("c"))
    return (
        per_total.groupBy("c")
        .agg(F.count("*").alias("f"))
        .orderBy(F.desc("f"), "c")
    )


def basket_sizes(baskets: DataFrame, size_min: int = 1) -> DataFrame:
    """(size, freq) for sizes >= size_min, most frequent first."""
    return (
        baskets.where(F.col("size") >= size_min)
        .groupBy("size")
        .agg(F.count("*").alias("freq"))
        .orderBy(F.desc("freq"), "size")
    )


def basket_sizes_by_size(baskets: DataFrame, size_min: int = 1) -> DataFrame:
    return basket_sizes(baskets, size_min).orderBy("size")


def basket_size_fence(sizes: DataFrame, k: float = 3.0) -> DataFrame:
    """Tukey fence on basket size from a (size, freq) histogram.

    Size 1 is left out. With n baskets, q1 is the first size whose running
    count exceeds 0.25 (n - 1), q3 the first exceeding 0.75 (n - 1); the fence
    is [floor(q1 - k iqr), ceil(q3 + k iqr)]. The histogram has one row per
    distinct size, so the running sum over one ordered window stays tiny.
    """
    h = sizes.where(F.col("size") > 1).select("size", "freq")
    w = Window.orderBy("size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = Window.partitionBy()
    h = h.withColumn("cum", F.sum("freq").over(w)).withColumn(
        "n", F.sum("freq").over(total)
    )
    q = h.agg(
        F.min(F.when(F.col("cum") > F.lit(0.25) * (F.col("n") - 1), F.col("size"))).alias("q1"),
        F.min(F.when(F.col("cum") > F.lit(0.75) * (F.col("n") - 1), F.col("size"))).alias("q3"),
    )
    iqr = F.col("q3") - F.col("q1")
    return q.select(
        "q1",
        "q3",
        iqr.alias("iqr"),
        F.floor(F.col("q1") - F.lit(float(k)) * iqr).cast("double").alias("lower"),
        F.ceil(F.col("q3") + F.lit(float(k)) * iqr).cast("double").alias("upper"),
    )


# ---------------------------------------------------------------- taxonomy build, preview


def taxonomy_build(catalog: DataFrame, category_ids: DataFrame) -> DataFrame:
    """Taxonomy table from the catalog and an (cat0_id, cat1_id, item) list.

    Names are synthesized as 'cn0_<id>' / 'cn1_<id>' (null id, null name), the
    store column is the constant '0', rows sorted by ids then item.
    """
    joined = catalog_distinct(catalog).join(category_ids, "item", "left")
    return joined.select(
        "cat0_id",
        "cat1_id",
        F.concat(F.lit("cn0_"), F.col("cat0_id")).alias("cat0_name"),
        F.concat(F.lit("cn1_"), F.col("cat1_id")).alias("cat1_name"),
        F.lit("0").alias("store"),
        "item",
        "name",
        "descr",
    ).orderBy("cat0_id", "cat1_id", "item")


def table_preview(
    df: DataFrame, order_by: list[str], after_receipt: int = 0, n: int = 200
) -> DataFrame:
    """First n rows in key order, optionally only receipts above a number."""
    if after_receipt:
        df = df.where(F.col("receipt") > after_receipt)
    return df.orderBy(*order_by).limit(n)
