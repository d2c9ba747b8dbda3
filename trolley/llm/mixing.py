"""Mixing sources to target weights by balanced sampling (the cube method).

Every source gets a target number of words; a document's expected number of
takes is target / size of its source. The whole part is taken for sure; the
fraction is an inclusion probability. The flight phase moves these
probabilities along the null space of the two balancing constraints (number of
documents, number of words of the source) until a document is in or out: with
three undecided documents of sizes a, b, c the direction (b - c, c - a, a - b)
changes neither total. What stays undecided, at most two documents, is landed
at the end by the rounding that misses the two totals least.

Spark runs the flight in rounds: the undecided documents of a source are dealt
into blocks of about BLOCK rows by a hash, each block flies alone and keeps at
most two undecided ones, and those go on to the next round, until one block per
source is left. A source with a third of all rows is thus spread over many
tasks, and each task holds one block of numbers, never texts. Random choices
are drawn from hashes, so reruns agree.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages
from .tokens import chunks, words

WEIGHTS = (3.0, 1.0, 2.0)
TOTAL = 1.5
CAP = 2.0
BLOCK = 4096
SEED = 17


def with_size(docs: DataFrame, columns: list[str]) -> DataFrame:
    """columns (renamed _c0, ...) and _size, the number of words of each whole text."""
    names = [f"_c{i}" for i in range(len(columns))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names)], *([] if "text" in columns else [F.col("text").alias("_text")]))
    text = names[columns.index("text")] if "text" in columns else "_text"

    def run(batches):
        for b in batches:
            sizes = [words(part).counts for _, part in chunks(b.column(text))]
            n = np.concatenate(sizes).astype(np.int64) if sizes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + [pa.array(n)], names=[*names, "_size"])

    kept = [T.StructField(n, source.schema[n].dataType) for n in names]
    return source.mapInArrow(run, T.StructType([*kept, T.StructField("_size", T.LongType())]))


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP) -> DataFrame:
    """(_source, _source_size, _target) of sizes(_source, _size).

    Sources by code point, null last, weigh as ``weights`` repeats. They share
    total * all words; a target stops at cap times its source, and the excess
    goes to the others by weight until none is above. This is water filling: in
    order of rising capacity per weight, sources fill up while their capacity
    stays below their share of what is left. One row per source is windowed.
    """
    per = sizes.groupBy("_source").agg(F.sum("_size").alias("_source_size"), F.count("*").alias("_source_rows"))
    # Code point order is the order of the UTF-8 bytes.
    order = Window.orderBy(F.col("_source").isNull(), F.col("_source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("_w", weight)
    fill_key = F.col("_source_size") / F.col("_w")
    fill = Window.orderBy(fill_key, F.col("_source").isNull(), F.col("_source").cast("binary"))
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    words_before = F.coalesce(F.sum("_source_size").over(before), F.lit(0)) * cap
    weight_before = F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    # Water level if this source and all after it share what is left.
    level = (F.sum("_source_size").over(whole) * total - words_before) / (F.sum("_w").over(whole) - weight_before)
    per = per.withColumn("_level", level).withColumn("_full", F.col("_source_size") * cap <= F.col("_level") * F.col("_w"))
    open_level = F.min(F.when(~F.col("_full"), F.struct(fill_key, F.col("_level")))).over(whole)["_level"]
    target = F.when(F.col("_full"), F.col("_source_size") * cap).otherwise(open_level * F.col("_w"))
    return per.select("_source", "_source_size", "_source_rows", target.cast("double").alias("_target"))


def fly(p: np.ndarray, size: np.ndarray, draw: np.ndarray) -> np.ndarray:
    """Flight phase over one block; at most two values of the result are inside (0, 1)."""
    p = p.astype(float).tolist()
    size = size.tolist()
    live: list[int] = []
    edge = 1e-9
    k = 0
    for i in range(len(p)):
        if edge < p[i] < 1 - edge:
            live.append(i)
        if len(live) < 3:
            continue
        a, b, c = live
        u = (size[b] - size[c], size[c] - size[a], size[a] - size[b])
        if u == (0, 0, 0):
            u = (1, -1, 0)
        up = down = float("inf")
        for j, d in zip(live, u):
            if d > 0:
                up, down = min(up, (1 - p[j]) / d), min(down, p[j] / d)
            elif d < 0:
                up, down = min(up, p[j] / -d), min(down, (1 - p[j]) / -d)
        move = up if draw[k % len(draw)] * (up + down) < down else -down
        k += 1
        for j, d in zip(live, u):
            p[j] += move * d
            if p[j] <= edge:
                p[j] = 0.0
            elif p[j] >= 1 - edge:
                p[j] = 1.0
        live = [j for j in live if edge < p[j] < 1 - edge]
    return np.array(p)


def land(p: np.ndarray, size: np.ndarray, draw: float) -> np.ndarray:
    """Rounds the last undecided values (at most two) so that words and rows miss least."""
    p = p.copy()
    inside = np.flatnonzero((p > 0) & (p < 1))
    best = None
    for bits in range(1 << len(inside)):
        x = np.array([bits >> j & 1 for j in range(len(inside))], dtype=float)
        miss = x - p[inside]
        words_off, rows_off = abs(float((miss * size[inside]).sum())), abs(float(miss.sum()))
        key = (words_off, rows_off, bits ^ int(draw * 4))
        if best is None or key < best[0]:
            best = (key, x)
    if len(inside):
        p[inside] = best[1]
    return p


def _block(last: bool):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("_order")
        seed = int(rows["_order"][0].as_py()) % 2**32
        draw = np.random.RandomState(seed).random_sample(len(rows) + 1)
        size = rows["_weight"].to_numpy()
        p = fly(rows["_p"].to_numpy(), size, draw)
        if last:
            p = land(p, size, float(draw[-1]))
        return rows.set_column(rows.schema.get_field_index("_p"), "_p", pa.array(p))

    return run


def mix(sizes: DataFrame, stages: Stages, weights=WEIGHTS, total: float = TOTAL, cap: float = CAP, block: int = BLOCK) -> DataFrame:
    """_id, _source, _size, _source_size, _target, _takes: how often the mix takes each document.

    sizes: _id, _source, _size, one row per document. Rows that agree in all
    three are taken alike (they fly as one unit that weighs their words), and
    the result has one row for them. Null ids and null sources are values like
    others. Documents without words are never taken. Empty input gives no rows.
    """
    rows = stages.put(sizes)
    goal = stages.put(targets(rows, weights, total, cap))
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    units = rows.groupBy("_id", "_source", "_size").agg((F.count("*") * F.col("_size")).alias("_weight"))
    now = (
        units.join(goal.withColumnRenamed("_source", "_s"), F.col("_source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_whole", F.floor(ratio).cast("bigint"))
        .withColumn("_p", F.when(F.col("_size") > 0, ratio - F.floor(ratio)).otherwise(F.lit(0.0)))
        .withColumn("_order", F.xxhash64("_id", "_source", "_size", F.lit(SEED)))
    )
    blocks = int(goal.agg(F.max(F.ceil(F.col("_source_rows") / block))).first()[0] or 1)
    spread = F.ceil(F.col("_source_rows") / block)
    done = None
    turn = 0
    while True:
        last = blocks <= 1
        salt = F.lit(0) if last else F.pmod(F.xxhash64("_order", F.lit(turn)), F.greatest(spread, F.lit(1)))
        now = now.withColumn("_block", salt.cast("bigint"))
        now = stages.put(now.groupBy("_source", "_block").applyInArrow(_block(last), now.schema))
        part = now if last else now.where((F.col("_p") <= 0) | (F.col("_p") >= 1))
        done = part if done is None else done.unionByName(part)
        if last:
            break
        # At most two undecided units per block go on.
        now = now.where((F.col("_p") > 0) & (F.col("_p") < 1))
        turn += 1
        blocks = -(-2 * blocks // block)
        spread = F.ceil(F.col("_source_rows") * F.lit((2.0 / block) ** turn) / block)
    takes = F.col("_whole") + F.round("_p").cast("bigint")
    return done.select("_id", "_source", "_size", "_source_size", "_target", takes.alias("_takes"))


def mixed(docs: DataFrame, stages: Stages, **how) -> DataFrame:
    """doc_id, size, source_size, target and taken (words, repeats counted) for every row of docs."""
    sizes = stages.put(with_size(docs, ["doc_id", "source"]).toDF("_id", "_source", "_size"))
    plan = mix(sizes, stages, **how)
    return attach(sizes, plan).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_takes") * F.col("_size")).alias("taken"),
    )


def attach(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows (with _id, _source, _size) and the columns that mix() found for them."""
    p = plan.select(*[F.col(c).alias(f"_p{c}") for c in ("_id", "_source", "_size")], "_source_size", "_target", "_takes")
    same = (
        F.col("_id").eqNullSafe(F.col("_p_id"))
        & F.col("_source").eqNullSafe(F.col("_p_source"))
        & (F.col("_size") == F.col("_p_size"))
    )
    return rows.join(p, same).drop("_p_id", "_p_source", "_p_size")


def taken(docs: DataFrame, stages: Stages, **how) -> DataFrame:
    """The rows of docs that the mix takes, columns unchanged, with ``takes``, how often (1 or more).

    A column of that name in docs gives way to the mix's.
    """
    columns = [c for c in docs.columns if c != "takes"]
    sized = with_size(docs, columns)
    names = [f"_c{i}" for i in range(len(columns))]
    key = {"_id": F.col(names[columns.index("doc_id")]), "_source": F.col(names[columns.index("source")])}
    small = with_size(docs, ["doc_id", "source"]).toDF("_id", "_source", "_size")
    plan = mix(small, stages, **how).where(F.col("_takes") > 0)
    rows = sized.select("*", *[c.alias(n) for n, c in key.items()])
    return attach(rows, plan).select(*[F.col(n).alias(c) for c, n in zip(columns, names)], F.col("_takes").alias("takes"))
