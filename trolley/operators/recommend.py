"""Naive Bayes recommendations: score the items missing from a basket.

score(X | cart) = P(X) * prod over cart items A with a rule (A, X) of
P(A given X). Ranking uses logs: ln P(X) + sum ln conf(A, X), rounded to 9
places, descending, unscored ones last, ties by item.

Three variants:
  classic  — X without any rule from the cart is not listed;
  subset   — as the job wrote it: such X is listed with score 0 (null log);
  best     — the best non-empty subset of the cart: all factors above 1, or
             the single largest factor when none is (a closed form of the
             subset search, exact for carts of any length).

Plan. The rule vocabulary (items of any rule; at most mean basket size / item
support of them) is numbered, and each item has one row vector over it: ln
confidence of the rule to each candidate, as an integer (see ``scale``).
Baskets are dealt into groups, and each group gets the vectors once; no row
carries one. Only a vocabulary whose vectors do not fit a task (over WHOLE numbers)
meets the items in a join instead, a vector beside each, gathered per basket.
Integers add up exactly in any order, so a held-out label's scores are the
basket's sum minus the label's own vector, and leave-one-out needs no second pass
over the rules. Adding, subtracting and taking the n best run on whole Arrow
batches in numpy: as rows, every sample has as many candidates as the vocabulary
has items, and sorting those takes Spark tens of times longer (see README).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BasketConfig
from ..plans.groups import WHOLE, with_whole
from ..session import ship

VARIANTS = ("classic", "subset", "best")

#: Scores are ranked by this many parts of one (9 decimal places).
RANKED = 10**9
#: Marks: no rule in a vector, a candidate without a score, a candidate that is not listed.
NO_RULE = UNSCORED = np.int64(-(2**62))
UNLISTED = np.int64(-(2**63))
#: Numbers of a block's vectors handled at a time; lists up to this length are found by repeated maxima.
BLOCK_CELLS, FEW = 1 << 21, 16
#: The same where the vectors are at hand and blocks can be as small as a core's cache.
GROUP_CELLS = 1 << 17


def variant_of(cfg: BasketConfig) -> str:
    return "subset" if cfg.subset else "classic"


def with_id(baskets: DataFrame) -> DataFrame:
    """baskets with basket_id, a key that is never null.

    The receipt's keys as text (a null register is left out of it), or the
    items themselves where distinct baskets have no receipt.
    """
    no_receipt = F.col("register").isNull() & F.col("receipt").isNull()
    key = F.when(no_receipt, F.to_json("items")).otherwise(F.to_json(F.struct("register", "receipt")))
    return baskets.withColumn("basket_id", key)


def log_prob(rule_items: DataFrame, item_freq: DataFrame, n_baskets: Column) -> DataFrame:
    """(x, lnp): ln P(X) of the rule vocabulary (raw frequency)."""
    return rule_items.join(item_freq, "item").select(F.col("item").alias("x"), F.ln(F.col("freq") / n_baskets).alias("lnp"))


def scale(n: int) -> int:
    """Parts of one that logs are counted in, for n vocabulary items: as fine as their sum fits 64 bits.

    A basket has at most n terms, and no log of a count's share is beyond 40.
    """
    return 10 ** (len(str(2**61 // (40 * (n + 2)))) - 1)


def rule_vectors(rules: DataFrame, lnp: DataFrame) -> DataFrame:
    """(item, idx, lnp, terms): the vocabulary numbered from 0 in item order, with each item's row vector.

    terms holds as many 64-bit integers as there are vocabulary items: ln
    confidence of the rule from this item to each of them, NO_RULE without one;
    lnp is ln P of this item.
    """
    ship(rules.sparkSession)
    listed = lnp.agg(F.array_sort(F.collect_list(F.struct(F.col("x").alias("item"), "lnp"))).alias("v"))
    vocab = listed.select(F.size("v").alias("n"), F.posexplode("v").alias("idx", "e")).select("n", "idx", "e.item", "e.lnp")
    to = vocab.select(F.col("item").alias("b"), F.col("idx").alias("x"))
    links = rules.select("a", "b", F.ln("confidence").alias("l")).join(to, "b").select(F.col("a").alias("item"), "x", "l")
    lists = vocab.join(links, "item", "left").groupBy("item", "idx", "lnp", "n").agg(
        F.collect_list(F.when(F.col("x").isNotNull(), F.struct("x", "l"))).alias("links")
    )
    return lists.mapInArrow(_dense, "item string, idx int, lnp long, terms binary")


def _dense(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def parts(logs: np.ndarray, n: int) -> np.ndarray:
        return np.rint(logs * float(scale(n))).astype(np.int64)

    for b in batches:
        n = b.column("n").to_numpy()
        terms = []
        for size, links in zip(n.tolist(), b.column("links")):
            v = np.full(size, NO_RULE, dtype=np.int64)
            if len(links.values):
                v[links.values.field("x").to_numpy()] = parts(links.values.field("l").to_numpy(), size)
            terms.append(v.tobytes())
        lnp = parts(b.column("lnp").to_numpy(), int(n[0])) if len(n) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("item"), b.column("idx"), pa.array(lnp), pa.array(terms, pa.binary())], names=["item", "idx", "lnp", "terms"]
        )


def _column(vectors: DataFrame, name: str) -> Column:
    """One column of the vocabulary as an array in item order, a scalar subquery."""
    rows = vectors.agg(F.array_sort(F.collect_list(F.struct("idx", name))).alias("v"))
    return rows.select(F.transform("v", lambda r: r[name])).scalar()


def gathered(baskets: DataFrame, vectors: DataFrame) -> DataFrame:
    """(register, receipt, own, lnp): own holds (idx, terms) of the basket's vocabulary items."""
    ship(baskets.sparkSession)
    # Dealt by basket before the join: if Spark broadcasts the vectors, nothing wide is shuffled. The number of
    # partitions is given so that few narrow rows still spread over all cores: the work is in what they meet.
    parts = int(baskets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = with_id(baskets).select("basket_id", "register", "receipt", "items").repartition(parts, "basket_id")
    evidence = dealt.select("basket_id", "register", "receipt", F.explode_outer("items").alias("item"))
    met = evidence.join(vectors.select("item", "idx", "terms"), "item", "left")
    own = F.collect_list(F.when(F.col("idx").isNotNull(), F.struct("idx", "terms")))
    # One basket per id, so its other columns are the same in all its rows.
    rows = met.groupBy("basket_id", "register", "receipt").agg(own.alias("own"))
    return rows.select("register", "receipt", "own", _column(vectors, "lnp").alias("lnp"))


class Block:
    """Some baskets' vocabulary items and their vectors: row e of ``terms`` belongs to basket ``basket[e]``."""

    def __init__(self, first: np.ndarray, idx: np.ndarray, terms: np.ndarray, lnp: np.ndarray):
        self.first, self.idx, self.terms, self.lnp = first, idx, terms, lnp
        self.counts = np.diff(first)
        self.basket = np.repeat(np.arange(len(self.counts)), self.counts)
        self.has = terms != NO_RULE
        self.value = np.where(self.has, terms, 0)

    def per_basket(self, cells: np.ndarray, add: np.ufunc = np.add, empty: int = 0) -> np.ndarray:
        out = np.full((len(self.counts), len(self.lnp)), empty, dtype=np.int64)
        full = self.counts > 0
        if full.any():
            out[full] = add.reduceat(cells, self.first[:-1][full], axis=0)
        return out

    def own(self) -> np.ndarray:
        mine = np.zeros((len(self.counts), len(self.lnp)), dtype=bool)
        mine[self.basket, self.idx] = True
        return mine

    def best(self) -> np.ndarray:
        """Per basket: the sum of positive terms, else the largest term, else NO_RULE."""
        positive = self.per_basket(np.maximum(self.value, 0))
        return np.where(positive > 0, positive, self.per_basket(self.terms, np.maximum, NO_RULE))

    def basket_scores(self, variant: str) -> np.ndarray:
        if variant == "best":
            best = self.best()
            return np.where(best == NO_RULE, UNSCORED, best + self.lnp)
        counts = self.per_basket(self.has.astype(np.int64))
        return np.where(counts > 0, self.per_basket(self.value) + self.lnp, UNSCORED)

    def sample_scores(self, variant: str) -> np.ndarray:
        """Scores of every basket without one of its items: one row per vector."""
        if variant == "best":
            out = np.full(self.terms.shape, UNSCORED)
            for e, b in enumerate(self.basket):
                rest = np.arange(self.first[b], self.first[b + 1])
                rest = rest[rest != e]
                if len(rest):
                    out[e] = Block(np.array([0, len(rest)]), self.idx[rest], self.terms[rest], self.lnp).basket_scores(variant)[0]
            return out
        counts = self.per_basket(self.has.astype(np.int64))[self.basket] - self.has
        sums = self.per_basket(self.value)[self.basket] - self.value
        return np.where(counts > 0, sums + self.lnp, UNSCORED)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[int, Block]]:
    """(first row, block) of a batch of gathered(), of about BLOCK_CELLS numbers each."""
    if not batch.num_rows:
        return
    lnp = np.array(batch.column("lnp")[0].as_py() or [], dtype=np.int64)
    own = batch.column("own")
    offsets = own.offsets.to_numpy()
    wanted = max(1, BLOCK_CELLS // max(1, len(lnp)))
    row = 0
    while row < batch.num_rows:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + wanted, side="right")) - 1)
        end = min(end, batch.num_rows, row + wanted)
        part = own.values.slice(offsets[row], offsets[end] - offsets[row])
        raw = b"".join(part.field("terms").to_pylist())
        terms = np.frombuffer(raw, dtype=np.int64).reshape(len(part), len(lnp))
        yield row, Block(offsets[row : end + 1].astype(np.int64) - offsets[row], part.field("idx").to_numpy(), terms, lnp)
        row = end


def _group_blocks(rows: pa.Table, table: pa.Table) -> Iterator[tuple[int, Block]]:
    """(first row, block) of a group's baskets, with the vectors (in idx order) of their vocabulary items."""
    lnp = table["lnp"].to_numpy()
    terms = np.frombuffer(b"".join(table["terms"].to_pylist()), dtype=np.int64).reshape(len(lnp), len(lnp))
    items = rows["items"].combine_chunks()
    items = items.chunk(0) if isinstance(items, pa.ChunkedArray) else items
    found = pc.index_in(items.flatten(), value_set=table["item"].combine_chunks())
    known = found.is_valid().to_numpy(zero_copy_only=False)
    idx = found.drop_null().to_numpy()
    sizes = pc.fill_null(pc.list_value_length(items), 0).to_numpy()
    before = np.concatenate(([0], np.cumsum(known)))
    first = before[np.concatenate(([0], np.cumsum(sizes)))]
    wanted = max(1, min(BLOCK_CELLS, GROUP_CELLS) // max(1, len(lnp)))
    row = 0
    while row < rows.num_rows:
        end = max(row + 1, int(np.searchsorted(first, first[row] + wanted, side="right")) - 1)
        end = min(end, rows.num_rows, row + wanted)
        own = idx[first[row] : first[end]]
        yield row, Block(first[row : end + 1] - first[row], own, terms[own], lnp)
        row = end


def best_places(scores: np.ndarray, listed: np.ndarray, variant: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, kept): for each row of scores the numbers of its n best listed candidates, best first.

    Scores are compared by RANKED parts of one, ties by number; kept tells which places are filled.
    """
    unit = max(1, scale(scores.shape[1]) // RANKED)
    keys = (scores + unit // 2) // unit
    # An unscored candidate's key stays below all others; division by one number is faster than its remainder.
    keys[~listed | (scores == UNSCORED) if variant == "classic" else ~listed] = UNLISTED
    n = min(n, keys.shape[1])
    rows = np.arange(len(keys))
    if n > FEW:
        places = np.argsort(-1 - keys, axis=1, kind="stable")[:, :n]  # -1 - key turns the order without overflow
        return places, keys[rows[:, None], places] != UNLISTED
    places, kept = np.zeros((len(keys), n), dtype=np.int64), np.zeros((len(keys), n), dtype=bool)
    for r in range(n):
        places[:, r] = keys.argmax(axis=1) if keys.shape[1] else 0
        kept[:, r] = keys[rows, places[:, r]] != UNLISTED
        keys[rows, places[:, r]] = UNLISTED
    return places, kept


def _lists(scores: np.ndarray, places: np.ndarray, kept: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Places and scores as list columns; unscored ones are null."""
    offsets = pa.array(np.concatenate(([0], np.cumsum(kept.sum(axis=1)))).astype(np.int32))
    found = np.take_along_axis(scores, places, axis=1)[kept] if places.size else np.zeros(0, np.int64)
    logs = pa.array(found / scale(scores.shape[1]), pa.float64(), mask=found == UNSCORED)
    return pa.ListArray.from_arrays(offsets, pa.array(places[kept].astype(np.int32))), pa.ListArray.from_arrays(offsets, logs)


def _per_block(run: Callable[[Block], tuple[np.ndarray, list[pa.Array]]], names: list[str]):
    """A function over batches of gathered(): run gives the rows (in the block) its output rows belong to, and columns."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row, block in _blocks(b):
                at, columns = run(block)
                at = pa.array(at + row)
                yield pa.RecordBatch.from_arrays([b.column("register").take(at), b.column("receipt").take(at), *columns], names=names)

    return over


def _per_group(run: Callable[[Block], tuple[np.ndarray, list[pa.Array]]], names: list[str], places: tuple[str, ...]):
    """The same over groups of with_whole(); columns named in ``places`` get their items' names."""

    def over(rows: pa.Table, table: pa.Table) -> pa.Table:
        table = table.sort_by("idx").combine_chunks()
        items = table["item"].combine_chunks()
        out = []
        for row, block in _group_blocks(rows, table):
            at, columns = run(block)
            at = pa.array(at + row)
            named = [rows["register"].take(at), rows["receipt"].take(at)]
            for name, c in zip(names[2:], columns):
                if name in places:
                    c = pa.ListArray.from_arrays(c.offsets, items.take(c.values)) if pa.types.is_list(c.type) else items.take(c)
                named.append(c)
            out.append(pa.table(named, names=names))
        return pa.concat_tables(out)

    return over


def _keys(df: DataFrame) -> str:
    return ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in ("register", "receipt"))


def _check(variant: str) -> None:
    if variant not in VARIANTS:
        raise ValueError(f"unknown variant {variant}")


def _met(baskets: DataFrame, vectors: DataFrame, run, schema: str, places: tuple[str, ...], whole: int) -> DataFrame:
    """run over the blocks of all baskets: (register, receipt) and the columns of ``schema``, those in ``places`` as items."""
    names = ["register", "receipt", *(c.split()[0] for c in schema.split(", "))]
    n = vectors.count()
    if n * n <= whole:
        rows = baskets.select("register", "receipt", "items")
        named = ", ".join(c.replace("int", "string") if c.split()[0] in places else c for c in schema.split(", "))
        return with_whole(rows, rows.count(), vectors, n, _per_group(run, names, places), f"{_keys(rows)}, {named}")
    rows = gathered(baskets, vectors)
    out = rows.mapInArrow(_per_block(run, names), f"{_keys(rows)}, {schema}").withColumn("_names", _column(vectors, "item"))
    for p in places:
        listed = isinstance(out.schema[p].dataType, T.ArrayType)
        out = out.withColumn(p, F.transform(p, lambda i: F.get("_names", i)) if listed else F.get("_names", F.col(p)))
    return out.drop("_names")


def recommend(baskets: DataFrame, vectors: DataFrame, variant: str, n: int, whole: int = WHOLE) -> DataFrame:
    """(register, receipt, rank, item, log_score): the n best items that each basket lacks."""
    _check(variant)

    def run(block: Block):
        scores = block.basket_scores(variant)
        return np.arange(len(scores)), list(_lists(scores, *best_places(scores, ~block.own(), variant, n)))

    top = _met(baskets, vectors, run, "top array<int>, top_logs array<double>", ("top",), whole)
    z = F.arrays_zip(F.col("top").alias("item"), F.col("top_logs").alias("log_score"))
    out = top.select("register", "receipt", F.posexplode(z).alias("pos", "c"))
    return out.select(
        "register", "receipt", (F.col("pos") + 1).alias("rank"), F.col("c.item").alias("item"), F.col("c.log_score").alias("log_score")
    )


def ranked_samples(baskets: DataFrame, vectors: DataFrame, variant: str, n: int, whole: int = WHOLE) -> DataFrame:
    """(register, receipt, label, top_items, top_logs, hit_rank) of every leave-one-out sample.

    A sample is a basket of two items or more without one of its vocabulary
    items, the label. hit_rank is the label's place in the list, 0 if missing.
    """
    _check(variant)

    def run(block: Block):
        scores = block.sample_scores(variant)
        listed = ~block.own()[block.basket]
        # An item of the basket is a candidate only as the label held out.
        listed[np.arange(len(scores)), block.idx] = True
        places, kept = best_places(scores, listed, variant, n)
        hit = (places == block.idx[:, None]) & kept
        rank = np.where(hit.any(axis=1), hit.argmax(axis=1) + 1, 0) if hit.size else np.zeros(len(scores), np.int64)
        return block.basket, [pa.array(block.idx, pa.int32()), *_lists(scores, places, kept), pa.array(rank, pa.int32())]

    schema = "label int, top_items array<int>, top_logs array<double>, hit_rank int"
    return _met(baskets.where(F.size("items") > 1), vectors, run, schema, ("label", "top_items"), whole)
