"""Benchmark decontamination: greedy string tiling of benchmark passages.

Words are lower-cased and stripped of ASCII punctuation. A document and a
benchmark item that share a seed of SEED_WORDS consecutive words are tiled:
Karp-Rabin hashes find the longest match of unmarked words on both sides, it
is marked, and so on down to matches of SEED_WORDS words, so passages whose
parts come in another order are caught too. The share of the item's words that
is marked is its coverage; items covered by at least MIN_COVER are leaks.

Both sides meet in joins, so neither has to fit anywhere:

1. items become word hashes and their seeds a table; a bitmap of the seeds, of
   at most 2^MAX_BITS bits, is broadcast;
2. one pass over the documents keeps those with seeds that the bitmap lets
   through, as word hashes with the places of these seeds;
3. these places are joined with the items' seeds. A tile of L words holds L - k + 1
   seeds of k words, so a pair of document and item whose shared seeds cannot
   reach the coverage is dropped before anything else is moved to it;
4. what is left is tiled, a row for each document and item.

A seed that many items or documents have is a hot key of plain joins of written
tables, which Spark splits. A larger benchmark means more rows, not more passes.

Edge cases: null and empty texts leak nothing; null or wordless items are never
leaked; items of fewer words than a seed must stand there whole; repeated rows
give repeated results; a null doc_id or item_id is an id like others; very long
texts are read whole, by chunks; an empty benchmark or no documents give no rows.
Columns are renamed first, so other columns' names cannot clash.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .tokens import NOT_ALNUM, chunks, phrases, words

SEED_WORDS = 4
MIN_COVER = 0.6
#: Bits of the broadcast bitmap, as powers of two (8 MB at most), and the tasks that make it.
MIN_BITS, MAX_BITS, BITMAP_PARTS = 20, 26, 4


def tile(text: np.ndarray, item: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two sequences of word hashes: (start in text, start in item, words).

    The length looked for starts at the longest possible match and falls to
    ``least``; for each length, Karp-Rabin hashes of the item's unmarked
    stretches are looked up for the text's unmarked stretches.
    """
    least = max(1, min(least, len(item)))
    marked_text, marked_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    tiles: list[tuple[int, int, int]] = []
    size = longest(text, item, marked_text, marked_item, least)
    while size >= least:
        places = defaultdict(list)
        for p, s in open_phrases(item, marked_item, size):
            places[s].append(p)
        for t, s in open_phrases(text, marked_text, size):
            for p in places.get(s, ()):
                if marked_text[t : t + size].any():
                    break
                if not marked_item[p : p + size].any() and (text[t : t + size] == item[p : p + size]).all():
                    marked_text[t : t + size] = True
                    marked_item[p : p + size] = True
                    tiles.append((t, p, size))
        if marked_item.all():
            break
        size = longest(text, item, marked_text, marked_item, least, size - 1)
    return tiles


def open_phrases(h: np.ndarray, marked: np.ndarray, k: int) -> Iterator[tuple[int, int]]:
    """(start, Karp-Rabin hash) of the k-word stretches without a marked word."""
    if len(h) < k:
        return
    total = np.concatenate(([0], np.cumsum(marked)))
    free = np.flatnonzero(total[k:] == total[:-k])
    s = phrases(h, k, seed=3)
    yield from zip(free.tolist(), s[free].tolist())


def longest(text, item, marked_text, marked_item, least: int, most: int | None = None) -> int:
    """Length of the longest unmarked match, by bisection; 0 if below ``least``."""
    low, high = least - 1, len(item) if most is None else most
    while low < high:
        mid = (low + high + 1) // 2
        there = {s for _, s in open_phrases(item, marked_item, mid)}
        if there and any(s in there for _, s in open_phrases(text, marked_text, mid)):
            low = mid
        else:
            high = mid - 1
    return low if low >= least else 0


def near(starts: np.ndarray, n: int, margin: int) -> np.ndarray:
    """Positions of a text of n words within margin of a shared seed.

    Every match of at least a seed's length lies there, so the rest need not be tiled.
    """
    keep = np.zeros(n + 1, dtype=np.int64)
    np.add.at(keep, np.maximum(starts - margin, 0), 1)
    np.add.at(keep, np.minimum(starts + margin, n), -1)
    return np.flatnonzero(np.cumsum(keep)[:n] > 0)


def tiles_near(text: np.ndarray, item: np.ndarray, starts: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """tile() over the stretches of a text that lie near a shared seed (starts count in those stretches)."""
    at = near(starts, len(text), len(item) + k)
    piece = text[at]
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    # A gap between two stretches must not join them.
    return tile(np.insert(piece, cut, np.uint64(0)) if len(cut) else piece, item, k)


def items_of(benchmark: DataFrame, seed_words: int = SEED_WORDS) -> DataFrame:
    """(_item, _id, _words, _k): distinct items with words; their word hashes and the length of their seeds."""

    def run(batches):
        for b in batches:
            for row, part in chunks(b.column("_text")):
                w = words(part, NOT_ALNUM, lower=True)
                h, n = w.hashes(), w.counts
                some = np.flatnonzero(n)
                at = pa.array(some + row)
                raw = [h[w.first[i] : w.first[i + 1]].tobytes() for i in some]
                k = np.minimum(seed_words, n[some]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [b.column("_item").take(at), b.column("_id").take(at), pa.array(raw, pa.binary()), pa.array(k)],
                    names=["_item", "_id", "_words", "_k"],
                )

    rows = benchmark.where(F.col("text").isNotNull()).select(F.col("item_id").cast("bigint").alias("_id"), F.col("text").alias("_text"))
    named = rows.distinct().select(F.xxhash64("_id", "_text", F.md5(F.col("_text").cast("binary"))).alias("_item"), "_id", "_text")
    return named.mapInArrow(run, "_item bigint, _id bigint, _words binary, _k int")


def item_seeds(items: DataFrame) -> DataFrame:
    """(_seed, _item, _times): the seeds of each item and how often it has them."""

    def run(batches):
        for b in batches:
            for item, raw, k in zip(b.column("_item"), b.column("_words"), b.column("_k").to_pylist()):
                s, n = np.unique(phrases(np.frombuffer(raw.as_buffer(), dtype=np.uint64), k, seed=k), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(s.view(np.int64)), pa.array(np.full(len(s), item.as_py())), pa.array(n.astype(np.int64))],
                    names=["_seed", "_item", "_times"],
                )

    return items.select("_item", "_words", "_k").mapInArrow(run, "_seed bigint, _item bigint, _times bigint")


class Bitmap:
    """Set of 64-bit hashes, with false positives: two bits each."""

    def __init__(self, bits: int, raw: np.ndarray | None = None):
        self.bits = bits
        self.raw = np.zeros(1 << (bits - 3), dtype=np.uint8) if raw is None else raw

    def _places(self, s: np.ndarray) -> Iterator[np.ndarray]:
        shift = np.uint64(64 - self.bits)
        yield (s >> shift).astype(np.int64)
        yield (s * np.uint64(0x9E3779B97F4A7C15) >> shift).astype(np.int64)

    def add(self, s: np.ndarray) -> None:
        for p in self._places(s):
            np.bitwise_or.at(self.raw, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))

    def has(self, s: np.ndarray) -> np.ndarray:
        first, second = self._places(s)
        at = np.flatnonzero(self.raw[first >> 3] >> (first & 7).astype(np.uint8) & 1)
        p = second[at]
        return at[(self.raw[p >> 3] >> (p & 7).astype(np.uint8) & 1) > 0]


def bitmap_of(seeds: DataFrame) -> Bitmap:
    """Bitmap of a table's seeds, made in BITMAP_PARTS tasks; about 16 bits a seed, up to 2^MAX_BITS in all."""
    n = seeds.count()
    bits = min(MAX_BITS, max(MIN_BITS, (16 * n).bit_length()))

    def run(batches):
        found = Bitmap(bits)
        for b in batches:
            found.add(b.column("_seed").to_numpy().view(np.uint64))
        yield pa.RecordBatch.from_arrays([pa.array([found.raw.tobytes()], pa.binary())], names=["raw"])

    out = Bitmap(bits)
    for r in seeds.select("_seed").repartition(BITMAP_PARTS).mapInArrow(run, "raw binary").collect():
        out.raw |= np.frombuffer(r["raw"], dtype=np.uint8)
    return out


def seeded(docs: DataFrame, key: list[str], lengths: list[int], bitmap: Bitmap) -> DataFrame:
    """(_d, _k0..., _words, _seeds, _at): documents with seeds that the bitmap lets through.

    _d numbers these rows; key columns are renamed _k0, ...; _seeds and _at are
    the seeds and where they start.
    """
    names = [f"_k{i}" for i in range(len(key))]
    source = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(key, names)], F.col("text").alias("_text"))
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches):
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            for offset, part in chunks(b.column("_text")):
                w = words(part, NOT_ALNUM, lower=True)
                h = w.hashes()
                hits = []
                for k in lengths:
                    s = phrases(h, k, seed=k)
                    at = sent.value.has(s)
                    if len(at):
                        row = np.searchsorted(w.first, at, "right") - 1
                        inside = at + k <= w.first[row + 1]
                        hits.append((row[inside], at[inside] - w.first[row[inside]], s[at[inside]]))
                if not hits:
                    continue
                row, at, s = (np.concatenate(c) for c in zip(*hits))
                order = np.argsort(row, kind="stable")
                row, at, s = row[order], at[order], s[order]
                some, first = np.unique(row, return_index=True)
                if not len(some):
                    continue
                ends = pa.array(np.append(first, len(row)).astype(np.int32))
                raw = [h[w.first[i] : w.first[i + 1]].tobytes() for i in some]
                ids = np.arange(number, number + len(some))
                number += len(some)
                take = pa.array(some + offset)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids), *(b.column(n).take(take) for n in names), pa.array(raw, pa.binary()),
                     pa.ListArray.from_arrays(ends, pa.array(s.view(np.int64))), pa.ListArray.from_arrays(ends, pa.array(at.astype(np.int64)))],
                    names=["_d", *names, "_words", "_seeds", "_at"],
                )

    kept = "".join(f"{n} {source.schema[n].dataType.simpleString()}, " for n in names)
    return source.mapInArrow(run, f"_d bigint, {kept}_words binary, _seeds array<bigint>, _at array<bigint>")


def leaks(docs: DataFrame, benchmark: DataFrame, key: list[str], stages: Stages | None = None, seed_words: int = SEED_WORDS,
          min_cover: float = MIN_COVER) -> DataFrame:
    """key columns (renamed _k0, ...) with item_id, n_item_words, n_covered, n_tiles, coverage.

    One row for each row of docs and benchmark item that it leaks.
    """
    spark = docs.sparkSession
    stages = stages or Stages(spark, "leaks")
    names = [f"_k{i}" for i in range(len(key))]
    items = stages.put(items_of(benchmark, seed_words))
    seeds = stages.put(item_seeds(items))
    lengths = sorted(r["_k"] for r in items.select("_k").distinct().collect())  # seed_words values at most
    found = stages.put(seeded(docs, key, lengths, bitmap_of(seeds)))
    # A row for each place; the join's other side is a written table, too.
    hits = found.select("_d", F.explode(F.arrays_zip(F.col("_seeds").alias("s"), F.col("_at").alias("at"))).alias("h")).select("_d", "h.s", "h.at")
    met = hits.join(seeds, F.col("s") == F.col("_seed")).groupBy("_d", "_item", "s").agg(F.first("_times").alias("_times"), F.collect_list("at").alias("_starts"))
    pairs = met.groupBy("_d", "_item").agg(F.sum("_times").alias("_shared"), F.flatten(F.collect_list("_starts")).alias("_starts"))
    size = (F.octet_length("_words") / 8).cast("bigint")
    # Tiles of k words or more that cover a share c of n words start at c * n / k of the item's places at least.
    enough = F.col("_shared") * F.col("_k") >= F.ceil(F.lit(min_cover) * size)
    pairs = stages.put(pairs.join(items.select("_item", "_k", "_words"), "_item").where(enough).select("_d", "_item", "_starts"))
    item = items.select("_item", F.col("_id").alias("item_id"), F.col("_words").alias("_item_words"), "_k")
    rows = pairs.join(found.select("_d", *names, "_words"), "_d").join(item, "_item")
    kinds = {n: found.schema[n].dataType.simpleString() for n in names}
    out = "".join(f"{n} {t}, " for n, t in kinds.items())
    return rows.select(*names, "item_id", "_words", "_item_words", "_k", "_starts").mapInArrow(
        _tiler(names, min_cover), f"{out}item_id bigint, n_item_words bigint, n_covered bigint, n_tiles bigint, coverage double"
    )


def _tiler(names: list[str], min_cover: float):
    def run(batches):
        for b in batches:
            keep, found = [], []
            for row in range(b.num_rows):
                h, item = (np.frombuffer(b.column(c)[row].as_buffer(), dtype=np.uint64) for c in ("_words", "_item_words"))
                starts = np.asarray(b.column("_starts")[row].as_py(), dtype=np.int64)
                tiles = tiles_near(h, item, starts, b.column("_k")[row].as_py())
                covered = sum(t[2] for t in tiles)
                if covered >= min_cover * len(item):
                    keep.append(row)
                    found.append((len(item), covered, len(tiles), covered / len(item)))
            at = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column(n).take(at) for n in (*names, "item_id")]
                + [pa.array([f[j] for f in found], pa.int64() if j < 3 else pa.float64()) for j in range(4)],
                names=[*names, "item_id", "n_item_words", "n_covered", "n_tiles", "coverage"],
            )

    return run


def leaking_documents(docs: DataFrame, benchmark: DataFrame, stages: Stages | None = None, **how) -> DataFrame:
    """One row for each leaking doc_id: n_items, item_ids (sorted), coverage of its best item."""
    found = leaks(docs, benchmark, ["doc_id"], stages, **how).withColumnRenamed("_k0", "doc_id")
    return found.groupBy("doc_id").agg(
        F.countDistinct("item_id").alias("n_items"),
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.max("coverage").alias("coverage"),
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, stages: Stages | None = None, **how) -> DataFrame:
    """Rows of docs that leak no benchmark item, columns unchanged.

    Equal texts leak alike, so what leaks is known by a hash of the text.
    """
    stages = stages or Stages(docs.sparkSession, "leaks")
    names = [f"_c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*names)
    mark = F.md5(F.col(names[docs.columns.index("text")]).cast("binary"))
    marked = plain.select(mark.alias("mark"), F.col(names[docs.columns.index("text")]).alias("text"))
    gone = stages.put(leaks(marked, benchmark, ["mark"], stages, **how).select(F.col("_k0").alias("_gone")).distinct())
    return plain.join(gone, mark == F.col("_gone"), "left_anti").toDF(*docs.columns)
