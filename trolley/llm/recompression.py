"""Repeated passages by recompression of word sequences.

A text is a sequence of words, each named by a hash. A round of recompression
names every maximal run of one symbol, then every pair (left, right) whose
symbols fall on the left and right side of a coin that depends on the symbol
alone. Names are hashes of what they stand for, so all tasks give equal
substrings the same symbols, except near their ends: there a run may go on, or
a symbol may pair with one outside. Each symbol therefore carries the stretch
of words that decides it. If that lies inside a window of words, every equal
window has the same symbol at the same place.

Every window of ``width`` words takes as its anchor the best symbol decided
inside it (of the highest level that has one; then the longest, then by hash,
then the leftmost), named together with the words that decide it. At level 0 every word decides itself, so an anchor always
exists, and equal windows have equal anchors. Neighbouring windows mostly share
theirs, so a text gives one row for about every ten words, not one for each.

1. Anchor names are counted; a window whose anchor occurs once is unique.
2. Anchors that occur again are compared by the words of all their windows
   (segments). Equal segments repeat as a whole: only the first one stays.
3. Anchors whose segments differ, at the ends of repeats, are compared window
   by window, for one segment of each kind.
4. Each document gets its list of repeated stretches and drops their words.

Counting and the choice of the first occurrence are grouped sums and minima,
combined in the map tasks; matches come back by equi-joins whose hot keys Spark
splits. No group is ever gathered but the stretches of a single text: rows that
repeat an id, or have none, are told apart by a hash of their text, and equal rows
share one list. Names and contents are hashed to 64 bits each; windows must agree in both.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages
from .packing import pack, unpack
from .tokens import Words, chunks, mix, pieces, powers, words

WIDTH = 20
ROUNDS = 2

_ONE, _TWO = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)


class Contents:
    """Hashes of stretches of words, from sums over all words before them."""

    def __init__(self, h: np.ndarray):
        self.p, self.inverse = powers(len(h) + 1)
        self.total = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(mix(h ^ _ONE) * self.p[: len(h)], out=self.total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def rounds(h: np.ndarray, first: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Levels of the parse: (names, words in each symbol, start and end of the deciding stretch).

    first: bounds of the texts in words. A symbol that depends on a text's edge
    gets a stretch that reaches beyond the edge, so no window holds it.
    """
    name, start = h, np.arange(len(h))
    low, high = start.copy(), start + 1
    edge = np.zeros(len(h) + 1, dtype=bool)
    edge[first] = True
    # Bounds of the text that holds each word.
    text_starts = np.repeat(first[:-1], np.diff(first))
    text_ends = np.repeat(first[1:], np.diff(first))
    yield name, np.ones(len(h), dtype=np.int64), low, high
    for r in range(n):
        # Runs: a block ends where the symbol changes or the text ends.
        new = np.ones(len(name), dtype=bool)
        new[1:] = (name[1:] != name[:-1]) | edge[start[1:]]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(name))
        count = end - begin
        block = np.where(count > 1, mix(name[begin] * _ONE + count.astype(np.uint64)), name[begin])
        # Decided together with the symbols on both sides, which must differ.
        text_start, text_end = text_starts[start[begin]], text_ends[start[begin]]
        last_word = np.append(start[end[:-1]], len(h))
        at_front, at_back = start[begin] == text_start, last_word == text_end
        low = np.where(at_front, text_start - 1, low[np.maximum(begin - 1, 0)])
        high = np.where(at_back, text_end + 1, high[np.minimum(end, len(name) - 1)])
        name, start = block, start[begin]
        if not len(name):
            return
        # Pairs: a symbol on the left side with a follower on the right side.
        right = (mix(name ^ (_TWO + np.uint64(r))) & np.uint64(1)).astype(bool)
        front, back = at_front, at_back
        joins = np.zeros(len(name), dtype=bool)
        joins[:-1] = ~right[:-1] & right[1:] & ~back[:-1]
        taken = np.zeros(len(name), dtype=bool)
        taken[1:] = joins[:-1]
        before, after = np.maximum(np.arange(len(name)) - 1, 0), np.minimum(np.arange(len(name)) + 1, len(name) - 1)
        # A symbol left alone on the left side is decided by its follower too, on the right side by the one before.
        pair_low = np.where(right & ~joins, np.where(front, text_start - 1, low[before]), low)
        pair_high = np.where(~right, np.where(back, text_end + 1, high[after]), high)
        merged = mix(name * _ONE + np.append(name[1:], np.uint64(0)) * _TWO + np.uint64(r))
        keep = ~taken
        name = np.where(joins, merged, name)[keep]
        start, low, high = start[keep], pair_low[keep], pair_high[keep]
        size = np.append(start[1:], len(h)) - start
        yield name, size, low, high


def anchors(h: np.ndarray, first: np.ndarray, width: int = WIDTH, n: int = ROUNDS):
    """(first window, number of windows, anchor name) of the stretches of windows that share an anchor.

    A few texts at a time: the levels take many bytes for each word.
    """
    found = [([], [], np.zeros(0, dtype=np.uint64))]
    for a, b in pieces(first[:-1], first[1:]):
        lo, count, name = _anchors(h[first[a] : first[b]], first[a : b + 1] - first[a], width, n)
        found.append((lo + first[a], count, name))
    lo, count, name = (np.concatenate(x) for x in zip(*found))
    return lo.astype(np.int64), count.astype(np.int64), name


def _anchors(h: np.ndarray, first: np.ndarray, width: int, n: int):
    counts = np.maximum(np.diff(first) - width + 1, 0)
    if not counts.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(0, dtype=np.uint64)
    window = np.concatenate([np.arange(a, a + c) for a, c in zip(first[:-1], counts) if c])
    contents = Contents(h)
    best = np.zeros(len(window), dtype=np.uint64)
    which = np.full(len(window), -1, dtype=np.int64)
    offset = 0
    for level, (name, size, low, high) in reversed(list(enumerate(rounds(h, first, n)))):
        todo = np.flatnonzero(which < 0)
        if len(todo):
            p = window[todo]
            # Symbols of the level decided inside each window: both bounds rise along the level.
            a = _below(low, len(h))[p]
            b = _below(high, len(h) + 1)[p + width + 1]
            ok = b > a
            todo, a, b = todo[ok], a[ok], b[ok]
            if len(todo):
                salted = mix(name + np.uint64(level))
                rank = (np.uint64(7) - np.minimum(size, 7).astype(np.uint64)) << np.uint64(61) | salted >> np.uint64(3)
                at = _lowest(rank, a, b)
                which[todo] = at + offset
                # Named with all the words that decide it: they stand in every window it anchors.
                best[todo] = mix(salted[at] ^ contents.of(low[at], high[at]))
        offset += len(name)
    cut = np.ones(len(window), dtype=bool)
    cut[1:] = (which[1:] != which[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(cut)
    return window[begin], np.diff(np.append(begin, len(window))), best[begin]


def _below(values: np.ndarray, most: int) -> np.ndarray:
    """How many values (-1 at least) lie below 0, 1, ..., most + 1."""
    counts = np.bincount(values + 1, minlength=most + 2)
    return np.cumsum(counts)[: most + 2]


def _lowest(rank: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Position of the leftmost smallest rank in each range a .. b - 1, by doubling."""
    size = b - a
    power = np.frexp(size.astype(np.float64))[1] - 1
    out = np.zeros(len(a), dtype=np.int64)
    low, at = rank, np.arange(len(rank))
    k = 0
    while True:
        mine = np.flatnonzero(power == k)
        if len(mine):
            i, j = a[mine], b[mine] - (1 << k)
            out[mine] = np.where(low[j] < low[i], at[j], at[i])
        k += 1
        if k > power.max():
            return out
        half = 1 << (k - 1)
        x, y = low[:-half], low[half:]
        smaller = y < x
        low, at = np.where(smaller, y, x), np.where(smaller, at[half:], at[:-half])


def _long(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    """(_id, _x, _text); _x tells apart the texts of rows that repeat an id."""
    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_x"), F.col("text").alias("_text"))


def _same_text():
    return F.col("_id").eqNullSafe(F.col("_at")) & (F.col("_x") == F.col("_ax"))


def segments(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(_name, _seg, _id, _x, _lo, _n): stretches of windows sharing an anchor, of every text."""

    def run(batches):
        for b in batches:
            ids, marks = b.column("_id"), b.column("_x")
            for row, part in chunks(b.column("_text")):
                w = words(part)
                h = w.hashes()
                lo, n, name = anchors(h, w.first, width)
                text = np.searchsorted(w.first, lo, side="right") - 1
                whose = pa.array(text + row)
                yield pa.RecordBatch.from_arrays(
                    [
                        _long(name), _long(Contents(h).of(lo, lo + n + width - 1)), ids.take(whose), marks.take(whose),
                        pa.array((lo - w.first[text]).astype(np.int32)), pa.array(n.astype(np.int32)),
                    ],
                    names=["_name", "_seg", "_id", "_x", "_lo", "_n"],
                )

    return _texts(docs).mapInArrow(run, "_name bigint, _seg bigint, _id bigint, _x bigint, _lo int, _n int")


def repeats(docs: DataFrame, stages: Stages, width: int = WIDTH) -> DataFrame:
    """(_at, _ax, _cuts): for each text (id and _x) its stretches (lo, n, seg) of repeated windows.

    Windows lo .. lo + n - 1 also start earlier: in a document of smaller id, or
    further up in the same one. seg is the hash of their words.
    """
    found = segments(docs, width)
    # Written first: a join of two plain shuffles is one whose hot keys Spark can split.
    again = stages.put(found.groupBy("_name").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("_name").alias("_again")))
    found = stages.put(found.join(again, F.col("_name") == F.col("_again")).drop("_again"))
    here = F.struct("_id", "_lo")
    # The first place is the least (_id, _lo); _x only says in which text it is.
    first = F.min(F.struct("_id", "_lo", "_x"))
    kinds = stages.put(found.groupBy("_name", "_seg").agg(first.alias("_at"), F.first("_n").alias("_n"), F.count("*").alias("_c")))
    copied = kinds.where("_c > 1").select(
        F.col("_name").alias("_k"), F.col("_seg").alias("_s"), F.struct("_at._id", "_at._lo").alias("_first"), F.col("_at._x").alias("_fx")
    )
    same = (F.col("_name") == F.col("_k")) & (F.col("_seg") == F.col("_s"))
    later = here > F.col("_first")
    equal = found.join(copied, same).where(later | (F.col("_x") != F.col("_fx")))
    equal = stages.put(equal.select("_name", "_seg", "_id", "_x", "_lo", "_n", later.alias("_later")))
    whole = equal.where("_later").select("_id", "_x", "_lo", "_n", "_seg")
    # Other texts of the same id that hold the segment at the first place: no later than it, so they are judged as it is.
    beside = equal.where("not _later").drop("_later").distinct()
    # One segment of each kind, of the anchors that have several kinds, window by window.
    several = stages.put(kinds.groupBy("_name").agg(F.count("*").alias("_c")).where("_c > 1").select(F.col("_name").alias("_k")))
    ones = kinds.select("_name", "_seg", "_at.*", "_n").unionByName(beside)
    mixed = ones.join(several, F.col("_name") == F.col("_k")).select(
        F.col("_id").alias("_at"),
        F.col("_x").alias("_ax"),
        F.struct("_name", F.col("_lo").alias("lo"), F.col("_n").alias("n"), F.col("_seg").alias("seg")).alias("_part"),
    )
    mixed = mixed.groupBy("_at", "_ax").agg(F.collect_list("_part").alias("_parts"))
    windows = stages.put(pack(_texts(docs)).join(mixed, _same_text()).select("_id", "_x", "_z", "_zn", "_parts").mapInArrow(
        _windows(width), "_name bigint, _seg bigint, _id bigint, _x bigint, _lo int"
    ))
    first = windows.groupBy("_name", "_seg").agg(F.min(here).alias("_first"), F.max(here).alias("_last")).where("_first < _last")
    first = stages.put(first.select(F.col("_name").alias("_k"), F.col("_seg").alias("_s"), "_first"))
    single = windows.join(first, same).where(later).select("_id", "_x", "_lo", F.lit(1).alias("_n"), "_seg")
    cuts = whole.unionByName(single).groupBy(F.col("_id").alias("_at"), F.col("_x").alias("_ax"))
    stretch = F.struct(F.col("_lo").alias("lo"), F.col("_n").alias("n"), F.col("_seg").alias("seg"))
    # A set: equal rows of one id bring the same stretches.
    return stages.put(cuts.agg(F.collect_set(stretch).alias("_cuts")))


def _parts(column: pa.Array, fields: tuple[str, ...]) -> tuple[np.ndarray, ...]:
    """(row of each struct, its fields) of a list column."""
    column = column.fill_null([]) if column.null_count else column
    flat = column.flatten()
    return (np.repeat(np.arange(len(column)), column.value_lengths().to_numpy()), *(flat.field(f).to_numpy(zero_copy_only=False) for f in fields))


def _inside(w: Words, h: np.ndarray, row: np.ndarray, lo: np.ndarray, n: np.ndarray, seg: np.ndarray, width: int):
    """Which stretches stand in their text as recorded, and where."""
    at = w.first[row] + lo
    fits = at + n + width - 1 <= w.first[row + 1]
    contents = Contents(h)
    good = np.zeros(len(row), dtype=bool)
    good[fits] = contents.of(at[fits], (at + n + width - 1)[fits]).view(np.int64) == seg[fits]
    return good, at, contents


def _windows(width: int):
    def run(batches):
        for b in batches:
            for offset, part in unpack(b):
                w = words(part.fill_null(""))
                h = w.hashes()
                row, name, lo, n, seg = _parts(b.column("_parts").slice(offset, len(part)), ("_name", "lo", "n", "seg"))
                good, at, contents = _inside(w, h, row, lo.astype(np.int64), n.astype(np.int64), seg, width)
                row, name, at, n = row[good], name[good], at[good], n[good].astype(np.int64)
                whose = np.repeat(row, n) + offset
                each = np.repeat(at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(name, n)), _long(contents.of(each, each + width)),
                        b.column("_id").take(pa.array(whose)), b.column("_x").take(pa.array(whose)), pa.array((each - w.first[row]).astype(np.int32)),
                    ],
                    names=["_name", "_seg", "_id", "_x", "_lo"],
                )

    return run


def cut(docs: DataFrame, stages: Stages, columns: list[str], texts: bool, width: int = WIDTH) -> DataFrame:
    """Rows of docs as _c0, _c1, ... (columns but the text) with _n_words, _n_removed and, as asked for, _kept or _sha.

    _kept: the text itself if nothing is removed, else the kept words joined by
    one space. _sha: SHA-256 of the kept words joined by one space.
    """
    names = [f"_c{i}" for i in range(len(columns))]
    found = repeats(docs, stages, width)
    # The text moves once, compressed; as a column of the result it is _kept.
    source = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(columns, names) if c != "text"],
        F.col("doc_id").cast("bigint").alias("_id"),
        F.xxhash64("text").alias("_x"),
        F.col("text").alias("_text"),
    )
    names = [n for c, n in zip(columns, names) if c != "text"]
    joined = pack(source).join(found, _same_text(), "left").drop("_at", "_ax", "_id", "_x")
    last = "_kept" if texts else "_sha"

    def run(batches):
        for b in batches:
            for offset, part in unpack(b):
                w = words(part.fill_null(""))
                h = w.hashes()
                row, lo, n, seg = _parts(b.column("_cuts").slice(offset, len(part)), ("lo", "n", "seg"))
                good, at, _ = _inside(w, h, row, lo.astype(np.int64), n.astype(np.int64), seg, width)
                # Words under any repeated window: a running sum of stretches that begin and end.
                step = np.zeros(len(h) + 1, dtype=np.int64)
                np.add.at(step, at[good], 1)
                np.add.at(step, at[good] + n[good] + width - 1, -1)
                keep = np.cumsum(step)[: len(h)] == 0
                kept_before = np.concatenate(([0], np.cumsum(keep)))
                kept = kept_before[w.first[1:]] - kept_before[w.first[:-1]]
                out = []
                for d, text in enumerate(part.to_pylist()):
                    whole = kept[d] == w.counts[d]
                    if texts and whole:
                        out.append(text)
                        continue
                    found = (text or "").encode("utf-8", "surrogatepass").split()
                    stay = found if whole else compress(found, keep[w.first[d] : w.first[d + 1]].tolist())
                    joined_words = b" ".join(stay)
                    out.append(joined_words.decode("utf-8", "surrogatepass") if texts else hashlib.sha256(joined_words).hexdigest())
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).slice(offset, len(part)) for c in names]
                    + [pa.array(w.counts.astype(np.int64)), pa.array((w.counts - kept).astype(np.int64)), pa.array(out, pa.string())],
                    names=[*names, "_n_words", "_n_removed", last],
                )

    kept_fields = [T.StructField(c, joined.schema[c].dataType) for c in names]
    more = [T.StructField("_n_words", T.LongType()), T.StructField("_n_removed", T.LongType()), T.StructField(last, T.StringType())]
    return joined.mapInArrow(run, T.StructType(kept_fields + more))


def dedup_report(docs: DataFrame, stages: Stages, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row of docs (doc_id, text).

    Null, empty and wordless texts have 0 words and the hash of nothing. A null
    doc_id is smaller than all others. Rows that repeat a doc_id are the same
    document: their windows are earlier or later by their start alone, so equal
    rows keep each other's words.
    """
    return cut(docs, stages, ["doc_id"], texts=False, width=width).toDF("doc_id", "n_words", "n_removed", "kept_sha256")


def without_repeats(docs: DataFrame, stages: Stages, width: int = WIDTH) -> DataFrame:
    """docs with the repeated passages cut from text (n_chars follows); texts that lose every word go."""
    columns = docs.columns
    done = cut(docs, stages, columns, texts=True, width=width)
    alive = done.where((F.col("_n_removed") == 0) | (F.col("_n_removed") < F.col("_n_words")))
    out = []
    for i, c in enumerate(columns):
        if c == "text":
            column = F.col("_kept")
        elif c == "n_chars":
            column = F.when(F.col("_n_removed") > 0, F.length("_kept").cast("bigint")).otherwise(F.col(f"_c{i}"))
        else:
            column = F.col(f"_c{i}")
        out.append(column.alias(c))
    return alive.select(*out)
