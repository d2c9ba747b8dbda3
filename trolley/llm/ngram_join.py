"""N-gram Jaccard join: documents whose shingle sets overlap, by a prefix-tree join.

A document's set holds the hashes of its runs of SHINGLE words. Two documents
link when 4 * |A and B| >= 3 * |A or B| (Jaccard >= 0.75), so a set of n
shingles shares at least a = ceil(3n/4) of them with any partner.

1. Who can have a partner at all? With all shingles in one global order (of
   their hashes), a set's first n - a + l shingles hold at least l of those it
   shares, and so do its partner's. These prefixes are counted; documents with
   too few shingles that another prefix has too are out. l grows with n, so a
   few common lines do not keep a document in.
2. The rest meet in the rarest shingles of their prefixes: as partners share at
   least l of them, the l - 1 most frequent ones may be left out. Every such
   shingle ties its documents to the smallest one, a row per document and
   shingle, never a row per pair; connected documents are the candidates for
   one another.
3. Within candidates, one document per different set, sets of similar size are
   cut into blocks of bounded length; each pair of blocks is one task. There
   the sets of one block are stored in a prefix tree, commonest shingles first,
   so that similar sets share paths; sets of the other walk down it together
   with their partial overlaps, and a subtree is left when the overlap so far
   and what remains on both sides cannot reach the bound. A task returns a
   spanning forest of its links.
4. Links and equal sets are joined into components.

No step emits pairs or gathers a group: what grows with a group of near copies
is rows in proportion to its members, and tasks of bounded size. Lists are kept
for each text of an id, so an id that many rows repeat gathers none either.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .components import components
from .cover_tree import Forest
from .packing import pack, unpack
from .tokens import chunks, mix, phrases, ranges, words

SHINGLE = 5
#: Share of a set's shingles by which its prefix is longer than it must be (l / n).
EXTRA = 0.1
#: Shingles in a block: bounds the memory of a task (a longer set is a block alone).
BLOCK_SHINGLES = 1 << 20
CHUNK = 64


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles, ascending within each text; number of them in each text)."""
    w = words(texts, lower=True)
    h = w.hashes()
    grams = phrases(h, k, seed=k)
    counts = w.counts
    parts, sizes = [], np.zeros(len(counts), dtype=np.int64)
    for d in range(len(counts)):
        a, n = int(w.first[d]), int(counts[d])
        if n >= k:
            s = np.unique(grams[a : a + n - k + 1])
        elif n:
            s = phrases(h[a : a + n], n, seed=n)
        else:
            continue
        parts.append(s)
        sizes[d] = len(s)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), sizes


def shared_at_least(n):
    """ceil(3n/4): shingles that a set of n has in common with any partner."""
    return -(-3 * n // 4)


def extra(n: np.ndarray) -> np.ndarray:
    return np.maximum(1, (n * EXTRA).astype(np.int64))


def _texts(docs: DataFrame) -> DataFrame:
    """(_id, _x, _text); _x tells apart the texts of rows that repeat an id."""
    return docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.xxhash64("text").alias("_x"), F.col("text").alias("_text"))


def prefixes(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(_id, _x, _need, _h): the first n - a + l shingles, by hash, of every text."""

    def run(batches):
        for b in batches:
            ids, marks = b.column("_id"), b.column("_x")
            for row, part in chunks(b.column("_text")):
                h, n = shingles(part, k)
                take = np.minimum(n, n - shared_at_least(n) + extra(n))
                at = ranges(np.cumsum(n) - n, take)
                owner = np.repeat(np.arange(len(n)), take)
                whose = pa.array(owner + row)
                # A partner has at least 3n/4 shingles, so its own l may be smaller by that much.
                need = np.maximum(1, extra(np.maximum(1, shared_at_least(n))))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(whose), marks.take(whose), pa.array(need[owner].astype(np.int32)), pa.array(h[at].view(np.int64))],
                    names=["_id", "_x", "_need", "_h"],
                )

    return _texts(docs).where("_id is not null").mapInArrow(run, "_id bigint, _x bigint, _need int, _h bigint")


def marked(texts: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Packed texts with _n, the size of each set, and two hashes of it, _f and _g; empty sets are left out."""

    def run(batches):
        for b in batches:
            for row, part in unpack(b):
                h, n = shingles(part.fill_null(""), k)
                end = np.cumsum(n)
                marks = []
                for salted in (h + np.uint64(1), h ^ np.uint64(0x5DEECE66D)):
                    total = np.zeros(len(h) + 1, dtype=np.uint64)
                    np.cumsum(mix(salted), out=total[1:])
                    marks.append(pa.array((total[end] - total[end - n]).view(np.int64)))
                some = [b.column(c).slice(row, len(part)) for c in ("_id", "_z", "_zn")]
                yield pa.RecordBatch.from_arrays([*some, pa.array(n), *marks], names=["_id", "_z", "_zn", "_n", "_f", "_g"])

    schema = "_id bigint, _z binary, _zn bigint, _n bigint, _f bigint, _g bigint"
    return texts.select("_id", "_z", "_zn").mapInArrow(run, schema).where("_n > 0")


def candidates(docs: DataFrame, stages: Stages, k: int = SHINGLE) -> DataFrame:
    """(_p, _px, _meet): texts (id and _x) that can have a partner, with the shingles in which they meet it."""
    first = prefixes(docs, k)
    # Written before it is joined: of a join of two plain shuffles Spark can split the hot keys.
    twice = stages.put(first.groupBy("_h").agg(F.count("*").alias("_df")).where("_df > 1").select(F.col("_h").alias("_t"), "_df"))
    # A list holds shingles of one text's prefix, however often its row is repeated.
    shared = (
        first.join(twice, F.col("_h") == F.col("_t"))
        .groupBy("_id", "_x")
        .agg(F.sort_array(F.collect_set(F.struct("_df", "_h"))).alias("_o"), F.min("_need").alias("_need"))
        .where(F.size("_o") >= F.col("_need"))
    )
    meet = F.transform(F.slice("_o", 1, F.size("_o") - F.col("_need") + 1), lambda x: x["_h"])
    return stages.put(shared.select(F.col("_id").alias("_p"), F.col("_x").alias("_px"), meet.alias("_meet")))


def groups(docs: DataFrame, stages: Stages, k: int = SHINGLE) -> DataFrame:
    """(node, component): doc_ids that are linked to others, with the smallest reachable doc_id."""
    # 1, 2. Documents that can have a partner, tied to their candidates.
    possible = candidates(docs, stages, k)
    meet = possible.select(F.col("_p").alias("_id"), F.explode("_meet").alias("_h"))
    low = meet.groupBy("_h").agg(F.min("_id").alias("_low"), F.max("_id").alias("_top")).where("_low < _top")
    low = stages.put(low.select(F.col("_h").alias("_t"), "_low"))
    ties = meet.join(low, F.col("_h") == F.col("_t")).select(F.col("_id").alias("a"), F.col("_low").alias("b")).distinct()
    tied = components(ties, stages)
    # 3. One document for all with equal sets.
    ids = possible.select("_p", "_px")
    found = stages.put(marked(pack(_texts(docs)).join(ids, (F.col("_id") == F.col("_p")) & (F.col("_x") == F.col("_px"))), k))
    kinds = stages.put(found.groupBy("_f", "_g", "_n").agg(F.min("_id").alias("_rep"), F.count("*").alias("_c")))
    rep = kinds.select(F.col("_f").alias("_kf"), F.col("_g").alias("_kg"), F.col("_n").alias("_kn"), "_rep", "_c")
    equal = [F.col(a) == F.col(b) for a, b in (("_f", "_kf"), ("_g", "_kg"), ("_n", "_kn"))]
    copies = found.select("_id", "_f", "_g", "_n").join(rep.where("_c > 1"), equal).select(F.col("_id").alias("a"), F.col("_rep").alias("b"))
    own = found.join(rep.select("_kf", "_kg", "_kn", "_rep"), [*equal, F.col("_id") == F.col("_rep")])
    own = own.dropDuplicates(["_id", "_f", "_g"]).select("_id", "_z", "_zn", "_n")
    # Partners' sizes differ by a factor of 4/3 at most, so by one class at most.
    size_class = F.floor(F.log("_n") / F.log(F.lit(4 / 3))).cast("int")
    member = own.join(tied, F.col("_id") == F.col("node")).select(
        "_id", "_z", "_zn", "_n", F.col("component").alias("_comp"), size_class.alias("_class")
    )
    member = stages.put(member)
    sizes = stages.put(member.groupBy("_comp", "_class").agg(F.ceil(F.sum("_n") / BLOCK_SHINGLES).cast("int").alias("_k"), F.count("*").alias("_c")))
    # Blocks of the own class and of its neighbours; candidates alone have no task.
    for shift, name in ((0, "_k0"), (1, "_k1"), (-1, "_k2")):
        other = sizes.select(F.col("_comp").alias("_oc"), (F.col("_class") - shift).alias("_ocl"), F.col("_k").alias(name), F.col("_c").alias("_c" + name))
        member = member.join(other, (F.col("_comp") == F.col("_oc")) & (F.col("_class") == F.col("_ocl")), "left").drop("_oc", "_ocl")
    cls, mine = F.col("_class"), F.pmod(F.xxhash64("_id", "_n"), F.col("_k0")).cast("int")

    def tasks(c1, a, c2, b, right):
        return F.struct(c1.alias("c1"), a.alias("a"), c2.alias("c2"), b.alias("b"), right.alias("right"))

    def blocks(count, make, there):
        return F.when(there, F.transform(F.sequence(F.lit(0), F.col(count) - 1), make)).otherwise(F.array())

    yes, no, my = F.lit(True), F.lit(False), F.col("_mine")
    dealt = member.withColumn("_mine", mine).withColumn(
        "_task",
        F.explode(
            F.concat(
                blocks("_k0", lambda b: tasks(cls, F.least(my, b), cls, F.greatest(my, b), my > b), F.col("_c_k0") > 1),
                blocks("_k1", lambda b: tasks(cls, my, cls + 1, b, no), F.col("_k1").isNotNull()),
                blocks("_k2", lambda a: tasks(cls - 1, a, cls, my, yes), F.col("_k2").isNotNull()),
            )
        ),
    )
    dealt = dealt.select(
        "_comp", *[F.col(f"_task.{c}").alias(f"_{c}") for c in ("c1", "a", "c2", "b", "right")], "_id", "_z", "_zn", "_n"
    )
    linked = stages.put(dealt.groupBy("_comp", "_c1", "_a", "_c2", "_b").applyInArrow(_join_blocks(k), "a bigint, b bigint"))
    # 4. Links between sets and between equal sets.
    return components(linked.unionByName(copies), stages)


class PrefixTree:
    """Sets as paths of numbers, paths with a common beginning sharing nodes of up to CHUNK numbers.

    Nodes are kept level by level in arrays: parent, stretch of numbers, the
    last number, the depth at the end, and the smallest and largest size of the
    sets below.
    """

    def __init__(self, paths: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(paths)), key=lambda i: paths[i].astype(">u4").tobytes())
        parent, begin, end, owner, depth = [], [], [], [], []
        leaf = np.zeros(len(paths), dtype=np.int64)
        stack: list[tuple[int, int]] = []  # (node, depth at its end)
        previous = np.zeros(0, dtype=np.int64)
        for i in order:
            p = paths[i]
            m = min(len(p), len(previous))
            differ = np.flatnonzero(p[:m] != previous[:m])
            common = int(differ[0]) if len(differ) else m
            while stack and stack[-1][1] > common:
                stack.pop()
            at = stack[-1][1] if stack else 0
            # Nodes end at multiples of CHUNK, so a path's nodes can be shared up to the last one that agrees in full.
            while at < len(p):
                stop = min(len(p), (at // CHUNK + 1) * CHUNK)
                parent.append(stack[-1][0] if stack else -1)
                begin.append(at)
                end.append(stop)
                owner.append(i)
                depth.append(len(stack))
                stack.append((len(parent) - 1, stop))
                at = stop
            leaf[i] = stack[-1][0] if stack else -1
            previous = p
        n = len(parent)
        self.parent, self.depth = np.array(parent, np.int64), np.array(depth, np.int64)
        begin, end, owner = np.array(begin, np.int64), np.array(end, np.int64), np.array(owner, np.int64)
        first = np.concatenate(([0], np.cumsum([len(p) for p in paths])))
        self.numbers = np.concatenate(paths) if paths else np.zeros(0, np.int64)
        self.start, self.length = first[owner] + begin, end - begin
        self.last = self.numbers[self.start + self.length - 1]
        self.end = end
        self.least, self.most, self.longest = np.full(n, 1 << 62), np.zeros(n, np.int64), np.zeros(n, np.int64)
        path_length = np.array([len(p) for p in paths], np.int64)
        np.minimum.at(self.least, leaf, sizes)
        np.maximum.at(self.most, leaf, sizes)
        np.maximum.at(self.longest, leaf, path_length)
        levels = int(self.depth.max()) + 1 if n else 0
        by_depth = np.argsort(self.depth, kind="stable")
        cut = np.searchsorted(self.depth[by_depth], np.arange(levels + 1))
        for d in range(levels - 1, 0, -1):
            nodes = by_depth[cut[d] : cut[d + 1]]
            up = self.parent[nodes]
            np.minimum.at(self.least, up, self.least[nodes])
            np.maximum.at(self.most, up, self.most[nodes])
            np.maximum.at(self.longest, up, self.longest[nodes])
        self.roots = by_depth[cut[0] : cut[1]] if n else np.zeros(0, np.int64)
        # Children of each node, and sets that end at it.
        kids = np.argsort(self.parent, kind="stable")
        kids = kids[self.parent[kids] >= 0]
        self.kids, self.kids_at = kids, np.searchsorted(self.parent[kids], np.arange(n + 1))
        ends = np.argsort(leaf, kind="stable")
        self.ends, self.ends_at = ends, np.searchsorted(leaf[ends], np.arange(n + 1))
        self.sizes = sizes

    def partners(self, member: np.ndarray, path: np.ndarray, size: int) -> np.ndarray:
        """Sets whose Jaccard with the given one is at least 3/4 (member: its numbers as flags)."""
        out = []
        alive, overlap = self.roots, np.zeros(len(self.roots), dtype=np.int64)
        while len(alive):
            at = ranges(self.start[alive], self.length[alive])
            cut = np.cumsum(self.length[alive]) - self.length[alive]
            overlap = overlap + np.add.reduceat(member[self.numbers[at]], cut, dtype=np.int64)
            # What can still be shared: numbers after the node's last on both sides.
            left = len(path) - np.searchsorted(path, self.last[alive], side="right")
            best = overlap + np.minimum(left, self.longest[alive] - self.end[alive])
            keep = (7 * best >= 3 * (size + self.least[alive])) & (4 * np.minimum(size, self.most[alive]) >= 3 * np.minimum(size, self.least[alive]))
            alive, overlap = alive[keep], overlap[keep]
            count = self.ends_at[alive + 1] - self.ends_at[alive]
            if count.any():
                there = self.ends[ranges(self.ends_at[alive], count)]
                shared = np.repeat(overlap, count)
                out.append(there[7 * shared >= 3 * (size + self.sizes[there])])
            count = self.kids_at[alive + 1] - self.kids_at[alive]
            overlap = np.repeat(overlap, count)
            alive = self.kids[ranges(self.kids_at[alive], count)] if count.any() else np.zeros(0, np.int64)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def _join_blocks(k: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        batch = rows.to_batches()[0]
        r, n = rows["_id"].to_numpy(), rows["_n"].to_numpy()
        right = rows["_right"].to_numpy(zero_copy_only=False)
        parts = [shingles(part.fill_null(""), k) for _, part in unpack(batch)]
        flat, length = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        # One order for all sets here, commonest first; what stands in one set alone is not shared.
        token, inverse, times = np.unique(flat, return_inverse=True, return_counts=True)
        rank = np.empty(len(token), dtype=np.int64)
        rank[np.argsort(-times, kind="stable")] = np.arange(len(token))
        numbers, common = rank[inverse], times[inverse] > 1
        first = np.concatenate(([0], np.cumsum(length)))
        paths = [np.sort(numbers[a:b][common[a:b]]) for a, b in zip(first[:-1], first[1:])]
        enough = np.array([len(p) for p in paths]) >= shared_at_least(n)
        one = rows["_c1"][0].as_py() == rows["_c2"][0].as_py() and rows["_a"][0].as_py() == rows["_b"][0].as_py()
        stored = np.flatnonzero(enough & (one | right))
        probes = np.flatnonzero(enough & (one | ~right))
        forest = Forest(len(r))
        if len(stored) and len(probes):
            tree = PrefixTree([paths[i] for i in stored], n[stored])
            member = np.zeros(len(token), dtype=bool)
            for i in probes.tolist():
                member[paths[i]] = True
                j = stored[tree.partners(member, paths[i], int(n[i]))]
                member[paths[i]] = False
                forest.join(np.full(len(j), i), j)
        root = forest.find(np.arange(len(r)))
        tied = root != np.arange(len(r))
        return pa.table({"a": r[tied], "b": r[root[tied]]})

    return run


def report(docs: DataFrame, stages: Stages, k: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles and component_id for every row of docs (doc_id, text).

    Null, empty and wordless texts have an empty set and no links. Rows that
    repeat a doc_id are one node, whichever of their texts links. A null doc_id
    links with nothing and has a null component.
    """
    found = groups(docs, stages, k)

    def run(batches):
        for b in batches:
            for row, part in chunks(b.column("_text")):
                _, n = shingles(part, k)
                yield pa.RecordBatch.from_arrays([b.column("_id").slice(row, len(part)), pa.array(n)], names=["_id", "_n"])

    counted = _texts(docs).mapInArrow(run, "_id bigint, _n bigint")
    return counted.join(found, F.col("_id") == F.col("node"), "left").select(
        F.col("_id").alias("doc_id"), F.col("_n").alias("n_shingles"), F.coalesce("component", "_id").alias("component_id")
    )


def one_of_each(docs: DataFrame, stages: Stages, k: int = SHINGLE) -> DataFrame:
    """Rows of docs that are alone or have the smallest id of their component; of rows with one id, one stays.

    That is a row of the smallest text (null first). docs' columns may have any
    names; the others are carried as they are.
    """
    found = stages.put(groups(docs, stages, k).where("node <> component").select(F.col("node").alias("_gone")))
    names = [f"_c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    plain = docs.toDF(*names)
    doc_id = F.col(own["doc_id"])
    often = plain.where(doc_id.isNotNull()).groupBy(doc_id.alias("_often")).agg(F.count("*").alias("_n")).where("_n > 1")
    often = stages.put(often.select("_often"))
    kept = plain.join(found, doc_id == F.col("_gone"), "left_anti")
    # Rows without an id are kept, each for itself; those of a repeated id are reduced in the map tasks.
    alone = kept.join(often, doc_id == F.col("_often"), "left_anti")
    least = F.min_by(F.struct(*names), F.struct(own["text"]))
    one = kept.join(often, doc_id == F.col("_often"), "left_semi").groupBy(doc_id.alias("_often")).agg(least.alias("_row"))
    return alone.unionByName(one.select("_row.*")).toDF(*docs.columns)
