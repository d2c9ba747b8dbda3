"""Prefix trie of conversations, built as z-fast tries over ranges of the sorted conversations.

A conversation is a sequence of turns; every distinct sequence of its first d
turns is a node of depth d, from the root (d = 0). Turns are compared by a
128-bit digest of role and text, so no text is moved.

Method (z-fast trie). A task's trie is compacted: it holds only the nodes where
conversations end or part, each with its extent (the prefix it stands for). A
hash table maps the handle of every such node to it; the handle is the prefix
whose length is the two-fattest number of the node's edge, the one number there
that the greatest power of two divides. A fat binary search over handles finds
where a conversation leaves the trie in logarithmically many look-ups. Batches of
conversations are located first, grouped by the edge they leave on, and inserted
from there; last, edges are expanded into the nodes of every depth.

Distribution. Copies of a conversation become one row with their number first.
The distinct ones are range-partitioned in the order of their digests: however
many share a first turn, they spread over tasks, and a task's trie is a
contiguous part of the whole. Nodes on a part's two borders also occur in
neighbouring parts. All figures of a node are sums over its conversations or over
nodes, so parts add up if every node is counted by the first part that has it; a
part learns from its neighbour's last conversation which of its first nodes are
not new, and from the next one's first whether its last one is a leaf. Ids of
copies are joined in chunks of ``CHUNK`` ids before they are hashed in a stream,
so no list of a group's members is ever held.

Edge cases: rows with a null conversation id belong to no conversation and are
left out; null turns come first, equal turns are ordered by role and digest;
null roles and texts are empty; very long texts are only digested where they are
read; a conversation's digests (16 bytes a turn) are one row; an empty table has
no nodes; columns are renamed first, so other names cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Stages

#: Bytes of a turn's digest; ids joined in one piece; conversations located together; turns in one task's trie.
WIDTH = 16
CHUNK = 4096
BATCH = 1024
TASK_TURNS = 1 << 21

EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def fattest(a: int, b: int) -> int:
    """The number in (a, b] that the greatest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


def prefix_hashes(path: bytes) -> list[bytes]:
    """Hash of the first d turns, for every d."""
    h = hashlib.md5()
    out = [h.digest()]
    for i in range(0, len(path), WIDTH):
        h.update(path[i : i + WIDTH])
        out.append(h.copy().digest())
    return out


def common_turns(x: bytes, y: bytes, known: int = 0) -> int:
    """Turns that two paths share at their start; the first ``known`` are the same."""
    low, high = known, min(len(x), len(y)) // WIDTH
    while low < high:
        mid = (low + high + 1) // 2
        if x[low * WIDTH : mid * WIDTH] == y[low * WIDTH : mid * WIDTH]:
            low = mid
        else:
            high = mid - 1
    return low


class ZFastTrie:
    """Compacted trie of paths. Node 0 is the root; node i ends ``extent[i]`` turns deep on ``path[i]``."""

    def __init__(self) -> None:
        self.path: list[bytes] = [b""]
        self.extent = [0]
        self.hash = [hashlib.md5().digest()]
        self.parent = [-1]
        self.member: list[int] = [-1]  # row of the conversation that ends here
        self.row: list[int] = [-1]  # a row whose path runs through here
        self.handles: dict[bytes, int] = {}
        self.edges: dict[bytes, int] = {}  # prefix one turn below a node -> the child it leads to

    def locate(self, h: list[bytes], start: int = 0) -> tuple[int, int | None]:
        """(deepest node that is a prefix, child on whose edge the path leaves) by fat binary search.

        ``start`` is a node known to be a prefix.
        """
        node, a, b = start, self.extent[start], len(h) - 1
        while a < b:
            f = fattest(a, b)
            found = self.handles.get(h[f])
            if found is None:
                b = f - 1
                continue
            e = self.extent[found]
            if e < len(h) and self.hash[found] == h[e]:
                node, a = found, e
            else:
                return self.parent[found], found
        return node, self.edges.get(h[a + 1]) if a + 1 < len(h) else None

    def _add(self, path: bytes, extent: int, parent: int, member: int, row: int, h: list[bytes]) -> int:
        i = len(self.path)
        self.path.append(path)
        self.extent.append(extent)
        self.hash.append(h[extent])
        self.parent.append(parent)
        self.member.append(member)
        self.row.append(row)
        self.handles[h[fattest(self.extent[parent], extent)]] = i
        self.edges[h[self.extent[parent] + 1]] = i
        return i

    def _split(self, child: int, at: int, h: list[bytes]) -> int:
        """A new node ``at`` turns deep on the edge above child; h are hashes of a path that runs there."""
        top, below = self.extent[self.parent[child]], self.extent[child]
        path = self.path[child]

        def key(n: int) -> bytes:
            return h[n] if n <= at else hashlib.md5(path[: n * WIDTH]).digest()

        del self.handles[key(fattest(top, below))]
        node = self._add(path[: at * WIDTH], at, self.parent[child], -1, self.row[child], h)
        self.parent[child] = node
        self.handles[key(fattest(at, below))] = child
        self.edges[key(at + 1)] = child
        return node

    def insert(self, row: int, path: bytes, h: list[bytes], start: int) -> None:
        node, child = self.locate(h, start)
        n = len(h) - 1
        if child is not None:
            shared = common_turns(path, self.path[child], self.extent[node])
            node = self._split(child, shared, h)
        if self.extent[node] == n:
            self.member[node] = row
            if self.row[node] < 0:
                self.row[node] = row
        else:
            self._add(path, n, node, row, row, h)

    def insert_batch(self, first_row: int, paths: list[bytes]) -> None:
        """Locates all paths, then inserts them grouped by the edge each leaves on.

        Nodes are only added, so the node above that edge stays a prefix of every
        path of the group, and each insertion searches below it only.
        """
        hashes = [prefix_hashes(p) for p in paths]
        groups: dict[tuple[int, int | None], list[int]] = {}
        for i, h in enumerate(hashes):
            groups.setdefault(self.locate(h), []).append(i)
        for (node, _), some in groups.items():
            for i in some:
                self.insert(first_row + i, paths[i], hashes[i], node)


NODE = (
    "_h binary, _p binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, _all long, _once long, ends string"
)


def expand(trie: ZFastTrie, rows: list[tuple], known: int, covered: bool) -> Iterator[tuple]:
    """Nodes of every depth with this part's share of their figures, in the columns of NODE.

    rows: (path, words, copies, least id, hash of ids), sorted. The first ``known`` depths
    and the root above them on the first path were counted before (-1: none); ``covered``:
    the next part continues the last path, so its end is no leaf.
    """
    size = len(trie.path)
    down = sorted(range(size), key=lambda i: trie.extent[i])
    ends = {m: i for i, m in enumerate(trie.member) if m >= 0}

    on_first, node = set(), ends[0]
    while node >= 0:
        on_first.add(node)
        node = trie.parent[node]

    def new(node: int, depth: int) -> bool:
        return not (node in on_first and depth <= known)

    def words(node: int) -> list[int]:
        """Words of the turns on the edge above a node."""
        top = trie.extent[trie.parent[node]] if node else 0
        return rows[trie.row[node]][1][top : trie.extent[node]]

    inner = set(trie.parent)
    last = ends[len(rows) - 1]
    copies, low, leaves = [0] * size, [None] * size, [0] * size
    # Sums over the nodes below a node's end: words times conversations, and words of nodes counted here.
    total, once, children = [0] * size, [0] * size, [0] * size
    for i in reversed(down):
        m = trie.member[i]
        if m >= 0:
            copies[i] += rows[m][2]
            low[i] = rows[m][3] if low[i] is None else min(low[i], rows[m][3])
        if i not in inner and not (covered and i == last):
            leaves[i] = 1
        up = trie.parent[i]
        if up < 0:
            continue
        top, w = trie.extent[up], words(i)
        copies[up] += copies[i]
        low[up] = low[i] if low[up] is None else min(low[up], low[i])
        leaves[up] += leaves[i]
        total[up] += total[i] + copies[i] * sum(w)
        once[up] += once[i] + sum(x for d, x in enumerate(w, top + 1) if new(i, d))
        children[up] += new(i, top + 1)

    state = {-1: hashlib.md5()}
    for i in down:
        up = trie.parent[i]
        top, end = (trie.extent[up], trie.extent[i]) if i else (-1, 0)
        m, w = trie.member[i], words(i) if i else [0]
        h, path = state[up].copy(), trie.path[i]
        above = state[up].digest() if i else None
        all_w, once_w = total[i] + copies[i] * sum(w), once[i] + sum(x for d, x in enumerate(w, top + 1) if new(i, d))
        for d in range(top + 1, end + 1):
            if d:
                h.update(path[(d - 1) * WIDTH : d * WIDTH])
            here, x = h.digest(), w[d - top - 1]
            below = children[i] if d == end else int(new(i, d + 1))
            ids = rows[m][4] if d == end and m >= 0 else None
            yield here, above, d, low[i], copies[i], below, leaves[i], all_w, once_w, ids
            above = here
            all_w -= copies[i] * x
            once_w -= x if new(i, d) else 0
        state[i] = h


def turns_of(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, pos, digest, words): the turns of conversations in order, from pos 1, without their texts."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role, text))
    rows = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv_id"),
        F.col(turn).alias("_t"),
        role.alias("_role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("digest"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.col("_t").asc_nulls_first(), "_role", "digest")
    return rows.select("conv_id", F.row_number().over(w).cast("long").alias("pos"), "digest", "words")


def paths(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, path, words): the digests of each conversation in one value, and its turns' words.

    turns: (conv_id, pos, digest, words); ids (conv_id) adds conversations without turns.
    """
    turn = F.struct("pos", "digest", "words")
    all_rows = turns.select("conv_id", turn.alias("_turn")).unionByName(ids.select("conv_id"), allowMissingColumns=True)
    lists = all_rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("_turn")).alias("_turns"))
    hexes = F.array_join(F.transform("_turns", lambda t: F.hex(t["digest"])), "")
    return lists.select("conv_id", F.unhex(hexes).alias("path"), F.transform("_turns", lambda t: t["words"]).alias("words"))


def _hash_ids(batches):
    """(_k, _n, _low, _ids) of sorted chunks (_k, _from, _n, _text): the ids are hashed as they pass."""

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in ("_k", "_from", "_n", "_text")))

    def report():
        for key, chunks in itertools.groupby(rows(), key=lambda r: r[0]):
            sha, n, low = hashlib.sha256(), 0, None
            for _, first, some, text in chunks:
                sha.update((text if low is None else "," + text).encode())
                n, low = n + some, first if low is None else low
            yield key, n, low, sha.hexdigest()

    yield from _batches(report(), pa.schema([("_k", pa.binary()), ("_n", pa.int64()), ("_low", pa.int64()), ("_ids", pa.string())]))


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    while some := list(itertools.islice(rows, size)):
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some), schema)], schema=schema)


def distinct_paths(whole: DataFrame, stages: Stages) -> DataFrame:
    """(path, words, copies, low, ids): distinct conversations, how many copies, least id, SHA-256 of their ids."""
    whole = stages.put(whole.withColumn("_k", F.unhex(F.md5("path"))))
    chunks = whole.groupBy("_k", F.floor(F.col("conv_id") / CHUNK).alias("_chunk")).agg(
        F.min("conv_id").alias("_from"), F.count("*").alias("_n"),
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",").alias("_text"),
    )
    sorted_ = chunks.select("_k", "_from", "_n", "_text").repartition("_k").sortWithinPartitions("_k", "_from")
    groups = sorted_.mapInArrow(_hash_ids, "_k binary, _n long, _low long, _ids string")
    return groups.join(whole.select(F.col("conv_id").alias("_low"), "path", "words"), "_low").select(
        "path", "words", F.col("_n").alias("copies"), F.col("_low").alias("low"), F.col("_ids").alias("ids")
    )


def _borders(batches):
    """What each part needs of its neighbours: turns known from before, and whether its last path goes on."""
    for b in batches:
        known, covered = [], []
        for first, last, before, after in zip(*(b.column(c).to_pylist() for c in ("_first", "_last", "_before", "_after"))):
            known.append(-1 if before is None else common_turns(first, before))
            covered.append(after is not None and after.startswith(last))
        yield pa.RecordBatch.from_arrays([b.column("_part"), pa.array(known, pa.int64()), pa.array(covered)], names=["_part", "_known", "_covered"])


def _build(batches):
    """Nodes of each part; rows come sorted by part and path."""
    names = ("_part", "_known", "_covered", "path", "words", "copies", "low", "ids")

    def rows():
        for b in batches:
            yield from zip(*(b.column(c).to_pylist() for c in names))

    def nodes():
        for _, part in itertools.groupby(rows(), key=lambda r: r[0]):
            trie, kept = ZFastTrie(), []
            while some := list(itertools.islice(part, BATCH)):
                known, covered = some[0][1:3]
                trie.insert_batch(len(kept), [r[3] for r in some])
                kept += [r[3:] for r in some]
            yield from expand(trie, kept, known, covered)

    long = [(n, pa.int64()) for n in ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "_all", "_once")]
    yield from _batches(nodes(), pa.schema([("_h", pa.binary()), ("_p", pa.binary()), *long, ("ends", pa.string())]))


def prefix_trie(turns: DataFrame, ids: DataFrame, stages: Stages) -> DataFrame:
    """One row per node of the trie of conversations.

    turns: (conv_id, pos, digest, words) as turns_of() gives; ids (conv_id): all
    conversations, those without turns too. Columns: conv_id (least member),
    depth, parent_conv_id (the parent's least member), n_convs, n_children,
    n_leaves and saved_tokens (over the subtree), ends_sha256 (ids that end here).
    """
    spark = turns.sparkSession
    distinct = stages.put(distinct_paths(paths(turns, ids), stages))
    turns_held = distinct.select(F.sum(F.length("path")).alias("n")).first()["n"] or 0
    parts = -(-turns_held // (WIDTH * TASK_TURNS))
    ranged = (
        distinct.repartitionByRange(parts, "path")
        if parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
        else distinct.repartitionByRange("path")
    )
    ordered = stages.put(ranged.sortWithinPartitions("path").withColumn("_part", F.spark_partition_id()))
    # One row per part: the window over them is bounded by the number of partitions.
    w = Window.orderBy("_part")
    bounds = ordered.groupBy("_part").agg(F.min("path").alias("_first"), F.max("path").alias("_last"))
    bounds = bounds.select("*", F.lag("_last").over(w).alias("_before"), F.lead("_first").over(w).alias("_after"))
    borders = bounds.mapInArrow(_borders, "_part int, _known long, _covered boolean")
    dealt = ordered.join(borders, "_part").repartition("_part").sortWithinPartitions("_part", "path")
    nodes = dealt.select("_part", "_known", "_covered", "path", "words", "copies", "low", "ids").mapInArrow(_build, NODE)
    # Nodes on the borders of parts come in several pieces, which add up.
    sums = ("n_convs", "n_children", "n_leaves", "_all", "_once")
    whole = stages.put(
        nodes.groupBy("_h", "_p", "depth").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in sums], F.max("ends").alias("ends"))
    )
    above = whole.select(F.col("_h").alias("_p"), F.col("conv_id").alias("parent_conv_id"))
    return whole.join(above, "_p", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("_all") - F.col("_once")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
