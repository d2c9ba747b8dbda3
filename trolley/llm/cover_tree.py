"""Exact near-duplicate pairs of vectors by dual traversal of cover trees.

Vectors are scaled to length 1, so cosine >= c means distance <= t with
t^2 = 2 - 2c. A cover tree has nested levels: the centres of a level are centres
of every finer one, radii halve from level to level, and each vector lies within
its node's radius of the node's centre. Two nodes whose centres lie further apart
than t plus both covering radii hold no pair and are pruned with all below them.
What survives down to the vectors is compared in full, so the pairs are exact.

On Spark the tree has two parts. The top is a cover tree of a bounded sample (at
most MAX_CELLS vectors, broadcast); every vector descends it level by level to a
cell, and the cells' covering radii are measured over all vectors. Pairs of cells
that survive are joined block by block: a cell is cut, by a hash, into blocks
of about BLOCK vectors, a vector goes to a partner block only if it lies within
the partner cell's radius plus t, and each task holds two blocks. There both
blocks get trees of their own, which are traversed together, pair of nodes by
pair of nodes. Tasks return sums of links and a spanning forest, never pairs, so
a group of copies of any size gives rows in proportion to its vectors. Equal
vectors are one node with a count. If no radius prunes (vectors without any
structure), every block still meets every other one; that work is quadratic, as
for any exact method.

Edge cases: see near_duplicates(). Ties: of several centres as near, the first
takes a vector; that changes the tree, not the pairs. An empty table gives an
empty result, and other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stages
from .components import components

COSINE = 0.95
MAX_CELLS = 4096
BLOCK = 4096
TILE = 512
COLUMNS = 2048
#: Vectors from which the nodes of a level are estimated.
PROBES = 64
#: Distances near 0 are off by the root of a product's rounding; pruning allows for more than that.
SLACK = 1e-6


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def cover(x: np.ndarray, radius: float, batch: int = 256) -> np.ndarray:
    """Greedy net: for each vector the row of a centre within the radius; centres name themselves."""
    owner = np.full(len(x), -1)
    left = np.arange(len(x))
    while len(left):
        some = left[:batch]
        d = distance(x[some], x[some]) <= radius
        centres = []
        free = np.ones(len(some), dtype=bool)
        for i in range(len(some)):
            if free[i]:
                centres.append(i)
                free &= ~d[i]
        centres = some[centres]
        near = distance(x[left], x[centres])
        best = near.argmin(axis=1)
        taken = near[np.arange(len(left)), best] <= radius
        owner[left[taken]] = centres[best[taken]]
        owner[centres] = centres
        left = left[owner[left] < 0]
    return owner


@dataclass
class Level:
    """Nodes of one level: rows of their centres, nodes above, covering radii, and each vector's node."""

    centre: np.ndarray
    parent: np.ndarray
    radius: np.ndarray
    node: np.ndarray


def alone(x: np.ndarray, radius: float) -> float:
    """Share of vectors that would be centres at this radius, from a few vectors' neighbours."""
    some = x[:: -(-len(x) // PROBES)]
    return float((1.0 / np.maximum(1, (distance(some, x) <= radius).sum(axis=1))).mean())


def levels(x: np.ndarray, smallest: float, sparse: bool = False) -> list[Level]:
    """Cover tree of some vectors, from one node down to radius ``smallest``, then the vectors themselves.

    ``sparse`` leaves out a level that would give most vectors nodes of their own, and what is below it.
    """
    n = len(x)
    found: list[Level] = []
    owner, limit = np.zeros(n, dtype=np.int64), 2.0  # no two unit vectors are further apart
    while n:
        rows, node = np.unique(owner, return_inverse=True)
        node = node.reshape(-1)
        away = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, x[owner])))
        reach = np.zeros(len(rows))
        np.maximum.at(reach, node, away)
        # Nested: a centre is among the members of the node above, and is a centre of every finer level.
        parent = found[-1].node[rows] if found else np.zeros(len(rows), dtype=np.int64)
        found.append(Level(rows, parent, reach, node))
        limit /= 2
        if limit < smallest or len(rows) > n // 2:
            break  # finer than that a level prunes nothing that its vectors don't
        if sparse and alone(x, limit) > 0.5:
            break
        # A member stays with its centre while it is near enough; the others get centres of their own, node by node.
        out = np.flatnonzero((away > limit) & (owner != np.arange(n)))
        order = out[np.argsort(node[out], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            if len(part):
                owner[part] = part[cover(x[part], limit)]
    every = np.arange(n)
    found.append(Level(every, found[-1].node if found else every, np.zeros(n), every))
    return found


def links(xa: np.ndarray, a: list[Level], xb: np.ndarray, b: list[Level], t: float, least: float):
    """Dual traversal: (rows of a, rows of b) with cosine >= least, a tile of a's vectors at a time.

    At each level a pair of nodes lives on if the pair above did and their balls
    come within t of each other. The tree that ends first waits at its last node level.
    A level with nearly as many pairs of nodes as of vectors is passed over. Vectors are
    multiplied in single precision, and again in double where its error leaves a doubt.
    """
    error = (xa.shape[1] + 8) * float(np.finfo(np.float32).eps)
    sa, sb = xa.astype(np.float32), xb.astype(np.float32)
    depth = max(len(a), len(b)) - 1
    a, b = ([*lv[:-1], *[lv[-2]] * (depth + 1 - len(lv)), lv[-1]] for lv in (a, b))
    order = np.lexsort([lv.node for lv in reversed(a)])  # vectors of a node stand together
    for lo in range(0, len(order), TILE):
        rows = order[lo : lo + TILE]
        cols = np.arange(len(xb))
        na = nb = alive = None
        for la, lb in zip(a[:-1], b[:-1]):
            if not len(cols):
                break
            ma, mb = np.unique(la.node[rows]), np.unique(lb.node[cols])
            if 4 * len(ma) * len(mb) > len(rows) * len(cols):
                continue
            near = distance(xa[la.centre[ma]], xb[lb.centre[mb]]) <= la.radius[ma][:, None] + lb.radius[mb][None, :] + t + SLACK
            if alive is not None:
                # The node above, or the same one where a tree waits.
                up = np.searchsorted(na, pa_.node[la.centre[ma]]), np.searchsorted(nb, pb_.node[lb.centre[mb]])
                near &= alive[np.ix_(*up)]
            some = near.any(axis=0)
            cols = cols[some[np.searchsorted(mb, lb.node[cols])]]
            na, nb, alive, pa_, pb_ = ma, mb[some], near[:, some], la, lb
        for some in np.split(cols, range(COLUMNS, len(cols), COLUMNS)):
            cosine = (sa[rows] @ sb[some].T).reshape(-1)
            found = np.flatnonzero(cosine >= least - error)
            i, j = np.divmod(found, max(1, len(some)))
            if alive is not None and not alive.all():
                up = np.searchsorted(na, pa_.node[rows]), np.searchsorted(nb, pb_.node[some])
                kept = alive[up[0][i], up[1][j]]
                found, i, j = found[kept], i[kept], j[kept]
            sure = cosine[found] >= least + error
            doubt = np.flatnonzero(~sure)
            for part in np.split(doubt, range(COLUMNS, len(doubt), COLUMNS)):
                sure[part] = np.einsum("ij,ij->i", xa[rows[i[part]]], xb[some[j[part]]]) >= least
            if sure.any():
                yield rows[i[sure]], some[j[sure]]


class Forest:
    """Connected rows, as pointers to the smallest row of each group."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: np.ndarray) -> np.ndarray:
        r = self.up[i]
        while True:
            nxt = self.up[r]
            if (nxt == r).all():
                return r
            r = nxt

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            a, b = self.find(i), self.find(j)
            open_ = a != b
            if not open_.any():
                return
            i, j, a, b = i[open_], j[open_], a[open_], b[open_]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


class Top:
    """Cover tree of a sample: cells are its finest nodes; once measured, their radii and numbers of blocks."""

    def __init__(self, sample: np.ndarray, smallest: float):
        tree = levels(sample, smallest)
        self.levels = tree[:-1] if len(tree) > 1 else tree  # vectors of the sample are no cells of their own
        self.sample = sample
        self.centre = sample[self.levels[-1].centre]
        self.radius: np.ndarray | None = None
        self.blocks: np.ndarray | None = None

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell each vector descends to: at each level the nearest child of its node."""
        at = np.zeros(len(x), dtype=np.int64)
        for lv in self.levels[1:]:
            order = np.argsort(lv.parent, kind="stable")
            first = np.searchsorted(lv.parent[order], np.arange(lv.parent.max() + 2))
            below = np.empty_like(at)
            for node in np.unique(at):
                some = np.flatnonzero(at == node)
                children = order[first[node] : first[node + 1]]
                below[some] = children[distance(x[some], self.sample[lv.centre[children]]).argmin(axis=1)]
            at = below
        return at


def unit(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def usable(vector: str):
    """Condition: neither null nor empty nor zero, and no component null or not finite."""
    bad = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda v: v != 0)


def near_duplicates(vectors: DataFrame, stages: Stages, cosine: float = COSINE, block: int = BLOCK, max_cells: int = MAX_CELLS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding).

    Rows with equal vectors link with one another. Vectors that are null, empty
    or zero, or hold null or non-finite components, link with nothing, as do
    vectors of different lengths. Rows that repeat a vec_id are vectors of their
    own; a null vec_id comes after all others in the choice of the smallest.
    """
    rows = vectors.select(F.col("vec_id").alias("_id"), F.col("embedding").cast("array<double>").alias("_v"))
    good = rows.where(usable("_v"))
    # Equal vectors are one node: its smallest id and its number of copies.
    reps = stages.put(
        good.groupBy("_v")
        .agg(F.min("_id").alias("_first"), F.count("*").alias("_copies"))
        .withColumn("_r", F.monotonically_increasing_id())
    )
    sums, edges = None, None
    for (size,) in [tuple(r) for r in reps.groupBy(F.size("_v")).count().select(F.col("size(_v)")).collect()]:
        part = stages.put(_linked(reps.where(F.size("_v") == size), stages, cosine, block, max_cells))
        s = part.groupBy("_r").agg(F.sum("_links").alias("_links"))
        e = part.select(F.col("_r").alias("a"), F.col("_root").alias("b"))
        sums, edges = (s, e) if sums is None else (sums.unionByName(s), edges.unionByName(e))
    out = rows.select("_id", "_v")
    if sums is None:
        nothing = F.lit(0).cast("bigint")
        return out.select(F.col("_id").alias("vec_id"), nothing.alias("n_links"), F.col("_id").alias("component_id"), F.lit(True).alias("kept"))
    group = components(edges, stages)
    found = (
        reps.join(sums, "_r", "left")
        .join(group.withColumnRenamed("node", "_r"), "_r", "left")
        .withColumn("_group", F.coalesce("component", "_r"))
    )
    found = stages.put(found.select("_r", "_v", "_group", "_first", (F.coalesce("_links", F.lit(0)) + F.col("_copies") - 1).alias("_n")))
    low = found.groupBy("_group").agg(F.min("_first").alias("_low"))
    found = found.join(low, "_group").select(F.col("_v").alias("_w"), "_n", "_low")
    # The vector is the key: both sides hold the same doubles.
    return out.join(found, F.col("_v") == F.col("_w"), "left").select(
        F.col("_id").alias("vec_id"),
        F.coalesce("_n", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("_low", "_id").alias("component_id"),
        F.coalesce(F.col("_id") == F.coalesce("_low", "_id"), F.lit(True)).alias("kept"),
    )


def _linked(reps: DataFrame, stages: Stages, cosine: float, block: int, max_cells: int) -> DataFrame:
    """(_r, _links, _root): partial sums of links and forest edges of vectors of one length."""
    context = reps.sparkSession.sparkContext
    t = float(np.sqrt(2.0 - 2.0 * cosine))
    n = reps.count()
    wanted = int(min(max_cells, max(1, -(-n // block))))
    sample = reps.orderBy(F.xxhash64("_v"), "_r").limit(wanted).select("_v").toArrow()["_v"].combine_chunks()
    top = Top(unit(sample), t)
    sent = context.broadcast(top)

    def measure(batches):
        for b in batches:
            x = unit(b.column("_v"))
            c = sent.value.cell(x)
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", x, sent.value.centre[c])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(d)], names=["_cell", "_d"])

    cells = reps.select("_v").mapInArrow(measure, "_cell bigint, _d double").groupBy("_cell").agg(F.max("_d"), F.count("*")).collect()
    top.radius, top.blocks = np.full(len(top.centre), -1.0), np.zeros(len(top.centre), dtype=np.int64)
    for c, d, k in cells:
        top.radius[c], top.blocks[c] = d, max(1, -(-k // block))
    sent = context.broadcast(top)

    def deal(batches):
        """Each vector once for every pair of blocks in which it can have a partner."""
        m: Top = sent.value
        first = np.concatenate(([0], np.cumsum(m.blocks)))
        # Cells whose balls come within t of each other; once a task.
        meet = distance(m.centre, m.centre) <= m.radius[:, None] + m.radius[None, :] + t + SLACK
        for b in batches:
            for lo in range(0, b.num_rows, 1024):
                some = b.slice(lo, 1024)
                x = unit(some.column("_v"))
                d = distance(x, m.centre)
                cell = m.cell(x)
                part = (some.column("_r").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                own = first[cell] + (part.astype(np.int64) % m.blocks[cell])
                # The other cell's ball, and the other vectors' own ball around this one's cell.
                reach = (d <= m.radius[None, :] + t + SLACK) & (m.blocks > 0)[None, :] & meet[cell]
                who, other = np.nonzero(reach)
                k = m.blocks[other]
                who = np.repeat(who, k)
                to = np.repeat(first[other], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                mine = own[who]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.minimum(mine, to)), pa.array(np.maximum(mine, to)), pa.array(mine > to),
                        some.column("_r").take(pa.array(who)), some.column("_copies").take(pa.array(who)), some.column("_v").take(pa.array(who)),
                    ],
                    names=["_a", "_b", "_right", "_r", "_copies", "_v"],
                )

    dealt = reps.select("_r", "_copies", "_v").mapInArrow(
        deal, "_a bigint, _b bigint, _right boolean, _r bigint, _copies bigint, _v array<double>"
    )

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        r, copies = rows["_r"].to_numpy(), rows["_copies"].to_numpy()
        x = unit(rows["_v"].chunk(0) if rows["_v"].num_chunks else rows["_v"].combine_chunks())
        right = rows["_right"].to_numpy(zero_copy_only=False)
        same = rows["_a"][0].as_py() == rows["_b"][0].as_py()
        left_rows = np.arange(len(r)) if same else np.flatnonzero(~right)
        right_rows = left_rows if same else np.flatnonzero(right)
        total, forest = np.zeros(len(r), dtype=np.int64), Forest(len(r))
        if len(left_rows) and len(right_rows):
            la = levels(x[left_rows], t / 2, sparse=True)
            lb = la if same else levels(x[right_rows], t / 2, sparse=True)
            for i, j in links(x[left_rows], la, x[right_rows], lb, t, cosine):
                i, j = left_rows[i], right_rows[j]
                if same:
                    i, j = i[i != j], j[i != j]
                np.add.at(total, i, copies[j])
                if not same:
                    np.add.at(total, j, copies[i])
                forest.join(i, j)
        root = forest.find(np.arange(len(r)))
        keep = (total > 0) | (root != np.arange(len(r)))
        return pa.table({"_r": r[keep], "_links": total[keep], "_root": r[root[keep]]})

    return dealt.groupBy("_a", "_b").applyInArrow(compare, "_r bigint, _links bigint, _root bigint")

