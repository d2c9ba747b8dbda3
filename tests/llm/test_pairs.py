"""Near-duplicate operators and substring dedup against brute force."""

import hashlib
import random
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trolley.llm import cover_tree, ngram_join, recompression

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def groups(ids, links):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        up[max(p, q)] = min(p, q)
    return {i: find(i) for i in ids}


# -- vectors


def brute_vectors(rows, least=0.95):
    good = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            good[i] = np.array(v, dtype=float) / np.linalg.norm(np.array(v, dtype=float))
    links = [
        (a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least
    ]
    low = groups([i for i, _ in rows], links)
    n = {i: sum(i in p for p in links) for i, _ in rows}
    return {(i, n[i], low[i], i == low[i]) for i, _ in rows}


@pytest.mark.parametrize("block", [4096, 16])
def test_cover_tree(shipped, stages, block):
    rng = np.random.RandomState(4)
    centres = rng.normal(size=(12, 8))
    rows = []
    for i in range(160):
        v = centres[rng.randint(12)] + rng.normal(size=8) * rng.choice([0.02, 0.15, 0.3, 2.0])
        rows.append((i * 3, [float(x) for x in v]))
    rows += [(1000 + i, rows[5][1]) for i in range(20)]  # copies
    rows += [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] * 8), (2003, [None] + [1.0] * 7), (2004, [float("inf")] + [1.0] * 7)]
    rows += [(2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0])]
    df = shipped.createDataFrame([(*r, 0) for r in rows], "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = cover_tree.near_duplicates(df, stages, block=block).collect()
    assert {tuple(r) for r in got} == brute_vectors(rows)
    assert len(got) == len(rows)


def test_cover_tree_empty(shipped, stages):
    df = shipped.createDataFrame([], "vec_id bigint, embedding array<float>")
    assert cover_tree.near_duplicates(df, stages).collect() == []


def clustered(rng, n, dim=6, tight=0.05):
    centres = rng.normal(size=(max(2, n // 25), dim))
    x = centres[rng.randint(len(centres), size=n)] + rng.normal(size=(n, dim)) * rng.choice([tight, 4 * tight], size=(n, 1))
    return x / np.linalg.norm(x, axis=1)[:, None]


@pytest.mark.parametrize("seed", range(6))
def test_levels_are_nested_and_cover(seed):
    rng = np.random.RandomState(seed)
    x = clustered(rng, 400) if seed % 2 else clustered(rng, 300, 3, 0.2)
    tree = cover_tree.levels(x, 0.05)
    assert len(tree) >= 4 and len(tree[0].centre) == 1
    limit = 4.0
    for above, level in zip([None, *tree[:-1]], tree):
        limit /= 2
        assert (level.node[level.centre] == np.arange(len(level.centre))).all()  # a centre is in its own node
        away = cover_tree.distance(x, x[level.centre])[np.arange(len(x)), level.node]
        assert (away <= level.radius[level.node] + 1e-7).all()
        if level is not tree[-1]:
            assert (level.radius <= limit + 1e-9).all()
        if above is not None:
            assert set(above.centre.tolist()) <= set(level.centre.tolist())  # nested
            assert (level.parent[level.node] == above.node).all()  # a node's vectors share the node above
    assert (tree[-1].centre == np.arange(len(x))).all()


@pytest.mark.parametrize("seed", range(6))
def test_traversal_prunes_pairs_and_loses_none(seed, monkeypatch):
    rng = np.random.RandomState(20 + seed)
    a, b = clustered(rng, 300), clustered(rng, 260, tight=0.2)
    b[:40] = a[:40]
    t = float(np.sqrt(2 - 2 * 0.95))
    monkeypatch.setattr(cover_tree, "TILE", 37)
    la, lb = cover_tree.levels(a, t / 2), cover_tree.levels(b, t / 2 if seed % 2 else 0.9)
    got = [(i, j) for r, c in cover_tree.links(a, la, b, lb, t, 0.95) for i, j in zip(r.tolist(), c.tolist())]
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(a @ b.T >= 0.95))}
    assert len(got) == len(set(got)) and set(got) == want
    seen = 0
    real = cover_tree.distance

    def counting(p, q):
        nonlocal seen
        seen += len(p) * len(q)
        return real(p, q)

    far = np.concatenate([a, -a])  # two halves that no ball of the one comes near the other
    half = cover_tree.levels(far[:300], t / 2), cover_tree.levels(far[300:] * 1.0, t / 2)
    monkeypatch.setattr(cover_tree, "distance", counting)
    list(cover_tree.links(far[:300], half[0], far[300:], half[1], t, 0.95))
    assert seen < 300 * 300 * len(half[0])  # branches were left out


def test_vectors_without_structure_meet_once(monkeypatch):
    """Where radii prune nothing, neither trees nor node levels cost a distance per pair of vectors."""
    rng = np.random.RandomState(8)
    x = rng.normal(size=(2000, 64))
    x[1000:1040] = x[:40] + 0.01 * rng.normal(size=(40, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    a, b = x[:1000], x[1000:]
    seen = 0
    real = cover_tree.distance

    def counting(p, q):
        nonlocal seen
        seen += len(p) * len(q)
        return real(p, q)

    monkeypatch.setattr(cover_tree, "distance", counting)
    t = float(np.sqrt(2 - 2 * 0.95))
    la, lb = cover_tree.levels(a, t / 2, sparse=True), cover_tree.levels(b, t / 2, sparse=True)
    got = {(i, j) for r, c in cover_tree.links(a, la, b, lb, t, 0.95) for i, j in zip(r.tolist(), c.tolist())}
    assert got == {(i, i) for i in range(40)}
    assert seen < len(a) * len(b) / 4


def test_cosines_about_the_threshold_are_decided_in_double(monkeypatch):
    rng = np.random.RandomState(9)
    a = rng.normal(size=(60, 16))
    a /= np.linalg.norm(a, axis=1)[:, None]
    side = rng.normal(size=a.shape)
    side -= (side * a).sum(axis=1)[:, None] * a
    side /= np.linalg.norm(side, axis=1)[:, None]
    cosine = 0.95 + np.where(np.arange(60) % 2, 1e-10, -1e-10)
    b = cosine[:, None] * a + np.sqrt(1 - cosine**2)[:, None] * side
    t = float(np.sqrt(2 - 2 * 0.95))
    monkeypatch.setattr(cover_tree, "COLUMNS", 7)
    for sparse in (False, True):
        la, lb = cover_tree.levels(a, t / 2, sparse), cover_tree.levels(b, t / 2, sparse)
        got = {(i, j) for r, c in cover_tree.links(a, la, b, lb, t, 0.95) for i, j in zip(r.tolist(), c.tolist())}
        assert got == {(i, i) for i in range(1, 60, 2)}


def test_descent_ends_in_a_cell_of_the_path():
    rng = np.random.RandomState(3)
    top = cover_tree.Top(clustered(rng, 500, 4, 0.1), 0.3)
    assert len(top.levels) >= 3 and len(top.centre) > 10
    x = clustered(rng, 200, 4, 0.3)
    cell = top.cell(x)
    at = top.levels[-1].parent[cell]
    for lv, above in zip(top.levels[-2:0:-1], top.levels[-3::-1]):
        siblings = np.flatnonzero(lv.parent == -1)
        assert len(siblings) == 0
        at = lv.parent[at]
    assert (at == 0).all()
    last = top.levels[-1]
    for v, c in zip(x, cell):
        family = np.flatnonzero(last.parent == last.parent[c])
        d = cover_tree.distance(v[None], top.sample[last.centre[family]])[0]
        assert d.min() == pytest.approx(cover_tree.distance(v[None], top.centre[[c]])[0, 0])


@pytest.mark.parametrize("shape", ["stars", "path", "random", "one hub", "none"])
def test_components(shipped, stages, shape):
    from trolley.llm.components import components

    rng = random.Random(6)
    edges = {
        "stars": [(10 * k, 10 * k + i) for k in range(5) for i in range(1, 8)],
        "path": [(i, i + 1) for i in rng.sample(range(70), 70)],
        "random": [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(7, 7)],
        "one hub": [(500, i) for i in range(300)] + [(i, 1000 + i) for i in range(0, 300, 3)],
        "none": [],
    }[shape]
    df = shipped.createDataFrame([(a, b) if i % 2 else (b, a) for i, (a, b) in enumerate(edges)], "a bigint, b bigint").repartition(3)
    got = [(r.node, r.component) for r in components(df, stages).collect()]
    want = groups({x for e in edges for x in e}, edges)
    assert len(got) == len(set(got)) and dict(got) == {n: c for n, c in want.items() if any(n in e for e in edges if e[0] != e[1])}


# -- shingles


def brute_shingles(rows, k=5):
    sets = {}
    for i, t in rows:
        w = (t or "").translate(LOWER).encode().split()
        sets[i] = {tuple(w[p : p + k]) for p in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = []
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * len(sets[a] | sets[b]):
                links.append((a, b))
    low = groups(ids, links)
    return {(i, len(sets[i]), low[i]) for i in ids}


def near_copies(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([2, 4, 5, 9, 30, 80, 300]))] for _ in range(25)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    rows = [(1, None), (4, ""), (7, " \n "), (10, "É é"), (13, "é é")]
    for i in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            if w:
                p, q = rng.randrange(len(w)), rng.random()
                if q < 0.4:
                    w[p] = rng.choice(vocabulary)
                elif q < 0.7:
                    del w[p]
                else:
                    w.insert(p, rng.choice(vocabulary))
        if rng.random() < 0.3:
            w = common + w
        rows.append((i * 3, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [1 << 20, 2000])
def test_ngram_join(documents, stages, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK_SHINGLES", block)
    rows = near_copies(5, 260)
    got = ngram_join.report(documents(rows), stages).collect()
    assert {tuple(r) for r in got} == brute_shingles(rows)
    assert len(got) == len(rows)


def test_ngram_join_repeated_and_null_ids(documents, stages):
    text = " ".join(f"a{i}" for i in range(40))
    rows = [(5, text), (5, text), (None, text), (3, text + " b"), (9, "alone here")]
    got = sorted(map(tuple, ngram_join.report(documents(rows), stages).collect()), key=str)
    assert got == sorted([(5, 36, 3), (5, 36, 3), (None, 36, None), (3, 37, 3), (9, 1, 9)], key=str)
    kept = ngram_join.one_of_each(documents(rows), stages)
    assert kept.columns == documents(rows).columns
    assert sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 9]


def test_ngram_join_empty(documents, stages):
    assert ngram_join.report(documents([]), stages).collect() == []


# -- repeated passages


def brute_repeats(rows, width):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for p in range(len(w) - width + 1):
            key = tuple(w[p : p + width])
            first[key] = min(first.get(key, (i, p)), (i, p))
    out = set()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for p in range(len(w) - width + 1):
            if first[tuple(w[p : p + width])] < (i, p):
                gone.update(range(p, p + width))
        kept = b" ".join(x for q, x in enumerate(w) if q not in gone)
        out.add((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def passages(seed):
    rng = random.Random(seed)
    pool = [[rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))] for _ in range(12)]
    rows = [(9000, None), (9001, ""), (9002, "a"), (9003, "a " * 3000)]
    for i in range(120):
        w = []
        for _ in range(rng.randint(0, 6)):
            q = rng.random()
            if q < 0.4:
                w += rng.choice(pool)
            elif q < 0.6:
                w += [rng.choice("ab")] * rng.randint(1, 40)
            elif q < 0.8:
                w += [rng.choice("abcd") for _ in range(rng.randint(1, 40))]
            else:
                x = rng.choice(pool)
                w += x[rng.randrange(len(x)) :] + [f"z{i}"]
        rows.append((i, rng.choice([" ", "\n", "  "]).join(w)))
    return rows


@pytest.mark.parametrize("width", [20, 7])
def test_repeats(documents, stages, width):
    rows = passages(8)
    got = recompression.dedup_report(documents(rows, 5), stages, width).collect()
    assert {tuple(r) for r in got} == brute_repeats(rows, width)
    assert len(got) == len(rows)


def test_repeats_cut_texts(documents, stages):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(1, "x  y\n" + passage), (2, passage + " end"), (3, passage), (4, None), (5, "x  y")]
    docs = documents(rows)
    got = {r.doc_id: (r.text, r.n_chars) for r in recompression.without_repeats(docs, stages).collect()}
    assert got == {1: (rows[0][1], len(rows[0][1])), 2: ("end", 3), 4: (None, None), 5: ("x  y", 4)}


def test_repeats_same_id(documents, stages):
    """Rows that repeat an id with the same text keep their words; another text is judged on its own words."""
    passage = " ".join(f"p{i}" for i in range(30))
    got = sorted(r.n_removed for r in recompression.dedup_report(documents([(1, passage), (1, passage), (1, "q " + passage)]), stages).collect())
    assert got == [0, 0, 30]


def test_repeats_empty(documents, stages):
    assert recompression.dedup_report(documents([]), stages).collect() == []


def copies_of_ids(n):
    """n rows without an id and n of id 7, every third with one text, each other text repeating a passage."""
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(i, f"{passage} only {i} here") for i in range(20)]
    for i in range(n):
        text = passage if i % 3 == 0 else f"r{i % 50} {passage} tail{i % 7}"
        rows += [(None, text), (7, text)]
    return passage, rows


def longest_list(stages, column):
    """Most entries that a row of the run's stage tables holds in this list."""
    sizes = [0]
    for path in Path(stages.path).iterdir():
        df = stages.spark.read.parquet(str(path))
        if column in df.columns:
            sizes.append(df.agg(F.max(F.size(column))).first()[0] or 0)
    return max(sizes)


def test_repeats_of_ten_thousand_rows_of_one_id(documents, stages):
    passage, rows = copies_of_ids(10_000)
    got = recompression.dedup_report(documents(rows, 8), stages).collect()
    # A null id is the smallest: of its rows, those that start with the passage have it first of all.
    first = {}
    for i, t in rows:
        w = t.split()
        for p in range(len(w) - 19):
            key, here = tuple(w[p : p + 20]), (-1 if i is None else i, p)
            first[key] = min(first.get(key, here), here)
    want = Counter()
    for (i, t), times in Counter(rows).items():
        w = t.split()
        gone = set()
        for p in range(len(w) - 19):
            if first[tuple(w[p : p + 20])] < (-1 if i is None else i, p):
                gone.update(range(p, p + 20))
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        want[i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()] += times
    assert Counter(map(tuple, got)) == want
    assert longest_list(stages, "_cuts") <= 40


def test_ngram_join_of_ten_thousand_rows_of_one_id(documents, stages):
    _, rows = copies_of_ids(10_000)
    rows.append((3000, "nothing like the others stands in this text"))
    got = ngram_join.report(documents(rows, 8), stages).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id == 7} == {0}
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert {r.doc_id: r.component_id for r in got}[3000] == 3000
    assert longest_list(stages, "_meet") <= 40


def test_one_of_each_reduces_repeated_ids(shipped, stages):
    rows = [(1, "b", {"k": 1}), (1, None, {"k": 2}), (1, "a", {"k": 3}), (2, "c", None), (None, "d", None), (None, "d", None)]
    docs = shipped.createDataFrame(rows, "doc_id bigint, text string, _often map<string, int>")
    got = Counter((r.doc_id, r.text, None if r[2] is None else r[2]["k"]) for r in ngram_join.one_of_each(docs, stages).collect())
    assert got == Counter({(1, None, 2): 1, (2, "c", None): 1, (None, "d", None): 2})
