"""Balanced sampling, and the pipeline stage by stage."""

import random

import numpy as np
import pytest

import corpus_pipeline
from trolley.llm import mixing


def water(sizes, weights=(3, 1, 2), total=1.5, cap=2.0):
    """Targets by repeated sharing: full sources leave, the rest shares again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = total * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if cap * sizes[s] <= level * w[s]}
        if not full:
            out |= {s: level * w[s] for s in open_}
            break
        for s in full:
            out[s] = cap * sizes[s]
            left -= out[s]
        open_ -= full
    return out


@pytest.mark.parametrize("block", [4096, 64])
def test_mix(documents, stages, block):
    rng = random.Random(2)
    rows = []
    for i in range(900):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", None, "tiny"]) if i % 50 else "tiny"
        rows.append((i, rng.choice([None, "", "w " * rng.randint(1, 80)]) if i % 5 == 0 else "w " * rng.randint(1, 80), source))
    docs = documents(rows)
    got = mixing.mixed(docs, stages, block=block).collect()
    assert sorted(r.doc_id for r in got) == list(range(900))
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    sizes = {}
    for i, n in size.items():
        sizes[source[i]] = sizes.get(source[i], 0) + n
    goal, taken = water(sizes), {}
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(goal[source[r.doc_id]])
        assert r.taken <= 2 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
        taken[source[r.doc_id]] = taken.get(source[r.doc_id], 0) + r.taken
    for s, n in taken.items():
        assert abs(n - goal[s]) <= 80, s  # the longest document
    again = mixing.mixed(docs.repartition(7), stages, block=block).collect()
    assert {(r.doc_id, r.taken) for r in again} == {(r.doc_id, r.taken) for r in got}


def test_flight_keeps_totals():
    rng = np.random.RandomState(5)
    for _ in range(20):
        p, size = rng.uniform(0, 1, 200), rng.randint(1, 500, 200)
        end = mixing.fly(p, size, rng.uniform(size=300))
        inside = (end > 0) & (end < 1)
        assert inside.sum() <= 2
        assert end.sum() == pytest.approx(p.sum()) and (end * size).sum() == pytest.approx((p * size).sum())
        landed = mixing.land(end, size, 0.3)
        assert set(np.unique(landed)) <= {0.0, 1.0}


def test_mix_repeated_rows_and_empty(documents, stages):
    rows = [(1, "a b c", "s")] * 5 + [(None, "d e", None)] * 3 + [(2, "x", "s")]
    got = mixing.mixed(documents(rows), stages).collect()
    assert len(got) == 9 and len({r.taken for r in got if r.doc_id == 1}) == 1
    assert mixing.mixed(documents([]), stages).collect() == []
    assert mixing.mixed(documents([(1, None), (2, "")]), stages).count() == 2


# -- pipeline


@pytest.fixture(scope="module")
def sf(shipped, tmp_path_factory):
    """A small folder of tables with planted cases and columns that the stages also use."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8)))
    text = lambda n: " ".join(word() for _ in range(n)) + "."
    passage, item = text(60), text(30)
    rows = [(i, text(rng.randint(30, 200))) for i in range(200)]
    rows += [(300 + i, "### $$$ " * 40) for i in range(40)]
    rows += [(400, rows[3][1]), (401, rows[4][1] + " extra"), (402, passage + " " + text(50)), (403, text(40) + " " + passage)]
    rows += [(404, text(30) + " " + item), (405, None), (406, ""), (407, rows[3][1])]
    full = [(i, t, "en", "hot" if i % 3 else f"s{i % 4}", len(t or ""), "x", i, i, "t", 7) for i, t in rows]
    path = str(tmp_path_factory.mktemp("sf"))
    shipped.createDataFrame(
        full, "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, score bigint, _gone bigint, _turn string, takes int"
    ).write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(200)] + [(300 + i, 0, 0) for i in range(40)]
    shipped.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    shipped.createDataFrame([(0, item)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline(shipped, sf):
    docs = shipped.read.parquet(f"{sf}/documents.parquet")
    seen = [{r.doc_id: r for r in docs.collect()}]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(shipped, docs, sf)
        # The mix's column replaces one of its name.
        expected = docs.columns if name != "mix" else [c for c in docs.columns if c != "takes"] + ["takes"]
        assert out.columns == expected, name
        rows = out.collect()
        seen.append({r.doc_id: r for r in rows})
        assert len(rows) == len(seen[-1]), name
        docs = shipped.createDataFrame(rows, out.schema).repartition(3)
    start, good, alone, cut, clean, mixed = seen
    assert set(range(200)) <= set(good) and not set(good) & (set(range(300, 340)) | {405, 406})
    assert set(good) - set(alone) == {400, 401, 407}
    assert set(alone) == set(cut)
    changed = {i for i in cut if cut[i].text != alone[i].text}
    assert changed == {403} and len(cut[403].text.split()) == 40 and cut[403].n_chars == len(cut[403].text)
    assert set(cut) - set(clean) == {404}
    assert set(mixed) <= set(clean) and all(1 <= r.takes <= 2 for r in mixed.values())
    assert {r.doc_id for r in corpus_pipeline.run(shipped, sf).collect()} == set(mixed)
