"""Memory that Python takes in a task: bounded temporary arrays, texts that move once; the same values as ever."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from trolley.llm import quality, recompression, subword, tokens

MODEL = subword.Model(quality.SPEC, np.random.RandomState(1).randn(1 << 19).astype(np.float32), 0.1)


def texts(n_bytes, seed=3):
    rng = random.Random(seed)
    known = ["".join(rng.choices("abcdefghij", k=rng.randint(1, 9))) for _ in range(4000)]
    out = []
    while n_bytes > 0:
        out.append(" ".join(rng.choices(known, k=rng.randint(1, 900))))
        n_bytes -= len(out[-1]) + 1
    return out


def hashes(some):
    w = tokens.words(pa.array(some, pa.large_string()))
    return w.first, w.hashes()


@pytest.mark.parametrize(
    "work, most",
    [
        (lambda some: hashes(some), 20),
        (lambda some: recompression.anchors(*hashes(some)[::-1]), 35),
        (lambda some: subword.score(some, MODEL), 50),
    ],
    ids=["hashes", "anchors", "score"],
)
def test_chunk_takes_few_bytes_for_each_byte(work, most, monkeypatch):
    some = texts(tokens.CHUNK_BYTES)
    work(some[:1])  # what is kept between calls
    monkeypatch.setattr(tokens, "_powers", {})
    tracemalloc.start()
    try:
        work(some)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak <= most * tokens.CHUNK_BYTES


def test_fitting_keeps_one_copy_of_the_bags():
    rng = np.random.RandomState(5)
    bags = [(np.sort(rng.choice(1 << 19, 20_000, replace=False)).astype(np.int32), np.full(20_000, 5e-5, np.float32)) for _ in range(600)]
    size = sum(u.nbytes + share.nbytes for u, share in bags)
    tracemalloc.start()
    try:
        subword.train_bags(bags, [i % 2 for i in range(600)], subword.Spec(epochs=1, min_steps=1, min_texts=5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak <= size + (80 << 20)  # their learned parts; vectors of 2^19 buckets and a batch


def test_pieces_hash_as_the_whole():
    """Words across the bounds of pieces, and one longer than a piece, by the formula."""
    some = [*texts(3 * tokens.PIECE), "", "x" * (2 * tokens.PIECE) + " y", " "]
    _, got = hashes(some)
    base, want = tokens._BASE, []
    for t in some:
        for word in t.encode().split():
            total, power = 0, 1
            for c in word:
                total, power = (total + int(tokens._BYTE[c]) * power) % 2**64, power * base % 2**64
            want.append((total + len(word)) % 2**64)
    assert got.tolist() == tokens.mix(np.array(want, dtype=np.uint64)).tolist()


def test_pieces_have_the_features_of_the_whole():
    some = [*texts(2 * tokens.PIECE), "", "x" * (2 * tokens.PIECE) + " y y", "éa  b"]
    alone = [list(subword.features([t], quality.SPEC)) for t in some]
    for k, (ids, counts) in enumerate(subword.features(some, quality.SPEC)):
        # A text too short for a family has none of it.
        parts = [a[k] if k < len(a) and len(a) == 5 else None for a in alone]
        at = np.concatenate(([0], np.cumsum(counts)))
        for d, part in enumerate(parts):
            if part is not None:
                assert ids[at[d] : at[d + 1]].tolist() == part[0].tolist()


def test_anchors_of_pieces_are_those_of_the_texts():
    some = [*texts(8 * tokens.PIECE), "", "a " * 70_000]
    first, h = hashes(some)
    lo, n, name = recompression.anchors(h, first)
    want = []
    for a, b in zip(first[:-1], first[1:]):
        x = recompression.anchors(h[a:b], np.array([0, b - a]))
        want += zip((x[0] + a).tolist(), x[1].tolist(), x[2].tolist())
    assert list(zip(lo.tolist(), n.tolist(), name.tolist())) == want


def test_kept_text_moves_once(documents):
    docs = documents([(1, "a b c"), (2, None), (3, "")])
    kept = quality.keep_good(docs, MODEL)
    plan = kept._jdf.queryExecution().analyzed().toString()
    assert plan.count("text#") and "AS _text#" not in plan
    assert "AS _text#" in quality.score_quality(docs, MODEL)._jdf.queryExecution().analyzed().toString()
    assert {r.doc_id for r in kept.collect()} <= {1}
