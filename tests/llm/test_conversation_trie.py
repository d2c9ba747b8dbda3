"""The trie of conversations against a dictionary of all prefixes."""

import hashlib
import random
import re
import zlib

import pytest

from trolley.llm import conversation_trie as CT
from trolley.llm import queries as LQ

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute_nodes(convs):
    """convs: {id: tuple of (role, text)}; rows of the trie, sorted."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {p: [] for p in members}
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        leaves[p] = sum(leaves[q] for q in children[p]) or 1
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in children[p])
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if convs[c] == p)
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def brute_query(rows):
    original = {}
    for c, t, role, text in rows:
        if c is not None:
            original.setdefault(c, []).append((t, role or "", text or ""))
    for c, turns in original.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    plain = {c: tuple(r[1:] for r in turns) for c, turns in original.items()}
    whole = {}
    for c, turns in plain.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
        whole[c] = plain.get(base, ())[:h] + turns[h:]
    return brute_nodes(whole)


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def operator(df, stages):
    turns = CT.turns_of(df)
    return CT.prefix_trie(turns, turns.select("conv_id").distinct(), stages)


def some_rows(seed, n=150, deep=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        # Few words to choose from: many shared prefixes, copies, and conversations that continue others.
        for t in range(rng.choice([1, 2, 3, deep])):
            rows.append((c, t, ["user", "assistant"][t % 2], rng.choice(["a b", "a b", "a b", "c", "d e f"])))
    return rows


def test_fat_binary_search_finds_the_exit():
    rng = random.Random(2)
    for _ in range(40):
        paths = sorted({b"".join(bytes([rng.randrange(3)]) * 16 for _ in range(rng.randrange(12))) for _ in range(40)})
        trie = CT.ZFastTrie()
        order = rng.sample(range(len(paths)), len(paths))
        for i in range(0, len(order), 7):
            trie.insert_batch(i, [paths[j] for j in order[i : i + 7]])
        ends = {trie.path[i] for i, m in enumerate(trie.member) if m >= 0}
        assert ends == set(paths)
        # Compacted: every node but the root ends a path or has two children; handles are the edges' fattest numbers.
        for i in range(1, len(trie.path)):
            assert trie.member[i] >= 0 or trie.parent.count(i) >= 2
            f = CT.fattest(trie.extent[trie.parent[i]], trie.extent[i])
            assert trie.handles[hashlib.md5(trie.path[i][: 16 * f]).digest()] == i
        assert len(trie.handles) == len(trie.edges) == len(trie.path) - 1
        for p in paths + [b"".join(bytes([rng.randrange(4)]) * 16 for _ in range(rng.randrange(14))) for _ in range(30)]:
            node, child = trie.locate(CT.prefix_hashes(p))
            prefixes = [i for i in range(len(trie.path)) if p.startswith(trie.path[i])]
            assert node == max(prefixes, key=lambda i: trie.extent[i])
            nexts = [i for i in range(len(trie.path)) if trie.parent[i] == node and len(p) > len(trie.path[node])
                     and trie.path[i].startswith(p[: len(trie.path[node]) + 16])]
            assert [child] == (nexts or [None])


@pytest.mark.parametrize("a,b", [(0, 1), (0, 6), (5, 7), (7, 8), (4, 7), (8, 15)])
def test_fattest(a, b):
    assert CT.fattest(a, b) == max(range(a + 1, b + 1), key=lambda n: n & -n)


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 40)])
def test_nodes_against_all_prefixes(shipped, stages, seed, parts):
    rows = some_rows(seed)
    convs = {}
    for c, _, role, text in rows:
        convs[c] = convs.get(c, ()) + ((role, text),)
    before = shipped.conf.get("spark.sql.shuffle.partitions")
    try:
        shipped.conf.set("spark.sql.shuffle.partitions", str(parts))
        shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = shipped.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS pos", "2 AS words", "3 AS _t")
        assert found(operator(df, stages)) == brute_nodes(convs)
    finally:
        shipped.conf.set("spark.sql.shuffle.partitions", before)
        shipped.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_query(shipped, tmp_path):
    rng = random.Random(4)
    rows = [(c + off, t, r, x) for off in (0, 1000) for c, t, r, x in some_rows(6, 90)]
    rows += [(7, None, None, None), (7, None, "user", "x"), (None, 1, "user", "x"), (-20, 1, "user", "q"), (-7, 1, "user", "q w")]
    rows += rows[:4] + [(3000 + i, t, "user", "same") for i in range(60) for t in range(2)]
    rows += [(5000, t, "user", "long " * 50_000) for t in range(3)] + [(5001, t, "user", "deep") for t in range(300)]
    rng.shuffle(rows)
    shipped.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    assert found(LQ.op11_conversation_trie(shipped, str(tmp_path))) == brute_query(rows)


def test_fixture_table(shipped):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in shipped.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(LQ.op11_conversation_trie(shipped, sf)) == brute_query(rows)


def test_ids_in_many_chunks(shipped, stages, monkeypatch):
    monkeypatch.setattr(CT, "CHUNK", 8)
    rows = [(c, 0, "user", "hello") for c in range(-30, 300)]
    assert found(operator(shipped.createDataFrame(rows, SCHEMA), stages)) == brute_nodes({c: (("user", "hello"),) for c in range(-30, 300)})


def test_empty_tables(shipped, stages):
    assert found(operator(shipped.createDataFrame([], SCHEMA), stages)) == []
    ids = shipped.createDataFrame([(4,), (5,)], "conv_id long")
    none = CT.turns_of(shipped.createDataFrame([], SCHEMA))
    assert found(CT.prefix_trie(none, ids, stages)) == brute_nodes({4: (), 5: ()})
