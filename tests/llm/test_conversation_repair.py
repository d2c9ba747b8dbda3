"""Conversation repair against a plain search over all edits, and the query against a row-by-row version."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from trolley.llm import conversation_repair as CR
from trolley.llm import queries as LQ

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?\Z")


def cheapest(kinds):
    """(cost, audit, roles) by Dijkstra over (rows done, roles so far): no grammar, no cells."""
    import heapq

    heap, done = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if i == len(kinds) and GRAMMAR.match(roles):
            return cost, audit, roles
        # What may follow depends on the last role only; any further way to the same place costs more or sorts later.
        place = (i, roles[-1:], roles == "")
        if place in done:
            continue
        done.add(place)
        steps = [(5, "I", i, r) for r in "ua"]
        if i < len(kinds):
            initial, cut, must = kinds[i]
            steps.append((2, "D", i + 1, ""))
            if not must:
                steps += [(1 + 5 * cut, "R", i + 1, r) for r in "ua"]
                if initial in "sua" and initial:
                    steps.append((5 * cut, "K", i + 1, initial))
        for c, letter, j, r in steps:
            new = roles + r
            if re.match(r"(s?(ua)*u?)\Z", new):
                heapq.heappush(heap, (cost + c, audit + letter, j, new))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.strip("\x20\x09\x0a\x0b\x0c\x0d")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def repaired(rows):
    """Report of one conversation; rows: (turn, role, text), ordered."""
    found = faults(rows)
    kinds = [(r[:1], f == "truncated", f in ("blank", "duplicate")) for (_, r, _), f in zip(rows, found)]
    cost, audit, roles = cheapest(kinds)
    lines, left, todo = [], iter(roles), iter(rows)
    for e in audit:
        if e == "I":
            lines.append({"u": "user:", "a": "assistant:"}[next(left)])
            continue
        _, role, text = next(todo)
        if e == "K":
            next(left)
            lines.append(f"{role}:{text}")
        elif e == "R":
            lines.append({"u": "user:", "a": "assistant:"}[next(left)] + text)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
    return (gaps, *[found.count(x) for x in ("blank", "duplicate", "truncated")], illegal, cost, audit, sha), lines


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))


def brute(table):
    """The whole query, from (conv_id, turn, role, text) rows."""
    out = {}
    for conv, turn, role, text in table:
        rows = out.setdefault(conv, [])
        c, t = (" " if x is None else str(x) for x in (conv, turn))
        role, text = (" " if x is None else x for x in (role, text))
        fate = zlib.crc32(f"{c}:{t}".encode()) % 20
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return {c: repaired(in_order(rows))[0] for c, rows in out.items()}


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def query(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "conversations.parquet"))
    return LQ.op12_conversation_repair(spark, str(tmp_path))


def test_cells_against_search():
    rng = random.Random(5)
    for n in list(range(7)) * 30 + [12, 25]:
        codes = [rng.choice([0, 2, 4, 2, 4, 1, 3, 5, 6, 7, 8]) for _ in range(n)]
        kinds = [("sua-"[k // 2], k % 2 == 1, False) if k < 8 else ("u", False, True) for k in codes]
        want = cheapest(kinds)[:2]
        assert CR.best(CR.parse_kinds("".join(map(str, codes)))) == want


def test_every_split_of_a_span_gives_the_same_cell():
    """Classic CYK over all spans and splits fills the cells that one split a span does."""
    rng = random.Random(8)
    for _ in range(20):
        codes = [rng.randrange(9) for _ in range(8)]
        cells = {(i, i + 1): CR.ROWS[k] for i, k in enumerate(codes)}
        for length in range(2, 9):
            for i in range(0, 9 - length):
                ways = [CR.combine(cells[i, j], cells[j, i + length]) for j in range(i + 1, i + length)]
                assert all(w == ways[0] for w in ways)
                cells[i, i + length] = ways[0]
        assert cells[0, 8] == CR.parse_kinds("".join(map(str, codes)))


def test_query_against_row_by_row_version(shipped, tmp_path):
    rng = random.Random(3)
    rows = []
    for c in list(range(60)) + [None, -7, 2**40]:
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usr"])
            text = rng.choice(["Yes.", "No!", "cut off", " \t\n", "", None, "Naïve? \x0b", "日本", f"t{t}."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    rows += rows[:5] + [(1000, None, None, None)]
    df = shipped.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS _c", "2 AS cost", "3 AS _t")
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in query(shipped, tmp_path, df).collect()}
    assert got == brute(rows)


def test_fixture_table(shipped):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in shipped.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in LQ.op12_conversation_repair(shipped, sf).collect()}
    assert got == brute(rows)


def test_dropped_and_empty(shipped, tmp_path, stages):
    empty = shipped.createDataFrame([], SCHEMA)
    assert CR.repair_report(empty, stages).collect() == []
    gone = next(t for t in itertools.count() if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    r = query(shipped, tmp_path, shipped.createDataFrame([(5, gone, "user", "x.")], SCHEMA)).collect()
    assert [tuple(x[c] for c in COLUMNS) for x in r] == [(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


@pytest.mark.parametrize("block", [3, 4096])
def test_long_conversation_in_blocks(shipped, stages, block, monkeypatch):
    """A conversation is parsed in blocks, and its repaired rows have the language's roles."""
    monkeypatch.setattr(CR, "BLOCK", block)
    rng = random.Random(1)
    rows = [(1, t, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", f"{t}.", f"{t}!", ""])) for t in range(120)]
    rows += [(2, 0, "user", "long " * 200_000 + ".")]
    df = shipped.createDataFrame(rows, SCHEMA).repartition(4)
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in CR.repair_report(df, stages).collect()}
    want = {c: repaired([(t, r, x) for d, t, r, x in rows if d == c]) for c in (1, 2)}
    assert got == {c: w[0] for c, w in want.items()}
    back = CR.repaired_turns(df, stages).orderBy("conv_id", "position").collect()
    for c in (1, 2):
        assert [f"{r.role}:{r.text}" for r in back if r.conv_id == c] == want[c][1]
        assert GRAMMAR.match("".join(r.role[0] for r in back if r.conv_id == c))
