"""Structure repair of conversations by weighted CYK interval parsing.

A repaired conversation's roles match ``(s?(ua)+)?`` (s system, u user,
a assistant). Edits: Keep a row (cost 0), Rerole it to user or assistant (1),
Delete it (2, the only edit of blank rows and repeats), Insert an empty user or
assistant row anywhere (5); a truncated row that stays adds 5. Wanted is the
cheapest list of edits and, among the cheapest, the ASCII-least string of their
initials: the audit.

Method. The repair grammar is in Chomsky normal form. Its non-terminals N[p, q]
stand for "leads the target language from state p to state q" (states: start,
after s, after u, after a); binary rules are N[p, r] -> N[p, q] N[q, r], terminal
rules give each kind of row its edits, and the insertion closure adds what can be
inserted around a row. A cell holds the minimum (cost, audit) of each
non-terminal over a span of rows; cells are combined bottom-up by span length.
Two audits of one span and cost never are prefixes of each other (the longer one
would end in inserts, which cost), so the least concatenation is the
concatenation of the least parts. And since the target language is regular,
every split of a span gives the same minimum: each span is parsed at one split,
2n spans for n rows instead of n * n / 2 with n splits each.

Distribution. Per conversation Spark numbers the rows and finds faults with
windows over slim rows (no texts). One character a row goes to the parser, in
blocks of ``BLOCK`` rows parsed in separate tasks and combined in order, so no
task parses a long conversation alone. Then audits and texts meet in a sorted
stream, where a text is held only while it passes. What one task reads of one
conversation are its sorted rows, as a stream: the digest of a text is
sequential by nature.

Edge cases: null roles and texts count as one space; rows with a null id form a
conversation of their own; null turns come first; equal turns are ordered by
role and hash of the text, equal rows stand beside each other; a role that
begins with none of s, u, a (an empty one too) is kept by no edit; very long
texts pass one at a time; an empty table gives an empty report; input columns
are renamed first, so other columns' names cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Stages

KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 1), ("D", 2), ("I", 5)
TRUNCATED_COST = 5
BLOCK = 4096
#: White space, as trim() takes it: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"

# The target language's automaton.
START, SYSTEM, USER, ASSISTANT = range(4)
STEP = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ACCEPT = (START, ASSISTANT)
ROLE = {"u": "user", "a": "assistant"}

#: Kinds of rows: a role initial (s, u, a, else) and whether it is truncated; the last kind must be deleted.
INITIALS = "sua"
DELETE_ONLY = 8

Cell = dict[tuple[int, int], tuple[int, str]]


def _least(cell: Cell, key: tuple[int, int], value: tuple[int, str]) -> None:
    if key not in cell or value < cell[key]:
        cell[key] = value


def combine(left: Cell, right: Cell) -> Cell:
    """The binary rules N[p, r] -> N[p, q] N[q, r] over two neighbouring spans."""
    out: Cell = {}
    for (p, q), (c1, a1) in left.items():
        for (q2, r), (c2, a2) in right.items():
            if q == q2:
                _least(out, (p, r), (c1 + c2, a1 + a2))
    return out


def _closure() -> Cell:
    """Insertions only: the empty span."""
    cell: Cell = {(p, p): (0, "") for p in range(4)}
    while True:
        longer = dict(cell)
        for (p, q), (c, a) in cell.items():
            for role in ROLE:
                if (q, role) in STEP:
                    _least(longer, (p, STEP[q, role]), (c + INSERT[1], a + INSERT[0]))
        if longer == cell:
            return cell
        cell = longer


NOTHING = _closure()


def _row(kind: int) -> Cell:
    """Terminal rules of one kind of row, closed under insertions around it."""
    edits: Cell = {(p, p): (DELETE[1], DELETE[0]) for p in range(4)}
    if kind != DELETE_ONLY:
        initial, extra = (INITIALS + "-")[kind // 2], TRUNCATED_COST * (kind % 2)
        for (p, role), q in STEP.items():
            if role == initial:
                _least(edits, (p, q), (KEEP[1] + extra, KEEP[0]))
            if role in ROLE:
                _least(edits, (p, q), (REROLE[1] + extra, REROLE[0]))
    return combine(combine(NOTHING, edits), NOTHING)


ROWS = [_row(k) for k in range(DELETE_ONLY + 1)]


def parse(spans: list[Cell]) -> Cell:
    """The cell of all spans together, bottom-up by span length."""
    while len(spans) > 1:
        pairs = [combine(a, b) for a, b in zip(spans[::2], spans[1::2])]
        spans = pairs + spans[len(pairs) * 2 :]
    return spans[0] if spans else NOTHING


def best(cell: Cell) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair."""
    return min(cell[START, q] for q in ACCEPT if (START, q) in cell)


def parse_kinds(kinds: str) -> Cell:
    return parse([ROWS[int(k)] for k in kinds])


class Repair:
    """Follows an audit: which role each edit leaves."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _go(self, initial: str) -> str:
        self.state = STEP[self.state, initial]
        return initial

    def _next_role(self) -> str:
        return ROLE[self._go("a" if self.state == USER else "u")]

    def inserted(self) -> Iterator[str]:
        """Roles inserted here."""
        while self.audit[self.at : self.at + 1] == INSERT[0]:
            self.at += 1
            yield self._next_role()

    def row(self, role: str) -> tuple[str, str | None]:
        """(edit, role left or None) of the next row."""
        edit = self.audit[self.at]
        self.at += 1
        if edit == DELETE[0]:
            return edit, None
        if edit == KEEP[0]:
            self._go(role[0])
            return edit, role
        return edit, self._next_role()


def _rows(conversations: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    return conversations.select(
        F.col(conv).alias("_c"),
        F.col(turn).cast("long").alias("_t"),
        F.coalesce(F.col(role), F.lit(" ")).alias("_role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("_text"),
    ).withColumn("_d", F.md5(F.col("_text").cast("binary")))


def faults(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """Slim rows (_c, _pos, _t, _first_turn, _initial, _pair, _fault, _kind) in the order of turns, without texts.

    _fault is blank, duplicate, truncated or null; _pair joins the initials of
    the row before and this one; _first_turn marks the first row of a turn.
    """
    shown = F.trim(F.col("_text"), F.lit(BLANKS))
    rows = _rows(conversations, conv, turn, role, text).select(
        "_c", "_t", "_role", "_d",
        (shown == "").alias("_blank"),
        (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("_cut"),
        F.substring("_role", 1, 1).alias("_initial"),
    )
    # One shuffle serves both windows and the sums: all of them are within a conversation.
    rows = rows.repartition("_c")
    order = [F.col("_t").asc_nulls_first(), F.col("_role"), F.col("_d")]
    alike = Window.partitionBy("_c", "_role", "_d").orderBy(F.col("_t").asc_nulls_first())
    rows = rows.withColumn("_nth", F.row_number().over(alike))
    w = Window.partitionBy("_c").orderBy(*order, "_nth")
    fault = F.when(F.col("_blank"), "blank").when(F.col("_nth") > 1, "duplicate").when(F.col("_cut"), "truncated")
    kind = F.coalesce(F.nullif(F.expr(f"position(_initial, '{INITIALS}')"), F.lit(0)), F.lit(len(INITIALS) + 1)) - 1
    kind = F.when(F.col("_initial") == "", F.lit(len(INITIALS))).otherwise(kind)
    return (
        rows.withColumn("_fault", fault)
        .withColumn("_pos", F.row_number().over(w) - 1)
        .withColumn("_pair", F.concat(F.lag("_initial").over(w), F.col("_initial")))
        .withColumn("_first_turn", F.col("_t").isNotNull() & ~F.lag("_t").over(w).eqNullSafe(F.col("_t")))
        .withColumn(
            "_kind",
            F.when(F.col("_fault").isin("blank", "duplicate"), F.lit(DELETE_ONLY)).otherwise(
                2 * kind + F.coalesce(F.col("_fault") == "truncated", F.lit(False)).cast("int")
            ),
        )
    )


_CELL = "struct<p: array<int>, q: array<int>, cost: array<long>, audit: array<string>>"


def _pack(cell: Cell) -> dict:
    keys = list(cell)
    return {
        "p": [k[0] for k in keys], "q": [k[1] for k in keys], "cost": [cell[k][0] for k in keys], "audit": [cell[k][1] for k in keys]
    }


def _unpack(c: dict) -> Cell:
    return {(p, q): (cost, audit) for p, q, cost, audit in zip(c["p"], c["q"], c["cost"], c["audit"])}


def _parse_blocks(batches):
    known: dict[str, dict] = {}
    kind = pa.struct([("p", pa.list_(pa.int32())), ("q", pa.list_(pa.int32())), ("cost", pa.list_(pa.int64())), ("audit", pa.list_(pa.string()))])
    for b in batches:
        cells = []
        for kinds in b.column("_kinds").to_pylist():
            if len(kinds) > 16:
                cells.append(_pack(parse_kinds(kinds)))
                continue
            if kinds not in known:
                if len(known) > 100_000:
                    known.clear()
                known[kinds] = _pack(parse_kinds(kinds))
            cells.append(known[kinds])
        at = b.schema.get_field_index("_kinds")
        yield b.set_column(at, "_cell", pa.array(cells, kind))


def _join_blocks(batches):
    for b in batches:
        costs, audits = [], []
        for cells in b.column("_cells").to_pylist():
            cost, audit = best(parse([_unpack(c["_cell"]) for c in cells]))
            costs.append(cost)
            audits.append(audit)
        b = b.drop_columns(["_cells"])
        yield b.append_column("cost", pa.array(costs, pa.int64())).append_column("audit", pa.array(audits, pa.string()))


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def audits(conversations: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(_c, gaps, blank, duplicate, truncated, illegal, cost, audit): one row per conversation that has rows."""
    f = faults(conversations, conv, turn, role, text)

    def some(what: Column, name: str) -> Column:
        return F.count_if(what).alias(name)

    blocks = f.groupBy("_c", F.floor(F.col("_pos") / BLOCK).cast("long").alias("_block")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_kind"))), lambda x: x["_kind"].cast("string")), "").alias("_kinds"),
        F.min("_t").alias("_low"), F.max("_t").alias("_high"), some(F.col("_first_turn"), "_turns"),
        some(F.col("_fault") == "blank", "blank"), some(F.col("_fault") == "duplicate", "duplicate"),
        some(F.col("_fault") == "truncated", "truncated"), some(~F.col("_pair").isin("su", "ua", "au"), "illegal"),
    )
    c = f.schema["_c"].dataType.simpleString()
    stats = "_low long, _high long, _turns long, blank long, duplicate long, truncated long, illegal long"
    parsed = blocks.mapInArrow(_parse_blocks, f"_c {c}, _block long, _cell {_CELL}, {stats}")
    # The blocks of one conversation come together in order: a cell each, and sums.
    whole = parsed.groupBy("_c").agg(
        F.array_sort(F.collect_list(F.struct("_block", "_cell")), lambda a, b: (a["_block"] - b["_block"]).cast("int")).alias("_cells"),
        F.coalesce(F.max("_high") - F.min("_low") + 1 - F.sum("_turns"), F.lit(0)).alias("gaps"),
        *[F.sum(x).alias(x) for x in STATS[1:]],
    )
    return whole.mapInArrow(_join_blocks, f"_c {c}, " + ", ".join(f"{x} long" for x in STATS) + ", cost long, audit string")


def _stream(conversations: DataFrame, report: DataFrame, ids: DataFrame, names: tuple[str, str, str, str]) -> DataFrame:
    """Ids, reports and texts of conversations, each conversation's in one partition and in this order."""
    none = {"_t": "long", "_role": "string", "_text": "string", "_d": "string"}
    figures = [*STATS, "cost", "audit"]

    def blank(names) -> list[Column]:
        return [F.lit(None).cast(none.get(n, "string" if n == "audit" else "long")).alias(n) for n in names]

    texts = _rows(conversations, *names)
    parts = [
        ids.select(F.col("_c"), F.lit(0).alias("_k"), *blank([*none, *figures])),
        report.select("_c", F.lit(1).alias("_k"), *blank(none), *figures),
        texts.select("_c", F.lit(2).alias("_k"), *none, *blank(figures)),
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.repartition("_c").sortWithinPartitions("_c", "_k", F.col("_t").asc_nulls_first(), "_role", "_d").drop("_d")


def _conversations(batches) -> Iterator[tuple[object, dict, Iterator[tuple[str, str]]]]:
    """(id, report, lazy (role, text) rows) of each conversation of a sorted stream."""
    import itertools

    def rows():
        for b in batches:
            for i in range(0, b.num_rows, 256):
                yield from b.slice(i, 256).to_pylist()

    for key, group in itertools.groupby(rows(), key=lambda r: r["_c"]):
        report, first = {x: 0 for x in (*STATS, "cost")} | {"audit": ""}, []
        for r in group:
            if r["_k"] == 2:
                first = [r]
                break
            if r["_k"] == 1:
                report = {x: r[x] for x in report}
        yield key, report, ((r["_role"], r["_text"]) for r in itertools.chain(first, group))


def _repaired(audit: str, rows) -> Iterator[tuple[str, str | None, str | None]]:
    """(edit, role, text) of every edit in order; role and text are null for deletions."""
    repair = Repair(audit)
    for role, text in rows:
        for r in repair.inserted():
            yield INSERT[0], r, ""
        edit, left = repair.row(role)
        yield edit, left, None if left is None else text
    for r in repair.inserted():
        yield INSERT[0], r, ""


def _digests(batches):
    out: list[dict] = []
    for key, report, rows in _conversations(batches):
        sha, first = hashlib.sha256(), True
        for edit, role, text in _repaired(report["audit"], rows):
            if role is not None:
                sha.update((("" if first else "\n") + role + ":").encode())
                sha.update(text.encode())
                first = False
        out.append({"_c": key, **report, "repaired_sha256": sha.hexdigest()})
        if len(out) == 1024:
            yield out
            out = []
    yield out


def repair_report(
    conversations: DataFrame, stages: Stages, ids: DataFrame | None = None, conv="conv_id", turn="turn", role="role", text="text"
) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    ``ids`` (conv_id) adds conversations that have no rows: zeros, an empty audit
    and the hash of an empty text.
    """
    report = stages.put(audits(conversations, conv, turn, role, text))
    source = conversations if ids is None else ids
    listed = source.select(F.col(conv).alias("_c")).distinct()
    kind = conversations.schema[conv].dataType
    out = T.StructType([T.StructField("_c", kind), *[T.StructField(x, T.LongType()) for x in (*STATS, "cost")],
                        T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def run(batches):
        for rows in _digests(batches):
            yield pa.RecordBatch.from_pylist(rows, schema=_arrow(out))

    return _stream(conversations, report, listed, (conv, turn, role, text)).mapInArrow(run, out).withColumnRenamed("_c", conv)


def repaired_turns(conversations: DataFrame, stages: Stages, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations, row by row from position 0."""
    report = stages.put(audits(conversations, conv, turn, role, text))
    kind = conversations.schema[conv].dataType
    out = T.StructType([T.StructField("_c", kind), T.StructField("position", T.LongType()), *[
        T.StructField(x, T.StringType()) for x in ("edit", "role", "text")]])

    def run(batches):
        some = []
        for key, report, rows in _conversations(batches):
            position = 0
            for edit, role, text in _repaired(report["audit"], rows):
                if role is not None:
                    some.append({"_c": key, "position": position, "edit": edit, "role": role, "text": text})
                    position += 1
                if len(some) == 1024:
                    yield pa.RecordBatch.from_pylist(some, schema=_arrow(out))
                    some = []
        yield pa.RecordBatch.from_pylist(some, schema=_arrow(out))

    listed = report.select("_c")
    return _stream(conversations, report, listed, (conv, turn, role, text)).mapInArrow(run, out).withColumnRenamed("_c", conv)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
