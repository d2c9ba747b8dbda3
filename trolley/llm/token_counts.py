"""Token counts of documents by a map-side two-tier lookup.

Method. A byte-level BPE tokenizer cuts a text into pre-tokens and encodes each
one by itself, so a text's count is the sum of its pre-tokens' lengths:

1. tier one, broadcast: a compact table of the commonest pre-tokens and their
   lengths in tokens (``TABLE_SIZE`` of them), tallied on a bounded sample of
   ``SAMPLE_ROWS`` documents. The sample decides speed only, never a count;
2. tier two, worker caches: pre-tokens missing there are encoded by the library
   in batches and remembered by the Python worker (bounded, see ``CACHE_SIZE``).

No pre-token is shuffled and documents stay where they were read. What is
broadcast is the tokenizer file (fixed) and the table (bounded by its size).

The pre-tokens come from a Unicode pattern. The library's own pattern engine may
know another Unicode version: every character met is checked once against the
library, and texts holding one that the two classify differently are encoded
whole by the library, as are texts that hold a special token's string.

Edge cases: a null or empty text has 0 bytes and 0 tokens; rows with a null or
repeated id are counted each on its own; very long texts are read in slices of
pre-tokens, and pre-tokens over ``LONG_PIECE`` characters are encoded but not
remembered; an empty table gives an empty result; other columns are not read,
so their names cannot clash.
"""

from __future__ import annotations

import itertools
import os
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pre-tokens in the broadcast table, and documents sampled to find them.
TABLE_SIZE = 1 << 15
SAMPLE_ROWS = 4096
SAMPLE_PARTS = 4
#: Pre-tokens that a worker remembers beside the table; when full, it starts anew.
CACHE_SIZE = 1 << 18
LONG_PIECE = 64
SLICE = 1 << 16
CONTEXT = 512

#: Fixed value: the pattern that byte-level BPE vocabularies of this family are split by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@dataclass
class Packed:
    """What tasks need: the tokenizer's own JSON and the frequent pre-tokens with their lengths."""

    key: str
    json: str
    pieces: bytes  # Arrow stream: piece, n


class Counts:
    """Counts texts in one Python worker. Lengths not in the table are looked up in ``cache``."""

    def __init__(self, json: str, table: dict[str, int]):
        import regex
        from tokenizers import Tokenizer

        # Spark forks its workers and runs one per core; the library's own threads would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_str(json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pattern = regex.compile(PATTERN)
        self.table = table
        self.cache: dict[str, int] = {}
        self.agreed: set[str] = set(map(chr, range(128)))
        self.differing: set[str] = set()
        self.misses = 0

    def encode(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _same(self, c: str) -> bool:
        """Whether the library and the pattern cut around a character alike, next to each kind of neighbour."""
        s = "".join(f"{x}{c}{x}" for x in "a1! ") + c
        spans = [span for _, span in self.tokenizer.pre_tokenizer.pre_tokenize_str(s)]
        return [s[x:y] for x, y in spans] == self.pattern.findall(s)

    def by_pieces(self, text: str) -> bool:
        if any(s in text for s in self.special):
            return False
        if not text.isascii():
            chars = set(text) - self.agreed
            for c in chars - self.differing:
                (self.agreed if self._same(c) else self.differing).add(c)
            return self.differing.isdisjoint(chars)
        return True

    def slices(self, text: str) -> Iterator[list[str]]:
        if len(text) <= SLICE:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while some := list(itertools.islice(found, SLICE)):
            yield some

    def lengths(self, missing: set[str]) -> dict[str, int]:
        """Lengths of pre-tokens that the table lacks, from the cache or the library."""
        known = {p: self.cache[p] for p in missing if p in self.cache}
        new = [p for p in missing if p not in known]
        self.misses += len(new)
        for i in range(0, len(new), 4096):
            some = new[i : i + 4096]
            known.update(zip(some, self.encode(some)))
        if len(self.cache) + len(new) > CACHE_SIZE:
            self.cache.clear()
        for p in itertools.islice(new, CACHE_SIZE):
            if len(p) <= LONG_PIECE:
                self.cache[p] = known[p]
        return known

    def count(self, texts: list[str | None]) -> list[int]:
        out = [0] * len(texts)
        waiting: list[tuple[int, list[str]]] = []
        missing: set[str] = set()

        def settle() -> None:
            known = self.lengths(missing)
            for i, pieces in waiting:
                out[i] += sum(map(known.__getitem__, pieces))
            waiting.clear()
            missing.clear()

        get = self.table.get
        for i, text in enumerate(texts):
            if not text:
                continue
            if not self.by_pieces(text):
                out[i] = self.encode([text])[0]
                continue
            for pieces in self.slices(text):
                found = list(map(get, pieces))
                if None in found:
                    rest = [p for p, n in zip(pieces, found) if n is None]
                    waiting.append((i, rest))
                    missing.update(rest)
                    found = [n for n in found if n is not None]
                out[i] += sum(found)
                if len(missing) > SLICE:
                    settle()
        settle()
        return out


_counters: dict[str, Counts] = {}


def _counter(packed: Packed) -> Counts:
    """This worker's counter; it outlives a task, so its cache warms up."""
    if packed.key not in _counters:
        _counters.clear()
        table = pa.ipc.open_stream(packed.pieces).read_all()
        _counters[packed.key] = Counts(packed.json, dict(zip(table["piece"].to_pylist(), table["n"].to_pylist())))
    return _counters[packed.key]


def _tally(json: str):
    def run(batches):
        counts, counter = Counter(), Counts(json, {})
        for b in batches:
            for text in b.column("_text").to_pylist():
                if text and counter.by_pieces(text):
                    for pieces in counter.slices(text):
                        counts.update(p for p in pieces if len(p) <= LONG_PIECE)
        top = sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:TABLE_SIZE]
        yield pa.RecordBatch.from_pydict(
            {"piece": pa.array([p for p, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())}
        )

    return run


def frequent_table(docs: DataFrame, tokenizer: str, text: str = "text") -> Broadcast:
    """Broadcast of the commonest pre-tokens' lengths, for a tokenizer file (.json) and a corpus.

    About ``SAMPLE_ROWS`` documents, dealt by a hash of their text over the whole table,
    are tallied in ``SAMPLE_PARTS`` tasks; each sends at most ``TABLE_SIZE`` pre-tokens.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        json = f.read()
    n = docs.count()
    share = min(1.0, SAMPLE_ROWS / n) if n else 1.0
    dealt = F.pmod(F.xxhash64(text), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    sample = docs.where(dealt).select(F.col(text).alias("_text")).repartition(SAMPLE_PARTS)
    tallies: Counter[str] = Counter()
    for r in sample.mapInArrow(_tally(json), "piece string, n long").toArrow().to_batches():
        for piece, k in zip(r["piece"].to_pylist(), r["n"].to_pylist()):
            tallies[piece] += k
    return pack(spark, json, [p for p, _ in sorted(tallies.items(), key=lambda x: (-x[1], x[0]))[:TABLE_SIZE]])


def pack(spark: SparkSession, json: str, pieces: list[str]) -> Broadcast:
    import hashlib

    counter = Counts(json, {})
    table = pa.table({"piece": pa.array(pieces, pa.string()), "n": pa.array(counter.encode(pieces), pa.int32())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    raw = sink.getvalue().to_pybytes()
    key = hashlib.sha256(json.encode() + raw).hexdigest()
    return spark.sparkContext.broadcast(Packed(key, json, raw))


def count_tokens(docs: DataFrame, packed: Broadcast, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: bytes of the text in UTF-8 and tokens without special ones added."""

    def run(batches):
        counter = _counter(packed.value)
        for b in batches:
            for row in range(0, b.num_rows, CONTEXT):
                part = b.slice(row, CONTEXT)
                n = counter.count(part.column("_text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(id), part.column("n_bytes"), pa.array(n, pa.int64())], names=[id, "n_bytes", "n_tokens"]
                )

    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long")
    rows = docs.select(F.col(id), size.alias("n_bytes"), F.col(text).alias("_text"))
    kind = docs.schema[id].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id}` {kind}, n_bytes long, n_tokens long")
