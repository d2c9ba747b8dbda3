"""Language-model scoring by cross-entropy difference.

Two bigram models, one of a target corpus and one of all documents, share one
vocabulary: every word of all documents. Both smooth alike:
p(w | v) = (c(v w) + m p(w)) / (c(v) + m), with add-one word probabilities
p(w), and m in proportion to the corpus, so that neither model is smoother than
the other because its corpus is larger. A document's score is the mean, over
its words, of log p_target - log p_background: higher is closer to the target.

A document is scored by models that have not seen it: its own counts are taken
out of both (of the target's only if it is a target document), so a target
document is not close to the target because its own words are counted there.

score_corpus() counts every document and every word, and nothing of that
reaches the driver. Texts move once, dealt by row into blocks of bounded size.
Each block sends its distinct pairs and words, as 64-bit names with counts, to
buckets of names; a bucket sums them and answers each block with the sums, in the
order asked. A name reaches its bucket once a block, however often it stands
there, so a common word is no hot key. Blocks and buckets grow in number with the
corpus, not in size, and a block writes to the buckets only that it has names
for: messages are never more than names, which are in proportion to the words.

Null, empty and wordless texts have no words and score 0. Null ids are scored
like others, but are no target. Repeated rows count and score as often as they
stand there, each without itself only; rows are dealt by their place, not by id
or text, so an id or a text that a third of all rows share is spread. Very long
texts are rows of one block. Without any target document both models are equal
up to smoothing. Other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import NOT_ALNUM, chunks, mix, words

#: Strength of the smoothing, as a share of a corpus' words.
SMOOTHING = 1e-4
#: What stands before a text's first word.
START = 1
#: Bytes of text of a block, and bytes of text whose share of all names goes to one bucket.
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 16 << 20
PAIR, WORD, TEXT = range(3)
#: Target ids that are broadcast (32 MB of them).
BROADCAST_IDS = 4_000_000
#: What is counted of a name, and how the packed values are stored.
COUNTS = ("n", "ends", "n_target", "ends_target")
ASKED, ANSWERED = [np.uint64, *[np.uint32] * len(COUNTS)], [np.int64] * len(COUNTS)


def _corpus_facts(texts: DataFrame) -> DataFrame:
    """One row (vocabulary, words, words_target) of texts (text, wanted); words of a chunk are summed before they move."""

    def run(batches):
        for b in batches:
            wanted = b.column("wanted").to_numpy(zero_copy_only=False)
            for row, part in chunks(b.column("text")):
                w = words(part, NOT_ALNUM, lower=True)
                h, at = np.unique(w.hashes(), return_inverse=True)
                inside = np.repeat(wanted[row : row + len(part)], w.counts)
                n = [np.bincount(at[some], minlength=len(h)) for some in (slice(None), inside)]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *map(pa.array, n)], names=["h", "n", "t"])

    counted = texts.select("text", "wanted").mapInArrow(run, "h bigint, n bigint, t bigint").groupBy("h").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return counted.agg(F.struct(F.count("*").alias("vocabulary"), total("n").alias("words"), total("t").alias("words_target")).alias("facts"))


def _names(texts: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names of the pair and of the word that end at each word, one row each; words of each text; words before each text)

    A name is a hash whose two lowest bits tell its kind.
    """
    found, counts = [np.zeros((2, 0), np.uint64)], [np.zeros(0, np.int64)]
    for piece in texts.chunks:
        for _, part in chunks(piece):
            w = words(part, NOT_ALNUM, lower=True)
            h = w.hashes()
            previous = np.empty_like(h)
            previous[1:] = h[:-1]
            previous[w.first[:-1][w.counts > 0]] = START
            pair = mix(mix(previous + np.uint64(0x9E3779B97F4A7C15)) + h)
            found.append(np.stack([n & ~np.uint64(3) | np.uint64(kind) for kind, n in ((PAIR, pair), (WORD, h))]))
            counts.append(w.counts)
    n = np.concatenate(counts)
    return np.concatenate(found, axis=1), n, np.cumsum(n) - n


def _pack(columns: Sequence[np.ndarray]) -> bytes:
    """Arrays of one length, byte by byte of their values (most are small), compressed."""
    planes = (np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)
    return zlib.compress(b"".join(planes), 1)


def _unpack(packed: bytes, kinds: Sequence[type]) -> list[np.ndarray]:
    sizes = [np.dtype(k).itemsize for k in kinds]
    planes = np.frombuffer(zlib.decompress(packed), dtype=np.uint8).reshape(sum(sizes), -1)
    ends = np.cumsum(sizes)
    return [np.ascontiguousarray(planes[e - n : e].T).reshape(-1).view(k) for e, n, k in zip(ends, sizes, kinds)]


def score_corpus(docs: DataFrame, target_ids: DataFrame, smoothing: float = SMOOTHING, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background (nats per word) and score, for every row of docs.

    Models of the documents whose doc_id is in target_ids and of all documents,
    over the whole vocabulary.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks, buckets = size // block_bytes + 1, size // bucket_bytes + 1
    # A row's place in the table deals it out, before anything moves: the same for a task that runs again.
    place = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks))
    rows = docs.select(place.alias("block"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    ids = target_ids.select(F.col("doc_id").cast("bigint").alias("target")).where(F.col("target").isNotNull()).distinct()
    # Ids of a counted, small number go to the texts; beyond it the join moves the texts once more.
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    texts = rows.join(ids, F.col("doc_id") == F.col("target"), "left").select(
        "block", "doc_id", "text", F.col("target").isNotNull().alias("wanted")
    )

    def ask(t: pa.Table) -> pa.Table:
        out: list[tuple] = []
        found, n, first = _names(t["text"])
        wanted = t["wanted"].to_numpy()
        name, at = np.unique(np.append(found, np.uint64(TEXT)), return_inverse=True)
        at = at.reshape(-1)
        last = found.shape[1] + (first + n)[n > 0] - 1  # the words that no word follows
        inside = np.tile(np.repeat(wanted, n), 2)
        count = lambda some: np.bincount(some, minlength=len(name)).astype(np.uint32)
        counts = [count(at[:-1]), count(at[last]), count(at[:-1][inside]), count(at[last[wanted[n > 0]]])]
        # Texts with words, the context of their first words, have a name too.
        counts[0][at[-1]], counts[2][at[-1]] = (n > 0).sum(), ((n > 0) & wanted).sum()
        # Buckets are ranges of names; sorted names are sent as steps from one to the next.
        bucket = (name >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
        to, starts = np.unique(bucket, return_index=True)
        for b, lo, hi in zip(to.tolist(), starts.tolist(), [*starts[1:].tolist(), len(name)]):
            steps = np.diff(name[lo:hi], prepend=np.uint64(0))
            out.append((t["block"][0].as_py(), b, _pack([steps, *(c[lo:hi] for c in counts)])))
        schema = pa.schema({"block": pa.int64(), "bucket": pa.int64(), "asked": pa.binary()})
        return pa.table([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def answer(t: pa.Table) -> pa.Table:
        rows = [_unpack(r, ASKED) for r in t["asked"].to_pylist()]
        cuts = np.cumsum([0, *(len(r[0]) for r in rows)]).tolist()
        name, at = np.unique(np.concatenate([np.cumsum(r[0], dtype=np.uint64) for r in rows]), return_inverse=True)
        at = at.reshape(-1)
        # Sums of floats are exact up to 2^53.
        sums = [np.bincount(at, np.concatenate([r[i] for r in rows]), len(name)).astype(np.int64) for i in range(1, len(ASKED))]
        packed = [_pack([c[at[lo:hi]] for c in sums]) for lo, hi in zip(cuts, cuts[1:])]
        return pa.table([t["block"], t["bucket"], pa.array(packed, pa.binary())], names=["block", "bucket", "answered"])

    def rate(t: pa.Table, answers: pa.Table) -> pa.Table:
        found, n, first = _names(t["text"])
        # The same sorted names as were asked for, so the buckets' answers follow one another.
        at = np.unique(np.append(found, np.uint64(TEXT)), return_inverse=True)[1].reshape(-1)
        answers = answers.sort_by("bucket")
        rows = [_unpack(r, ANSWERED) for r in answers["answered"].to_pylist()]
        counted = dict(zip(COUNTS, (np.concatenate(c) for c in zip(*rows))))
        facts = answers["facts"][0].as_py()
        pair, word, text = at[: found.shape[1]], at[found.shape[1] : -1], at[-1]
        doc = np.repeat(np.arange(len(n)), n)
        # How often each word's own text has its pair and its word, and has the word with another behind it.
        ends = np.zeros(len(word), np.int64)
        ends[(first + n)[n > 0] - 1] = 1
        own_pair, _ = _within(doc, pair, len(counted["n"]))
        own_word, own_ends = _within(doc, word, len(counted["n"]), ends)
        loss = []
        for corpus in ("_target", ""):
            mine = t["wanted"].to_numpy() if corpus else np.ones(len(n), dtype=bool)
            here = mine[doc].astype(np.int64)
            c, total = counted["n" + corpus], facts["words" + corpus] - n * mine
            follows = (c - counted["ends" + corpus])[word] - here * (own_word - own_ends)
            context = np.empty(len(word), np.int64)
            context[1:] = follows[:-1]
            context[first[n > 0]] = c[text] - mine[n > 0]
            m = np.maximum(1.0, smoothing * total)
            p = (c[word] - here * own_word + 1.0) / (total + facts["vocabulary"])[doc]
            nats = np.log((c[pair] - here * own_pair + m[doc] * p) / (context + m[doc]))
            loss.append(-np.bincount(doc, nats, len(n)) / np.maximum(n, 1) + 0.0)
        return pa.table(
            [t["doc_id"], pa.array(n.astype(np.int64)), *map(pa.array, loss), pa.array(loss[1] - loss[0])],
            names=["doc_id", "n_words", "loss_target", "loss_background", "score"],
        )

    by_block = texts.groupBy("block")
    asked = by_block.applyInArrow(ask, "block bigint, bucket bigint, asked binary")
    answered = asked.groupBy("bucket").applyInArrow(answer, "block bigint, bucket bigint, answered binary")
    answered = answered.withColumn("facts", _corpus_facts(texts).scalar())
    return by_block.cogroup(answered.groupBy("block")).applyInArrow(
        rate, "doc_id bigint, n_words bigint, loss_target double, loss_background double, score double"
    )


def _within(doc: np.ndarray, name: np.ndarray, names: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """For each word: how often its text has this name, and the sum of weight there."""
    _, at, n = np.unique(doc * names + name, return_inverse=True, return_counts=True)
    at = at.reshape(-1)
    return n[at], None if weight is None else np.bincount(at, weight, len(n)).astype(np.int64)[at]


def good_ids(labels: DataFrame) -> DataFrame:
    """doc_id of the documents labelled good and not toxic: the default target corpus."""
    return labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).select("doc_id")
