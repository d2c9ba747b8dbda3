"""Averaged subword embeddings with a softmax on top, trained by numpy SGD.

A text becomes a bag of hashed features: its words, its pairs of neighbouring
words and the character n-grams of its words (a space marks the word's ends).
Each feature bucket has a learned vector; a text is the mean of its vectors;
two output vectors give the softmax. Because the score is linear up to the
softmax, a trained model is applied as one number for each bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import PIECE, chunks, pieces

_rng = np.random.RandomState(7)
_MULTIPLIERS = _rng.randint(0, 2**63, size=(8, 8), dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


@dataclass(frozen=True)
class Spec:
    """What a model looks at and how it is trained."""

    lower: bool = False
    ngrams: tuple[int, ...] = (3, 4, 5)
    word_pairs: bool = True
    bits: int = 19  # 2^bits feature buckets
    #: Buckets seen in fewer fitting texts keep a zero vector: they only tell texts apart by heart.
    min_texts: int = 5
    #: Instead, learn the buckets whose texts' classes chance does not explain, few texts or many; see _telling.
    telling: bool = False
    dim: int = 4
    epochs: int = 8
    #: Few rows are gone through more often, until so many batches have been seen.
    min_steps: int = 500
    rate: float = 0.5
    batch: int = 32
    #: Labelled rows of class 0 and of class 1 used for fitting, at most.
    rows_per_class: tuple[int, int] = (1000, 2000)
    empty_score: float = 0.0
    seed: int = 11


@dataclass
class Model:
    spec: Spec
    weight: np.ndarray  # output difference for each bucket
    bias: float


def _hash(parts: list[np.ndarray], family: int, bits: int) -> np.ndarray:
    h = np.zeros(len(parts[0]), dtype=np.uint64)
    for j, p in enumerate(parts):
        h += p.astype(np.uint64) * _MULTIPLIERS[family, j]
    h ^= h >> np.uint64(29)
    h *= _MULTIPLIERS[family, 7]
    return (h >> np.uint64(64 - bits)).astype(np.int32)


def _words(c: np.ndarray, space: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A word's hash: sum of its characters' codes times odd powers, by position in the word."""
    out = np.empty(len(start), dtype=np.uint64)
    for a, b in pieces(start, end):
        some = slice(int(start[a]), int(end[b - 1]))
        scrambled = (c[some].astype(np.uint64) + np.uint64(77)) * _MULTIPLIERS[7, 0]
        scrambled ^= scrambled >> np.uint64(31)
        index = np.arange(len(scrambled))
        place = index - np.maximum.accumulate(np.where(space[some], index, -1))
        code = np.zeros(len(scrambled) + 1, dtype=np.uint64)
        np.cumsum(scrambled * (place.astype(np.uint64) * _MULTIPLIERS[7, 1] | np.uint64(1)), out=code[1:])
        out[a:b] = code[end[a:b] - some.start] - code[start[a:b] - some.start]
    return out


def features(texts: list[str], spec: Spec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Families of (bucket of each feature, number of them in each text)."""
    texts = [t.lower() for t in texts] if spec.lower else texts
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate(([0], np.cumsum(lengths + 1)))  # each text and a space before it
    joined = " " + " ".join(texts) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).copy()
    space = (c == 32) | ((c >= 9) & (c <= 13))
    c[space] = 32
    per_text = lambda at: np.diff(np.searchsorted(at, bounds))

    start = np.flatnonzero(~space[1:] & space[:-1]) + 1
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    word = _words(c, space, start, end)
    yield _hash([word], 0, spec.bits), per_text(start)
    if spec.word_pairs and len(start) > 1:
        same = word[1:] == word[:-1]
        inside = np.searchsorted(bounds, start[1:], "right") == np.searchsorted(bounds, start[:-1], "right")
        # A word followed by itself is one feature, whatever the word.
        left, right = np.where(same, 0, word[:-1]), np.where(same, 0, word[1:])
        yield _hash([left[inside], right[inside]], 1, spec.bits), per_text(start[:-1][inside])
    for n in spec.ngrams:
        if len(c) < n:
            continue
        m = len(c) - n + 1
        ok = np.ones(m, dtype=bool)
        for j in range(1, n - 1):
            ok &= ~space[j : j + m]
        at = np.flatnonzero(ok)
        if n > 1 and len(at):
            at = at[~(space[at] & space[at + n - 1])] if n <= 2 else at
        ids = np.empty(len(at), dtype=np.int32)
        for lo in range(0, len(at), PIECE):
            some = at[lo : lo + PIECE]
            ids[lo : lo + PIECE] = _hash([c[some + j] for j in range(n)], n if n < 7 else 6, spec.bits)
        counts = per_text(at)
        del ok, at
        yield ids, counts


def bag(text: str, spec: Spec) -> tuple[np.ndarray, np.ndarray]:
    """(distinct buckets, share of each) of a text; each family of features has the same say.

    At most 2^bits buckets, however long the text.
    """
    found = [f[0] for f in features([text], spec) if len(f[0])]
    if not found:
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    share = np.concatenate([np.full(len(f), 1 / len(f) / len(found)) for f in found])
    u, inverse = np.unique(np.concatenate(found), return_inverse=True)
    return u, np.bincount(inverse, share, len(u)).astype(np.float32)


def _texts_with(bags: list[tuple[np.ndarray, np.ndarray]], size: int) -> np.ndarray:
    """Number of bags that hold each bucket."""
    count = np.zeros(size, dtype=np.int64)
    for u, _ in bags:
        count[u] += 1
    return count


def _telling(bags: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int) -> np.ndarray:
    """Buckets whose share of class 1 is far from that of all texts.

    For n texts that differ from the base rate by a relative entropy of d nats, chance gives as much in a share of
    exp(-n d) of all buckets at most; it should do so for about one of those seen. So how many texts a bucket needs
    follows the class sizes: the rarer its class, the fewer.
    """
    texts, ones, base = _texts_with(bags, size), _texts_with([b for b, one in zip(bags, y) if one], size), y.mean()
    share = ones / np.maximum(texts, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.nan_to_num(share * np.log(share / base)) + np.nan_to_num((1 - share) * np.log((1 - share) / (1 - base)))
    return (texts > 0) & (texts * d >= np.log(max(2, np.count_nonzero(texts))))


def train(texts: list[str], labels: list[int], spec: Spec) -> Model:
    return train_bags([bag(t, spec) for t in texts], labels, spec)


def train_bags(bags: list[tuple[np.ndarray, np.ndarray]], labels: list[int], spec: Spec) -> Model:
    """Softmax over two classes by minibatch SGD with Adagrad step sizes.

    bags is used up: each gives way to its part that is learned.
    """
    rng = np.random.RandomState(spec.seed)
    size = 1 << spec.bits
    emb = rng.uniform(-1, 1, (size, spec.dim)).astype(np.float32) / spec.dim
    out = np.zeros((spec.dim, 2), dtype=np.float32)
    bias = np.zeros(2, dtype=np.float32)
    if len(set(labels)) < 2:  # nothing to tell apart
        sure = float(labels[0]) if labels else 0.5
        return Model(spec, np.zeros(size, np.float32), 6.0 * (2 * sure - 1))
    g_emb = np.full(size, 1e-8, dtype=np.float32)
    g_out = np.full(out.shape, 1e-8, dtype=np.float32)
    y = np.asarray(labels)
    if spec.telling:
        seen = _telling(bags, y, size)
        bias[1] = np.log(y.mean() / (1 - y.mean()))
    else:
        seen = _texts_with(bags, size) >= spec.min_texts
    # Only buckets seen often enough are learned; they are numbered densely while training.
    number = (np.cumsum(seen) - 1).astype(np.int32)
    for i, (u, share) in enumerate(bags):
        bags[i] = number[u[seen[u]]], share[seen[u]]
    n = int(seen.sum())
    emb, g_emb = emb[seen], g_emb[seen]
    # The mean of many near-random vectors is short; a fixed gain keeps steps sensible.
    gain = np.float32(10.0)
    steps = -(-len(bags) // spec.batch)
    for _ in range(max(spec.epochs, -(-spec.min_steps // steps))):
        order = rng.permutation(len(bags))
        for lo in range(0, len(order), spec.batch):
            part = order[lo : lo + spec.batch]
            if spec.telling:  # texts without a learned bucket tell about the bias
                blank = [y[i] for i in part if not len(bags[i][0])]
                one = np.float32(1 / (1 + np.exp(bias[0] - bias[1])))
                pull = np.float32(0.05 * sum(one - b for b in blank) / len(part))
                bias += np.array([pull, -pull], dtype=np.float32)
            part = [i for i in part if len(bags[i][0])]
            if not part:
                continue
            ids = np.concatenate([bags[i][0] for i in part])
            share = np.concatenate([bags[i][1] for i in part]) * gain
            cut = np.concatenate(([0], np.cumsum([len(bags[i][0]) for i in part])[:-1]))
            mean = np.add.reduceat(emb[ids] * share[:, None], cut, axis=0)
            z = mean @ out + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1.0  # gradient of the loss
            grad_out = mean.T @ p / len(part)
            grad_mean = p @ out.T
            if not out.any():
                grad_mean = p @ rng.uniform(-0.1, 0.1, (2, spec.dim)).astype(np.float32)
            row = np.repeat(np.arange(len(part)), np.diff(np.append(cut, len(ids))))
            grad = grad_mean[row] * share[:, None]
            g_out += grad_out**2
            out -= spec.rate * grad_out / np.sqrt(g_out)
            bias -= 0.05 * p.mean(axis=0)
            total = np.stack([np.bincount(ids, grad[:, d], n) for d in range(spec.dim)], axis=1).astype(np.float32)
            g_emb += (total**2).mean(axis=1)
            emb -= (spec.rate * 0.2) * total / np.sqrt(g_emb)[:, None]
    weight = np.zeros(size, np.float32)
    weight[seen] = emb @ (out[:, 1] - out[:, 0]) * gain
    return Model(spec, weight, float(bias[1] - bias[0]))


def score(texts: list[str], model: Model) -> np.ndarray:
    """Probability of class 1 for each text; texts without a word get spec.empty_score."""
    total = np.zeros(len(texts))
    families = np.zeros(len(texts))
    words = None
    for ids, counts in features(texts, model.spec):
        sums = np.zeros(len(ids) + 1)
        np.cumsum(model.weight[ids], dtype=np.float64, out=sums[1:])
        at = np.concatenate(([0], np.cumsum(counts)))
        total += (sums[at[1:]] - sums[at[:-1]]) / np.maximum(counts, 1)
        del ids, sums
        families += counts > 0
        words = counts if words is None else words
    z = total / np.maximum(families, 1) + model.bias
    return np.where(words > 0, 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))), model.spec.empty_score)


def held_out(doc_id) -> F.Column:
    """Rows that no model may learn from: crc32 of the id as text, modulo 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str, spec: Spec) -> Model:
    """Train on a bounded sample of the labelled rows that are not held out.

    At most spec.rows_per_class rows of each class, picked by a hash of the id,
    go to one task, which turns each text into its bag of buckets as it arrives
    (a text of any length has at most 2^bits) and trains; only the weights reach
    the driver. Rows with a null id, label or text are not learned from; an id
    with several labels counts with the largest.
    """
    known = (
        labels.select(F.col("doc_id").alias("_id"), F.col(label).alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & ~held_out("_id"))
        .groupBy("_id")
        .agg(F.max("_y").alias("_y"))
    )
    picked = None
    for y in (0, 1):
        some = known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(spec.rows_per_class[y])
        picked = some if picked is None else picked.unionByName(some)
    rows = (
        docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_text"))
        .where(F.col("_text").isNotNull())
        .join(picked, "_id")
        .groupBy("_id", "_y")
        .agg(F.min("_text").alias("_text"))
        .repartition(1)
        .sortWithinPartitions("_id")
    )

    def run(batches):
        bags, y = [], []
        for b in batches:
            for i in range(b.num_rows):
                bags.append(bag(b.column("_text")[i].as_py(), spec))
                y.append(int(b.column("_y")[i].as_py()))
        model = train_bags(bags, y, spec)
        yield pa.RecordBatch.from_arrays([pa.array([model.weight.tobytes()], pa.binary()), pa.array([model.bias])], names=["weight", "bias"])

    found = rows.select("_y", "_text").mapInArrow(run, "weight binary, bias double").first()
    if found is None:  # no rows, no task
        return train_bags([], [], spec)
    return Model(spec, np.frombuffer(found["weight"], dtype=np.float32), float(found["bias"]))


def apply(docs: DataFrame, model: Model, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """docs' columns ``keep`` (default doc_id) with held_out, score and predicted.

    The model (2^bits floats, 2 MB by default) goes to the tasks as a broadcast
    variable; texts are scored whole, in chunks of bounded size.
    """
    keep = keep or ["doc_id"]
    names = [f"_k{i}" for i in range(len(keep))]
    # A kept text is the one that is scored: it moves once.
    own = {c.lower(): n for c, n in zip(keep, names)}.get("text")
    text = own or "_text"
    source = docs.select(
        *[F.col(f"`{c}`").alias(n) for c, n in zip(keep, names)],
        *([] if own else [F.col("text").alias(text)]),
        held_out("doc_id").alias("_held"),
    )
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in batches:
            parts = [score(c.to_pylist(), m) for _, c in chunks(b.column(text))]
            s = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(n) for n in names] + [b.column("_held"), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[*names, "_held", "_score", "_predicted"],
            )

    fields = [f for n, f in ((n, source.schema[n]) for n in names)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    schema += f"{', ' if schema else ''}_held boolean, _score double, _predicted int"
    out = source.mapInArrow(run, schema)
    return out.select(
        *[F.col(n).alias(c) for c, n in zip(keep, names)],
        F.col("_held").alias("held_out"),
        F.col("_score").alias("score"),
        F.col("_predicted").alias("predicted"),
    )
