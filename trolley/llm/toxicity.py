"""Toxicity: subword-bag embeddings averaged into a linear softmax (see subword.py).

Texts are lower-cased; unseen spellings of a toxic word share character
n-gram vectors with the known ones. A null or empty text, or one without
words, scores 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from . import subword

#: Toxic words are few in a long text: only buckets whose texts' classes chance does not explain are learned.
SPEC = subword.Spec(lower=True, word_pairs=False, ngrams=(3, 4, 5), telling=True, rows_per_class=(3000, 1500))
THRESHOLD = 0.5


def fit(docs: DataFrame, labels: DataFrame, spec: subword.Spec = SPEC) -> subword.Model:
    return subword.fit(docs, labels, "toxic", spec)


def score_toxicity(docs: DataFrame, model: subword.Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; repeated rows score alike."""
    return subword.apply(docs, model, threshold)
