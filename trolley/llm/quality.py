"""Quality classifier: supervised subword embeddings (see subword.py).

Words, pairs of neighbouring words and character n-grams keep their case and
punctuation, so shouting, symbol noise, tables and stuttering show. A null or
empty text, or one without words, scores 0 and is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import subword

SPEC = subword.Spec()
THRESHOLD = 0.3


def fit(docs: DataFrame, labels: DataFrame, spec: subword.Spec = SPEC) -> subword.Model:
    return subword.fit(docs, labels, "quality", spec)


def score_quality(docs: DataFrame, model: subword.Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row; repeated rows score alike."""
    return subword.apply(docs, model, threshold)


def keep_good(docs: DataFrame, model: subword.Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs that score at least the threshold, all columns as they were."""
    columns = docs.columns
    scored = subword.apply(docs, model, threshold, columns)
    names = [f"_k{i}" for i in range(len(columns))]
    scored = scored.toDF(*names, "_held", "_score", "_predicted")
    return scored.where(F.col("_predicted") == 1).select(*[F.col(n).alias(c) for n, c in zip(names, columns)])
