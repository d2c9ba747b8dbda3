"""Training sets over baskets and two classifiers.

The forest is fitted by Spark ML; its trees are then a table. Naive Bayes is trained
by grouped counts. Rows to predict are dealt into groups, and each group gets the
whole table of nodes or weights once (see plans/groups.py).

A training row is a basket with one frequent item X held out: label =
index(X), features = the sorted indices of the basket's other frequent items
(value 1). Indices number the frequent items by ascending frequency (ties by
item), from 1.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel, IndexToString, StringIndexer, VectorIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.groups import WHOLE, with_whole
from ..plans.numbering import numbered
from .recommend import with_id

Put = Callable[[DataFrame], DataFrame]

TRAIN_PERCENT = 80
RF_SEED = 12345
RF_TREES = 10
RF_MAX_CATEGORIES = 4
RF_DEPTH = 5
NB_SMOOTHING = 0.01
SHUFFLE_SEED = 12345
#: Rows of a group that is predicted at once, at least, and numbers of their scores handled at a time.
ROWS, SCORES = 1 << 14, 1 << 17
#: Bytes of training rows in a task of the forest, as it keeps them.
TASK_BYTES = 1 << 27


def item_index(frequent: DataFrame, put: Put) -> DataFrame:
    """(item, freq, idx): frequent items numbered from 1 by (freq, item).

    Written, so that Spark knows how small it is and does not broadcast the baskets to it.
    """
    rows = frequent.select("item", "freq")
    return put(numbered(rows, [F.col("freq"), F.col("item")], put, "idx").withColumn("idx", F.col("idx").cast("int")))


def keyed_training_rows(baskets: DataFrame, index: DataFrame, unique: bool = False) -> DataFrame:
    """(row_key, label DOUBLE, indices ARRAY<INT>): one row per frequent item of a basket.

    Basket items are joined to the index and regrouped per basket. Labels are
    then exploded, rows with no other frequent item dropped; ``unique`` keeps
    distinct rows. row_key tells rows apart and is the same in every run: the
    basket's key and the label, or the row's contents with ``unique``.
    """
    fidx = (
        with_id(baskets)
        .select("basket_id", F.explode("items").alias("item"))
        .join(index.select("item", "idx"), "item")
        .groupBy("basket_id")
        .agg(F.array_sort(F.collect_list("idx")).alias("fidx"))
    )
    rows = (
        fidx.where(F.size("fidx") > 1)
        .select("basket_id", "fidx", F.explode("fidx").alias("x"))
        .select(
            F.concat_ws("|", "basket_id", F.col("x").cast("string")).alias("row_key"),
            F.col("x").cast("double").alias("label"),
            F.filter("fidx", lambda i: i != F.col("x")).alias("indices"),
        )
    )
    if unique:
        rows = rows.select("label", "indices").distinct()
        rows = rows.select(F.to_json(F.struct("label", "indices")).alias("row_key"), "label", "indices")
    return rows


def training_rows(baskets: DataFrame, index: DataFrame, unique: bool = False) -> DataFrame:
    """(label, indices) of :func:`keyed_training_rows`."""
    return keyed_training_rows(baskets, index, unique).select("label", "indices")


def sparse_features(rows: DataFrame, n_features: int) -> DataFrame:
    """(row_key, label, features): indices 1..n_features as sparse 0/1 vectors, made on the JVM."""
    terms = rows.withColumn("terms", F.col("indices").cast("array<string>"))
    model = CountVectorizerModel.from_vocabulary(
        [str(i) for i in range(1, n_features + 1)], inputCol="terms", outputCol="features"
    )
    return model.setBinary(True).transform(terms).select("row_key", "label", "features")


def shuffled(rows: DataFrame, put: Put, seed: int = SHUFFLE_SEED) -> DataFrame:
    """rows with ``pos``, their place in a seeded shuffle: the order of a hash of seed and row_key.

    The same places whatever the partitions; rows of equal keys are equal rows.
    """
    key = F.md5(F.concat(F.lit(f"{seed}|"), F.col("row_key")).cast("binary"))
    return numbered(rows.withColumn("_key", key), [F.col("_key"), F.col("row_key")], put).drop("_key")


def training_counts(rows: DataFrame) -> DataFrame:
    """Training rows per label."""
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def train_test_split(data: DataFrame) -> tuple[DataFrame, DataFrame]:
    """80/20 by a hash of row_key: the same rows whatever the partitions."""
    bucket = F.conv(F.substring(F.md5("row_key"), 1, 8), 16, 10).cast("bigint") % 100
    in_train = bucket < TRAIN_PERCENT
    return data.where(in_train), data.where(~in_train)


def rf_pipeline(data: DataFrame) -> Pipeline:
    """Label indexer and feature indexer fitted on all data, then the forest.

    The forest is trained on the indexed features and predicts the indexed
    label; IndexToString maps the prediction back to the original label.
    """
    labels = StringIndexer(inputCol="label", outputCol="indexedLabel").fit(data)
    features = VectorIndexer(
        inputCol="features", outputCol="indexedFeatures", maxCategories=RF_MAX_CATEGORIES
    ).fit(data)
    rf = RandomForestClassifier(
        labelCol="indexedLabel", featuresCol="indexedFeatures", numTrees=RF_TREES, maxDepth=RF_DEPTH, seed=RF_SEED
    )
    back = IndexToString(inputCol="prediction", outputCol="predictedLabel", labels=labels.labels)
    return Pipeline(stages=[labels, features, rf, back])


def spread(train: DataFrame, n_features: int, most: int = TASK_BYTES) -> DataFrame:
    """train in partitions of at most about ``most`` bytes as the forest keeps it: a number per feature and row.

    On disk these rows are a hundred times smaller, so file splits hold too many. The
    rows of a partition and their order, on which the forest's bags depend, follow from row_key.
    """
    parts = -(-train.count() * (4 * n_features + 100) // most)
    if parts <= train.rdd.getNumPartitions():
        return train
    return train.repartition(parts, "row_key").sortWithinPartitions("row_key")


def rf_fit(data: DataFrame, n_features: int) -> PipelineModel:
    train, _ = train_test_split(data)
    return rf_pipeline(data).fit(spread(train, n_features))


def forest_table(model: PipelineModel, spark: SparkSession, path: str) -> DataFrame:
    """(tree, node, feature, left_values, threshold, left, right, shares): the fitted forest.

    Spark ML writes the model's nodes under ``path`` and they are read back as a
    table. Inner nodes have a feature (from 1, as in the training rows) and
    children; a categorical split sends the values in left_values to the left, a
    continuous one those up to threshold. shares are the classes' parts of a
    node's training rows.
    """
    model.stages[2].write().overwrite().save(path)
    n = F.col("nodeData")
    split = n["split"]
    values = split["leftCategoriesOrThreshold"]
    categorical = split["numCategories"] >= 0
    inner = n["leftChild"] >= 0
    stats = n["impurityStats"]
    total = F.aggregate(stats, F.lit(0.0), lambda s, x: s + x)
    return spark.read.parquet(f"{path}/data").select(
        F.col("treeID").cast("int").alias("tree"),
        n["id"].cast("int").alias("node"),
        F.when(inner, split["featureIndex"] + 1).cast("int").alias("feature"),
        F.when(inner & categorical, values).alias("left_values"),
        F.when(inner & ~categorical, F.get(values, F.lit(0))).alias("threshold"),
        F.when(inner, n["leftChild"]).cast("int").alias("left"),
        F.when(inner, n["rightChild"]).cast("int").alias("right"),
        F.transform(stats, lambda x: F.when(total != 0, x / total).otherwise(0.0)).alias("shares"),
    )


def _category_maps(model: PipelineModel) -> list[tuple[int, dict[float, int]]]:
    maps = model.stages[1].categoryMaps
    return [(f, dict(maps[f])) for f in maps]


def feature_codes(model: PipelineModel, spark: SparkSession) -> DataFrame:
    """(feature, absent, present): how the feature indexer codes 0 and 1 of each categorical feature.

    One row per frequent item; continuous features are left out and keep 0 and 1.
    """
    rows = [
        (f + 1, float(codes[0.0] if 0.0 in codes else 0), float(codes[1.0] if 1.0 in codes else 0))
        for f, codes in _category_maps(model)
    ]
    return spark.createDataFrame(rows, "feature int, absent double, present double")


def forest_rows(forest: DataFrame, codes: DataFrame) -> DataFrame:
    """The nodes with the codes of their feature (absent, present), as the tasks that predict get them."""
    return forest.join(codes, "feature", "left").select(
        "tree", "node", "feature", "left_values", "threshold", "left", "right",
        F.coalesce("absent", F.lit(0.0)).alias("absent"), F.coalesce("present", F.lit(1.0)).alias("present"), "shares",
    )


class Trees:
    """The node table in arrays: a node's row, whether it sends a row with or without its item to the left, children, shares."""

    def __init__(self, nodes: pa.Table):
        nodes = nodes.sort_by([("tree", "ascending"), ("node", "ascending")])
        tree, node = nodes["tree"].to_numpy(), nodes["node"].to_numpy()
        step = int(node.max()) + 1
        key = tree.astype(np.int64) * step + node
        self.feature = pc.fill_null(nodes["feature"], 0).to_numpy()
        self.inner = pc.is_valid(nodes["left"]).to_numpy()
        self.down = [np.searchsorted(key, tree * step + pc.fill_null(nodes[c], 0).to_numpy()) for c in ("left", "right")]
        self.goes_left = [np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)]
        columns = (nodes[c].to_pylist() for c in ("left_values", "threshold", "absent", "present"))
        for i, (values, threshold, absent, present) in enumerate(zip(*columns)):
            for has, value in enumerate((absent, present)):
                self.goes_left[has][i] = self.inner[i] and (value in values if values is not None else value <= threshold)
        self.roots = np.flatnonzero(np.concatenate(([True], tree[1:] != tree[:-1])))
        self.shares = np.array(nodes["shares"].to_pylist(), dtype=np.float64).reshape(len(key), -1)

    def leaves(self, has: np.ndarray) -> np.ndarray:
        """Rows of the nodes that rows of flags (by feature, from 1) reach, one column per tree."""
        at = np.repeat(self.roots[None, :], len(has), axis=0)
        rows = np.arange(len(has))[:, None]
        for _ in range(RF_DEPTH):
            left = np.where(has[rows, self.feature[at]], self.goes_left[1][at], self.goes_left[0][at])
            at = np.where(self.inner[at], np.where(left, self.down[0][at], self.down[1][at]), at)
        return at

    def classes(self, reached: np.ndarray) -> np.ndarray:
        """The class with the largest sum of shares over a row's leaves, the lowest of equals.

        Rows that reach the same leaves are scored once. Shares are added in the order of trees.
        """
        kinds, kind = np.unique(reached, axis=0, return_inverse=True)
        votes = np.zeros((len(kinds), self.shares.shape[1]))
        for t in range(kinds.shape[1]):
            votes += self.shares[kinds[:, t]]
        return votes.argmax(axis=1)[kind.reshape(-1)]


KEYED = "row_key string, label double, indices array<int>"


def _flat(lists: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, row of each) of a list column."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
    return pc.list_flatten(lists).to_numpy(), np.repeat(np.arange(len(sizes)), sizes)


def _vote(rows: pa.Table, nodes: pa.Table) -> pa.Table:
    trees = Trees(nodes)
    items, row = _flat(rows["indices"])
    has = np.zeros((rows.num_rows, max(int(trees.feature.max()), int(items.max(initial=0))) + 1), dtype=bool)
    has[row, items] = True
    return rows.append_column("prediction", pa.array(trees.classes(trees.leaves(has)).astype(np.float64)))


def label_index(data: DataFrame, put: Put) -> DataFrame:
    """(label, indexedLabel): labels numbered from 0, the commonest first, ties by the label's text.

    Written, so that Spark knows how small it is when it is joined.
    """
    counts = data.groupBy("label").agg(F.count("*").alias("_n")).withColumn("_text", F.col("label").cast("string"))
    rows = numbered(counts, [F.desc("_n"), F.col("_text")], put, "idx")
    return put(rows.select("label", (F.col("idx") - 1).cast("double").alias("indexedLabel")))


def rf_predict(rows: DataFrame, forest: DataFrame, codes: DataFrame, labels: DataFrame, put: Put) -> DataFrame:
    """(row_key, label, indexedLabel, prediction, predictedLabel) of the test rows (row_key, label, indices)."""
    _, test = train_test_split(rows)
    nodes = put(forest_rows(forest, codes))
    test = test.select("row_key", "label", "indices")
    voted = with_whole(test, test.count(), nodes, labels.count(), _vote, f"{KEYED}, prediction double", ROWS)
    back = labels.select(F.col("indexedLabel").alias("prediction"), F.col("label").cast("string").alias("predictedLabel"))
    return (
        voted.join(labels, "label").join(back, "prediction")
        .select("row_key", "label", "indexedLabel", "prediction", "predictedLabel")
    )


def matches(pred: DataFrame) -> DataFrame:
    """Diagonal of the contingency table: (label, prediction, c) with label = prediction."""
    return (
        pred.groupBy(F.col("indexedLabel").alias("label"), "prediction")
        .agg(F.count("*").alias("c"))
        .where(F.col("label") == F.col("prediction"))
        .orderBy("label")
    )


def accuracy(pred: DataFrame) -> DataFrame:
    """(n_test, accuracy): share of predictions equal to the indexed label, 0 without rows."""
    right = F.count_if(F.col("indexedLabel") == F.col("prediction"))
    return pred.agg(F.count("*").alias("n_test"), F.coalesce(F.try_divide(right, F.count("*")), F.lit(0.0)).alias("accuracy"))


def nb_model(train: DataFrame, n_features: Column, put: Put) -> tuple[DataFrame, DataFrame]:
    """Multinomial naive Bayes of (indexedLabel, indices) rows by grouped counts.

    classes (class, base, none): ln prior, and what every item of a row without
    counts in the class adds; terms (idx, class, gain): what an item that has
    counts adds to that. Counts are smoothed by NB_SMOOTHING.
    """
    s = F.lit(NB_SMOOTHING)
    per = train.groupBy(F.col("indexedLabel").alias("class")).agg(F.count("*").alias("n"), F.sum(F.size("indices")).alias("k"))
    per = put(per)
    totals = per.agg(F.sum("n").alias("rows"), F.count("*").alias("classes"))
    n, kinds = totals.select("rows").scalar(), totals.select("classes").scalar()
    classes = per.select(
        "class",
        (F.ln(F.col("n") + s) - F.ln(n + kinds * s)).alias("base"),
        (F.ln(s) - F.ln(F.col("k") + n_features * s)).alias("none"),
    )
    counts = train.select(F.col("indexedLabel").alias("class"), F.explode("indices").alias("idx")).groupBy("class", "idx").agg(F.count("*").alias("c"))
    return put(classes), put(counts.select("idx", "class", (F.ln(F.col("c") + s) - F.ln(s)).alias("gain")))


def _score(rows: pa.Table, weights: pa.Table) -> pa.Table:
    """rows with the class of the largest score, rounded to 9 places, the lowest of equals."""
    weights = weights.sort_by("idx")
    lists = weights["of"].combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    flat, owner = lists.flatten(), np.repeat(weights["idx"].to_numpy(), lists.value_lengths().to_numpy())
    number, x = flat.field("class").to_numpy(), flat.field("x").to_numpy()
    own = owner == 0  # the classes themselves: item numbers begin at 1
    classes = np.sort(number[own])
    at = np.searchsorted(classes, number)
    base, none = np.zeros(len(classes)), np.zeros(len(classes))
    base[at[own]], none[at[own]] = x[own], flat.field("none").to_numpy(zero_copy_only=False)[own]
    items, row = _flat(rows["indices"])
    gains = np.zeros((max(int(owner.max()), int(items.max(initial=0))) + 1, len(classes)))
    gains[owner[~own], at[~own]] = x[~own]
    first = np.searchsorted(row, np.arange(rows.num_rows + 1))
    won = np.zeros(rows.num_rows, dtype=np.int64)
    step = max(1, SCORES // len(classes))
    for lo in range(0, rows.num_rows, step):
        cut = first[lo : lo + step + 1]
        size = np.diff(cut)
        gain = np.zeros((len(size), len(classes)))
        some = size > 0
        if some.any():
            gain[some] = np.add.reduceat(gains[items[cut[0] : cut[-1]]], (cut[:-1] - cut[0])[some], axis=0)
        won[lo : lo + step] = np.round(base + size[:, None] * none + gain, 9).argmax(axis=1)
    return rows.append_column("prediction", pa.array(classes[won]))


def nb_predict(rows: DataFrame, labels: DataFrame, n_features: Column, put: Put, whole: int = WHOLE) -> DataFrame:
    """(row_key, label, indexedLabel, prediction) of the test rows: multinomial naive Bayes on the indexed label.

    A row's score in a class is its base, what its size adds without any counts, and
    the gains of its items; the largest, rounded to 9 places, wins, the lowest class of
    equals. Rows are scored in groups that hold all weights; where these are more than
    ``whole`` numbers, the items meet their gains in a join.
    """
    train, test = train_test_split(rows.join(labels, "label"))
    classes, terms = nb_model(train, n_features, put)
    n_labels = labels.count()
    if n_labels * n_labels > whole:
        return _nb_joined(test, classes, terms, put)
    x = terms.select("idx", F.struct("class", F.col("gain").alias("x"), F.lit(0.0).alias("none")).alias("w"))
    own = classes.select(F.lit(0).alias("idx"), F.struct("class", F.col("base").alias("x"), "none").alias("w"))
    weights = put(own.unionByName(x).groupBy("idx").agg(F.collect_list("w").alias("of")))
    test = test.select("row_key", "label", "indices", "indexedLabel")
    scored = with_whole(test, test.count(), weights, n_labels, _score, f"{KEYED}, indexedLabel double, prediction double", ROWS)
    return scored.select("row_key", "label", "indexedLabel", "prediction")


def _nb_joined(test: DataFrame, classes: DataFrame, terms: DataFrame, put: Put) -> DataFrame:
    """The same by joins, for weights that do not fit a task; rows of equal items are scored once."""
    sets = put(test.select("indices").distinct())
    gains = (
        sets.select("indices", F.explode("indices").alias("idx")).join(terms, "idx")
        .groupBy("indices", "class").agg(F.sum("gain").alias("gain"))
    )
    listed = classes.agg(F.collect_list("class").alias("c")).select("c").scalar()
    scored = (
        sets.select("indices", F.explode(listed).alias("class"))
        .join(classes, "class")
        .join(gains, ["indices", "class"], "left")
        .select("indices", "class", F.round(F.col("base") + F.size("indices") * F.col("none") + F.coalesce("gain", F.lit(0.0)), 9).alias("score"))
    )
    won = scored.groupBy("indices").agg(F.max(F.struct("score", (-F.col("class")).alias("class")))["class"].alias("c"))
    return test.join(won.select("indices", (-F.col("c")).alias("prediction")), "indices").select(
        "row_key", "label", "indexedLabel", "prediction"
    )
