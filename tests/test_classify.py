"""Classifiers against Spark ML's own predictions and, over their stored tables, against SQL."""

import duckdb
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from tests.helpers import tables
from trolley import queries as Q
from trolley.config import DEFAULT
from trolley.operators import classify as C
from trolley.plans.market_basket import BasketRun
from trolley.plans.numbering import numbered


@pytest.fixture(scope="module")
def trained(spark):
    return Q.run(spark, SF_SMALL, DEFAULT.with_(support_item=0.02))


def test_forest_predicts_as_spark_ml_does(trained):
    _, test = C.train_test_split(trained.training_data)
    theirs = trained.rf_model.transform(test).select("row_key", "indexedLabel", "prediction", "predictedLabel")
    ours = trained.rf_predictions.select(*theirs.columns)
    assert ours.count() == test.count() > 100
    assert ours.exceptAll(theirs).count() == 0 and theirs.exceptAll(ours).count() == 0
    assert len({r.prediction for r in ours.collect()}) > 1


def test_forest_in_sql_from_the_stored_nodes(trained, tmp_path):
    """The node table and the test rows alone give the same predictions, contingency and accuracy in DuckDB."""
    _, test = C.train_test_split(trained.keyed_training_rows)
    for name, df in (
        ("nodes", trained.forest), ("test", test), ("codes", C.feature_codes(trained.rf_model, trained.spark)), ("labels", trained.label_index),
    ):
        df.coalesce(1).write.parquet(str(tmp_path / name))
    con = duckdb.connect()
    for name in ("nodes", "test", "codes", "labels"):
        con.execute(f"CREATE TABLE {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}/*.parquet')")
    con.execute(
        """CREATE TABLE pred AS
        WITH RECURSIVE walk AS (
          SELECT row_key, indices, tree, node FROM test CROSS JOIN (SELECT tree, min(node) AS node FROM nodes GROUP BY tree)
          UNION ALL
          SELECT w.row_key, w.indices, w.tree,
                 CASE WHEN CASE WHEN n.left_values IS NOT NULL THEN list_contains(n.left_values, x.v) ELSE x.v <= n.threshold END
                      THEN n."left" ELSE n."right" END
          FROM walk w JOIN nodes n ON n.tree = w.tree AND n.node = w.node LEFT JOIN codes c ON c.feature = n.feature,
               LATERAL (SELECT CASE WHEN list_contains(w.indices, n.feature) THEN coalesce(c.present, 1.0)
                               ELSE coalesce(c.absent, 0.0) END AS v) x
          WHERE n."left" IS NOT NULL),
        votes AS (
          SELECT w.row_key, i - 1 AS class, sum(n.shares[i]) AS vote FROM walk w
          JOIN nodes n ON n.tree = w.tree AND n.node = w.node AND n."left" IS NULL, range(1, len(n.shares) + 1) r(i) GROUP BY 1, 2),
        won AS (SELECT row_key, class FROM (
          SELECT *, row_number() OVER (PARTITION BY row_key ORDER BY round(vote, 12) DESC, class) AS rn FROM votes) WHERE rn = 1)
        SELECT t.row_key, l.indexedLabel, CAST(w.class AS DOUBLE) AS prediction
        FROM test t JOIN won w ON w.row_key = t.row_key JOIN labels l ON l.label = t.label"""
    )
    ours = trained.rf_predictions
    assert sorted(con.sql("FROM pred").fetchall()) == sorted(tuple(r) for r in ours.select("row_key", "indexedLabel", "prediction").collect())
    table = con.sql("SELECT indexedLabel, prediction, count(*) FROM pred WHERE indexedLabel = prediction GROUP BY 1, 2 ORDER BY 1").fetchall()
    assert [tuple(r) for r in C.matches(ours).collect()] == table
    n, share = con.sql("SELECT count(*), avg(CASE WHEN indexedLabel = prediction THEN 1.0 ELSE 0.0 END) FROM pred").fetchall()[0]
    assert tuple(C.accuracy(ours).first()) == (n, pytest.approx(share))


def test_naive_bayes_predicts_as_spark_ml_does(trained):
    data = trained.training_data
    train, test = C.train_test_split(data)
    labels = StringIndexer(inputCol="label", outputCol="indexedLabel").fit(data)
    nb = NaiveBayes(smoothing=C.NB_SMOOTHING, modelType="multinomial", labelCol="indexedLabel", featuresCol="features")
    theirs = Pipeline(stages=[labels, nb]).fit(train).transform(test).select("row_key", "label", "indexedLabel", "prediction")
    ours = trained.nb_predictions
    assert ours.count() == test.count()
    assert ours.exceptAll(theirs).count() == 0


def test_numbers_of_a_shared_frequency_are_spread(spark, trained):
    """One frequency for all items: numbered in item order, over many partitions, without a window per frequency."""
    items = spark.range(5000).select(F.format_string("%05d", "id").alias("item"), F.lit(7).alias("freq")).repartition(9)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        kept = []

        def put(df):
            kept.append(trained._put(df))
            return kept[-1]

        index = C.item_index(items, put)
        assert [(r.item, r.idx) for r in index.orderBy("idx").collect()] == [(f"{i:05d}", i + 1) for i in range(5000)]
        sizes = [r["count"] for r in kept[0].groupBy(F.shiftright("_at", 33)).count().collect()]
        assert len(sizes) > 1 and max(sizes) < 5000 / 2
        assert "windowspecdefinition(freq" not in index._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_numbered_edge_cases(spark, trained):
    empty = spark.createDataFrame([], "a int, b string")
    assert numbered(empty, [F.col("a")], trained._put).collect() == []
    rows = spark.createDataFrame([(2, "x"), (None, "y"), (1, None), (1, None)], "a int, b string")
    got = numbered(rows, [F.col("a").asc_nulls_last(), F.col("b")], trained._put, "n").orderBy("n").collect()
    assert [tuple(r) for r in got] == [(1, None, 1), (1, None, 2), (2, "x", 3), (None, "y", 4)]


def test_shuffle_does_not_depend_on_partitions(spark, trained):
    rows = trained.keyed_training_rows
    orders = []
    for parts, shuffles in ((1, 3), (11, 8)):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(shuffles))
        orders.append([tuple(r) for r in C.shuffled(rows.repartition(parts), trained._put).select("pos", "row_key").orderBy("pos").collect()])
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert orders[0] == orders[1] and [p for p, _ in orders[0]] == list(range(1, rows.count() + 1))
    keys = [k for _, k in orders[0]]
    assert keys != sorted(keys)
    other = C.shuffled(rows, trained._put, seed=1).orderBy("pos").select("row_key").collect()
    assert [r.row_key for r in other] != keys


def test_no_training_rows(spark):
    run = BasketRun(spark, tables(spark, [(1, 1, "a", 1.0)]), DEFAULT.with_(taxo=False, cartsize_min=1))
    assert run.training_rows.collect() == [] and run.nb_predictions.collect() == [] and run.shuffled_rows.collect() == []


def test_naive_bayes_holds_no_row_per_class(trained):
    """Test rows meet all weights in groups: no row per set of items and class. The join for many weights agrees."""
    args = (trained.keyed_training_rows, trained.label_index, trained.n_features, trained._put)
    ours, joined = C.nb_predict(*args), C.nb_predict(*args, whole=0)
    plan = ours._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.split("FlatMapCoGroupsInArrow")[1].split("\n")[1] and "Aggregate" not in plan
    assert ours.exceptAll(joined).count() == joined.exceptAll(ours).count() == 0 < ours.count()


def test_forest_rows_meet_the_nodes_once(trained):
    """No join of rows with nodes level by level, and none on the leaves that rows reach: most rows reach the same ones."""
    _, test = C.train_test_split(trained.keyed_training_rows)
    codes = C.feature_codes(trained.rf_model, trained.spark)
    ours = C.rf_predict(trained.keyed_training_rows, trained.forest, codes, trained.label_index, trained._put)
    plan = ours._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 2 and "Aggregate" not in plan
    assert ours.count() == test.count() > 0


def test_training_rows_are_spread_by_what_the_forest_keeps(trained):
    """Partitions follow from the rows' size in memory, not from the files; rows and their order from row_key alone."""
    train, _ = C.train_test_split(trained.training_data)
    n = trained.item_index.count()
    most = train.count() * (4 * n + 100) // 11
    few, many = C.spread(train.coalesce(1), n, most), C.spread(train.repartition(3), n, most)
    assert few.rdd.getNumPartitions() == many.rdd.getNumPartitions() == 12
    parts = [[[r.row_key for r in p] for p in df.select("row_key").rdd.glom().collect()] for df in (few, many)]
    assert parts[0] == parts[1] and max(map(len, parts[0])) < 2 * train.count() / 12
    assert few.exceptAll(train).count() == 0 == train.exceptAll(few).count()
    assert C.spread(train, n) is train
