"""The market-basket job as a chain of stages.

lines -> baskets -> item counts -> pair counts -> rules -> recommendations ->
evaluation. Each stage is a DataFrame plan; the four that many later steps
read (baskets, item counts, pair counts, rules) are written once as stage
tables, so every step after them starts from small files rather than from the
receipt lines. The number of Spark jobs does not depend on the number of
items or pairs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, BasketConfig
from ..operators import baskets as B
from ..operators import classify as C
from ..operators import evaluate as E
from ..operators import mining as M
from ..operators import recommend as R
from ..operators import reports as P
from ..sources import files as S
from ..sources.fixtures import Tables
from .stages import StageStore


class BasketRun:
    def __init__(
        self,
        spark: SparkSession,
        tables: Tables,
        cfg: BasketConfig = DEFAULT,
        store: StageStore | None = None,
        materialize: bool = True,
    ):
        self.spark = spark
        self.tables = tables
        self.cfg = cfg
        self.materialize = materialize
        self._store = store

    # -- stage plumbing

    @property
    def store(self) -> StageStore:
        if self._store is None:
            self._store = StageStore(self.spark)
        return self._store

    def _stage(self, name: str, df: DataFrame) -> DataFrame:
        return self.store.put(name, df) if self.materialize else df

    # -- baskets

    @cached_property
    def baskets(self) -> DataFrame:
        """register, receipt, items (sorted), size — within the size bounds."""
        return self._stage("baskets", B.build_baskets(self.tables, self.cfg))

    @property
    def n_baskets(self) -> Column:
        return M.basket_count(self.baskets)

    @cached_property
    def names(self) -> DataFrame:
        """(item, name) of the basket vocabulary (category or catalog names)."""
        return B.vocabulary_names(self.tables, self.cfg)

    # -- counts

    @cached_property
    def item_freq(self) -> DataFrame:
        return self._stage("item_freq", M.item_freq(self.baskets))

    @cached_property
    def frequent(self) -> DataFrame:
        return M.frequent_items(self.item_freq, self.n_baskets, self.cfg.support_item)

    @cached_property
    def pair_freq(self) -> DataFrame:
        return self._stage("pair_freq", M.pair_freq(self.baskets, self.frequent, self.cfg))

    def frequent_subsets(self, support: float, k: int) -> DataFrame:
        return M.frequent_subsets(self.baskets, self.n_baskets, support, k, self._stage)

    # -- probabilities and rules

    @cached_property
    def item_prob_smoothed(self) -> DataFrame:
        return M.item_prob_smoothed(self.item_freq, self.n_baskets, self.cfg.smooth_k)

    @cached_property
    def frequent_prob(self) -> DataFrame:
        """Smoothed probability of the frequent items only (bounded table)."""
        n_item = self.item_freq.select(F.count("*")).scalar()
        return self.frequent.select(
            "item",
            M.smoothed(F.col("freq"), self.n_baskets, n_item, self.cfg.smooth_k).alias("prob"),
        )

    @cached_property
    def pair_prob_smoothed(self) -> DataFrame:
        return M.pair_prob_smoothed(
            self.pair_freq, self.n_baskets, self.cfg.smooth_k, self.cfg.support_pair
        )

    @cached_property
    def rules(self) -> DataFrame:
        """a, b, confidence = P(a given b), lift — unordered stage table."""
        return self._stage(
            "rules",
            M.association_rules(self.pair_prob_smoothed, self.frequent_prob, self.cfg),
        )

    @cached_property
    def rule_items(self) -> DataFrame:
        return M.rule_items(self.rules)

    # -- recommendations and their evaluation

    @cached_property
    def log_prob(self) -> DataFrame:
        return R.log_prob(self.rule_items, self.item_freq, self.n_baskets)

    @cached_property
    def rule_vectors(self) -> DataFrame:
        """(item, idx, lnp, terms): the rules as one vector per vocabulary item (stage table)."""
        return self._stage("rule_vectors", R.rule_vectors(self.rules, self.log_prob))

    def recommendations(self, variant: str | None = None) -> DataFrame:
        """(register, receipt, rank, item, log_score): the top n of every basket."""
        return R.recommend(self.baskets, self.rule_vectors, variant or R.variant_of(self.cfg), self.cfg.topn)

    @cached_property
    def ranked(self) -> DataFrame:
        """Leave-one-out samples with their top-n lists (stage table)."""
        return self._stage(
            "ranked",
            R.ranked_samples(self.baskets, self.rule_vectors, R.variant_of(self.cfg), self.cfg.topn),
        )

    @cached_property
    def topn_recs(self) -> DataFrame:
        return E.topn_recs(self.ranked)

    @cached_property
    def eval_per_item(self) -> DataFrame:
        return E.eval_per_item(self.ranked, self.rule_items, self.names, self.cfg.topn)

    @cached_property
    def eval_hits_by_rank(self) -> DataFrame:
        return E.eval_hits_by_rank(self.ranked, self.rule_items, self.cfg.topn)

    @cached_property
    def eval_overall(self) -> DataFrame:
        return E.eval_overall(self.ranked)

    @cached_property
    def eval_confusion(self) -> DataFrame:
        return E.eval_confusion(self.ranked, self.rule_items, self.cfg.topn)

    # -- classification

    def _put(self, df: DataFrame) -> DataFrame:
        """A stage table without a name of its own; written even if stages are not materialized."""
        self._n_put = getattr(self, "_n_put", 0) + 1
        return self.store.put(f"part_{self._n_put:03d}", df)

    @cached_property
    def item_index(self) -> DataFrame:
        return C.item_index(self.frequent, self._put)

    @property
    def n_features(self) -> Column:
        return self.item_index.select(F.count("*")).scalar()

    @cached_property
    def keyed_training_rows(self) -> DataFrame:
        """(row_key, label, indices) — see operators.classify.keyed_training_rows."""
        return self._stage("training_rows", C.keyed_training_rows(self.baskets, self.item_index, self.cfg.unique))

    @property
    def training_rows(self) -> DataFrame:
        return self.keyed_training_rows.select("label", "indices")

    @cached_property
    def shuffled_rows(self) -> DataFrame:
        """(row_key, label, indices, pos): the training rows in their seeded order."""
        return C.shuffled(self.keyed_training_rows, self._put)

    @cached_property
    def training_data(self) -> DataFrame:
        """(row_key, label, features): what the forest is fitted on (stage table)."""
        size = max(self.item_index.count(), 1)  # a vector's size is part of its plan
        return self._stage("training", C.sparse_features(self.keyed_training_rows, size))

    @cached_property
    def label_index(self) -> DataFrame:
        return C.label_index(self.keyed_training_rows, self._put)

    @cached_property
    def libsvm_data(self) -> DataFrame:
        """(label, features): the shuffled training rows as a libsvm file, read back."""
        path = f"{self.store.path}/training.libsvm"
        S.write_libsvm_text(self.shuffled_rows.repartitionByRange("pos").sortWithinPartitions("pos"), path)
        n_features = self.item_index.count()
        return S.read_libsvm(self.spark, path, max(n_features, 1))

    @cached_property
    def rf_model(self) -> PipelineModel:
        return C.rf_fit(self.training_data, max(self.item_index.count(), 1))

    @cached_property
    def forest(self) -> DataFrame:
        """The fitted forest as a table of nodes (stage table)."""
        return self._put(C.forest_table(self.rf_model, self.spark, f"{self.store.path}/forest"))

    @cached_property
    def rf_predictions(self) -> DataFrame:
        codes = C.feature_codes(self.rf_model, self.spark)
        return self._stage("rf_predictions", C.rf_predict(self.keyed_training_rows, self.forest, codes, self.label_index, self._put))

    @cached_property
    def nb_predictions(self) -> DataFrame:
        return C.nb_predict(self.keyed_training_rows, self.label_index, self.n_features, self._put)

    # -- reports

    def item_freq_since(self, years: list[int]) -> DataFrame:
        return P.item_freq_since(self.baskets, self.tables.headers, self.tables.catalog, years)
