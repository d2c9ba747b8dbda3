"""Registered queries: one per operator, each with its SQL twin when one exists.

Every query reads the fixture tables of an sf directory (``sf_dir``) in full.
Output doubles are rounded to 6 places and arrays rendered as
'|'-joined strings so the two engines can be compared value by value.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import oracle as O
from .config import DEFAULT, BasketConfig
from .functions.text import ljust_sql, rjust_sql
from .operators import baskets as B
from .operators import classify as C
from .operators import mining as M
from .operators import reports as P
from .plans.market_basket import BasketRun
from .plans.results import FILES, export, resume
from .sources import files as S
from .sources import fixtures as X
from .sources import results as R
from .sources.tables import read_tables

QueryFn = Callable[[SparkSession, str], DataFrame]

# Time range used by the range queries; inside the fixture span 1995-2001.
RANGE = ("1996-01-01", "2000-01-01")

SPARK: dict[str, QueryFn] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        SPARK[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


def presentable(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles and join arrays with '|'.

    Ranks are decided on logs rounded to 9 places inside the operators; the
    values shown are rounded to 6 so both engines print the same digits.
    """
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.round(c, digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws("|", c.cast("array<string>"))
        cols.append(c.alias(f.name))
    return df.select(cols)


def run(spark: SparkSession, sf_dir: str, cfg: BasketConfig = DEFAULT) -> BasketRun:
    return BasketRun(spark, X.fixture_tables(spark, sf_dir), cfg)


def _sql(ctes: list[str], body: str) -> str:
    return O._with(*ctes) + body


def _lines_sql(body: str) -> str:
    return _sql([O.LINES, O.HEADERS, O.CATALOG, O.TAXONOMY], body)


UNSIZED = DEFAULT.with_(cartsize_min=1, cartsize_max=None)

# =================================================================== sources


@register("scan_lines", _lines_sql("SELECT register, receipt, item, qty FROM lines"))
def q_scan_lines(spark, sf_dir):
    return X.lines(spark, sf_dir)


@register("scan_headers", _lines_sql("SELECT register, receipt, ts FROM headers"))
def q_scan_headers(spark, sf_dir):
    return X.headers(spark, sf_dir).select("register", "receipt", "ts")


@register("catalog_distinct", _lines_sql("SELECT DISTINCT item, name, descr FROM catalog"))
def q_catalog_distinct(spark, sf_dir):
    return B.catalog_distinct(X.catalog(spark, sf_dir))


@register(
    "table_preview",
    _lines_sql(
        "SELECT register, receipt, item, qty FROM lines WHERE receipt > 100 "
        "ORDER BY register, receipt, item, qty LIMIT 200"
    ),
)
def q_table_preview(spark, sf_dir):
    return B.table_preview(
        X.lines(spark, sf_dir), ["register", "receipt", "item", "qty"], 100, DEFAULT.preview_rows
    )


# =================================================================== basket prep


@register(
    "receipt_length_hist",
    _lines_sql(
        "SELECT c, count(*) AS f FROM (SELECT count(*) AS c FROM lines "
        "GROUP BY register, receipt) GROUP BY c"
    ),
)
def q_receipt_length_hist(spark, sf_dir):
    return B.receipt_length_hist(X.lines(spark, sf_dir))


@register(
    "receipt_total_hist",
    _lines_sql(
        "SELECT c, count(*) AS f FROM (SELECT count(*) AS c FROM headers "
        "GROUP BY register, total) GROUP BY c"
    ),
)
def q_receipt_total_hist(spark, sf_dir):
    return B.receipt_total_hist(X.headers(spark, sf_dir))


_IN_RANGE = (
    f"SELECT register, receipt, ts FROM headers "
    f"WHERE ts > TIMESTAMP '{RANGE[0]}' AND ts < TIMESTAMP '{RANGE[1]}'"
)


@register("receipts_in_range", _lines_sql(_IN_RANGE))
def q_receipts_in_range(spark, sf_dir):
    return B.receipts_in_range(X.headers(spark, sf_dir), *RANGE)


@register(
    "receipt_time_span",
    _lines_sql(f"SELECT min(ts) AS ts_min, max(ts) AS ts_max, count(*) AS n FROM ({_IN_RANGE})"),
)
def q_receipt_time_span(spark, sf_dir):
    return B.receipt_time_span(B.receipts_in_range(X.headers(spark, sf_dir), *RANGE))


@register("item_names", _sql([O.CATALOG, O.ITEM_NAMES], "SELECT item, name FROM item_names"))
def q_item_names(spark, sf_dir):
    return B.item_names(X.catalog(spark, sf_dir))


@register(
    "item_category",
    _sql([O.TAXONOMY_WHOLE, O.ITEM_CATEGORY], "SELECT item, category FROM item_category"),
)
def q_item_category(spark, sf_dir):
    return B.item_category(X.taxonomy(spark, sf_dir, whole=True))


@register(
    "category_names",
    _sql([O.TAXONOMY_WHOLE, O.CATEGORY_NAMES], "SELECT item AS category, name FROM category_names"),
)
def q_category_names(spark, sf_dir):
    return B.category_names(X.taxonomy(spark, sf_dir, whole=True))


@register(
    "category_short_names",
    _sql([O.TAXONOMY_WHOLE], f"SELECT DISTINCT {O.CODE} AS category, cat1_name FROM taxonomy"),
)
def q_category_short_names(spark, sf_dir):
    return B.category_short_names(X.taxonomy(spark, sf_dir, whole=True))


@register(
    "lines_by_register",
    _lines_sql("SELECT * FROM lines WHERE register IS DISTINCT FROM 3"),
)
def q_lines_by_register(spark, sf_dir):
    return B.register_filter(X.lines(spark, sf_dir), "shop")


def _lines_of(register_name: str, where: str) -> None:
    @register(f"lines_{register_name}", _lines_sql(f"SELECT * FROM lines WHERE {where}"))
    def q(spark, sf_dir):
        return B.register_filter(X.lines(spark, sf_dir), register_name)


_lines_of("espresso", "register = 3")
_lines_of("shop1", "register = 1")
_lines_of("shop2", "register = 2")


@register(
    "net_lines",
    _sql(O.basket_ctes(), "SELECT register, receipt, item, qty FROM net"),
)
def q_net_lines(spark, sf_dir):
    return B.net_lines(X.lines(spark, sf_dir))


@register(
    "category_lines",
    _sql(
        O.basket_ctes(),
        "SELECT n.register, n.receipt, n.item, n.qty, coalesce(c.category, '0000') AS category "
        "FROM net n LEFT JOIN item_category c ON c.item = n.item",
    ),
)
def q_category_lines(spark, sf_dir):
    net = B.net_lines(X.lines(spark, sf_dir))
    return B.category_lines(net, B.item_category(X.taxonomy(spark, sf_dir)))


_BASKETS_OUT = "SELECT register, receipt, array_to_string(items, '|') AS items, size FROM baskets"


@register("baskets", _sql(O.basket_ctes(UNSIZED), _BASKETS_OUT))
def q_baskets(spark, sf_dir):
    return presentable(B.build_baskets(X.fixture_tables(spark, sf_dir), UNSIZED))


@register("baskets_sized", _sql(O.basket_ctes(), _BASKETS_OUT))
def q_baskets_sized(spark, sf_dir):
    return presentable(B.build_baskets(X.fixture_tables(spark, sf_dir), DEFAULT))


_RANGED = DEFAULT.with_(timerange=RANGE)


@register("baskets_in_range", _sql(O.basket_ctes(_RANGED), _BASKETS_OUT))
def q_baskets_in_range(spark, sf_dir):
    return presentable(B.build_baskets(X.fixture_tables(spark, sf_dir), _RANGED))


@register(
    "baskets_unique",
    _sql(O.basket_ctes(), "SELECT DISTINCT array_to_string(items, '|') AS items, size FROM baskets"),
)
def q_baskets_unique(spark, sf_dir):
    b = B.build_baskets(X.fixture_tables(spark, sf_dir), DEFAULT.with_(unique=True))
    return presentable(b.select("items", "size"))


_NO_FUEL = DEFAULT.with_(drop_item="0101")


@register("baskets_without_item", _sql(O.basket_ctes(_NO_FUEL), _BASKETS_OUT))
def q_baskets_without_item(spark, sf_dir):
    return presentable(B.build_baskets(X.fixture_tables(spark, sf_dir), _NO_FUEL))


_SIZES = "SELECT size, count(*) AS freq FROM baskets WHERE size >= 2 GROUP BY size"


@register("basket_sizes", _sql(O.basket_ctes(), _SIZES))
def q_basket_sizes(spark, sf_dir):
    return B.basket_sizes(run(spark, sf_dir).baskets, DEFAULT.cartsize_min)


@register("basket_sizes_by_size", _sql(O.basket_ctes(), _SIZES + " ORDER BY size"))
def q_basket_sizes_by_size(spark, sf_dir):
    return B.basket_sizes_by_size(run(spark, sf_dir).baskets, DEFAULT.cartsize_min)


@register(
    "basket_size_fence",
    _sql(
        O.basket_ctes(UNSIZED)
        + [
            "h AS (SELECT size, count(*) AS freq FROM baskets WHERE size > 1 GROUP BY size)",
            """c AS (SELECT size, sum(freq) OVER (ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING
                 AND CURRENT ROW) AS cum, sum(freq) OVER () AS n FROM h)""",
            """q AS (SELECT min(CASE WHEN cum > 0.25::DOUBLE * (n - 1) THEN size END) AS q1,
                        min(CASE WHEN cum > 0.75::DOUBLE * (n - 1) THEN size END) AS q3 FROM c)""",
        ],
        "SELECT q1, q3, q3 - q1 AS iqr, CAST(floor(q1 - 3.0::DOUBLE * (q3 - q1)) AS DOUBLE) AS lower, "
        "CAST(ceil(q3 + 3.0::DOUBLE * (q3 - q1)) AS DOUBLE) AS upper FROM q",
    ),
)
def q_basket_size_fence(spark, sf_dir):
    b = B.build_baskets(X.fixture_tables(spark, sf_dir), UNSIZED)
    return B.basket_size_fence(B.basket_sizes(b, 1), 3.0)


# =================================================================== mining

_MINING = O.mining_ctes()


@register("item_freq", _sql(_MINING, "SELECT item, freq FROM item_freq"))
def q_item_freq(spark, sf_dir):
    return run(spark, sf_dir).item_freq


@register(
    "item_prob",
    _sql(_MINING, "SELECT item, freq, round(freq / (SELECT n FROM nb), 6) AS prob FROM item_freq"),
)
def q_item_prob(spark, sf_dir):
    r = run(spark, sf_dir)
    return presentable(M.item_prob(r.item_freq, r.n_baskets))


@register(
    "item_share",
    _sql(
        _MINING,
        "SELECT item, freq, round(freq / (SELECT sum(freq) FROM item_freq), 6) AS share FROM item_freq",
    ),
)
def q_item_share(spark, sf_dir):
    return presentable(M.item_share(run(spark, sf_dir).item_freq))


@register("frequent_items", _sql(_MINING, "SELECT item, freq FROM frequent"))
def q_frequent_items(spark, sf_dir):
    return run(spark, sf_dir).frequent


@register(
    "candidate_pairs",
    _sql(
        _MINING,
        "SELECT count(*) AS frequent_items, "
        "CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS candidate_pairs FROM frequent",
    ),
)
def q_candidate_pairs(spark, sf_dir):
    return M.candidate_pairs(run(spark, sf_dir).frequent)


@register("pair_freq", _sql(_MINING, "SELECT a, b, freq FROM pair_freq"))
def q_pair_freq(spark, sf_dir):
    return run(spark, sf_dir).pair_freq


@register(
    "item_prob_smoothed",
    _sql(_MINING, "SELECT item, round(prob, 6) AS prob FROM item_prob_s"),
)
def q_item_prob_smoothed(spark, sf_dir):
    return presentable(run(spark, sf_dir).item_prob_smoothed)


@register(
    "pair_prob_smoothed",
    _sql(_MINING, "SELECT a, b, round(prob, 6) AS prob FROM pair_prob"),
)
def q_pair_prob_smoothed(spark, sf_dir):
    return presentable(run(spark, sf_dir).pair_prob_smoothed)


@register(
    "association_rules",
    _sql(
        _MINING,
        "SELECT a, b, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules "
        "ORDER BY confidence DESC, lift DESC, a, b",
    ),
)
def q_association_rules(spark, sf_dir):
    return presentable(M.order_rules(run(spark, sf_dir).rules))


@register("rule_items", _sql(_MINING, "SELECT item FROM rule_items"))
def q_rule_items(spark, sf_dir):
    return run(spark, sf_dir).rule_items


# Baskets of two items or more, however long.
UNCAPPED = DEFAULT.with_(cartsize_max=None)
_MINING_UNCAPPED = O.mining_ctes(UNCAPPED)


@register("item_freq_uncapped", _sql(_MINING_UNCAPPED, "SELECT item, freq FROM item_freq"))
def q_item_freq_uncapped(spark, sf_dir):
    return run(spark, sf_dir, UNCAPPED).item_freq


@register("pair_freq_uncapped", _sql(_MINING_UNCAPPED, "SELECT a, b, freq FROM pair_freq"))
def q_pair_freq_uncapped(spark, sf_dir):
    return run(spark, sf_dir, UNCAPPED).pair_freq


@register(
    "association_rules_uncapped",
    _sql(
        _MINING_UNCAPPED,
        "SELECT a, b, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules",
    ),
)
def q_association_rules_uncapped(spark, sf_dir):
    return presentable(run(spark, sf_dir, UNCAPPED).rules)


def _interaction_sql(mining: list[str], rows: str) -> str:
    return _sql(
        mining
        + [
            O.CATEGORY_NAMES,
            f"kept AS (SELECT * FROM pair_freq WHERE freq > {O._d(DEFAULT.support_pair)} * (SELECT n FROM nb))",
            "both_ AS (SELECT a AS item, freq FROM kept UNION ALL SELECT b AS item, freq FROM kept)",
            """stats AS (SELECT item, count(*) AS n, max(freq) AS max, avg(freq) AS avg,
                 CAST(median(freq) AS DOUBLE) AS median, stddev_pop(freq) AS stddev
               FROM both_ GROUP BY item)""",
            f"""top AS (SELECT item, string_agg(CAST(freq AS VARCHAR), ' ' ORDER BY freq DESC) AS list
               FROM (SELECT item, freq, row_number() OVER (PARTITION BY item ORDER BY freq DESC) AS rn
                     FROM both_) WHERE {rows} GROUP BY item)""",
        ],
        "SELECT cn.name, s.item, s.n, s.max, round(s.avg, 6) AS avg, round(s.median, 6) AS median, "
        "round(s.stddev, 6) AS stddev, t.list FROM stats s JOIN top t ON t.item = s.item "
        "LEFT JOIN category_names cn ON cn.item = s.item",
    )


@register("item_interaction_uncapped", _interaction_sql(_MINING_UNCAPPED, "TRUE"))
def q_item_interaction_uncapped(spark, sf_dir):
    r = run(spark, sf_dir, UNCAPPED)
    return presentable(M.item_interaction(r.pair_freq, r.n_baskets, r.names, UNCAPPED.support_pair))


@register("item_interaction", _interaction_sql(_MINING, f"rn <= {DEFAULT.interaction_list_max}"))
def q_item_interaction(spark, sf_dir):
    r = run(spark, sf_dir)
    return presentable(
        M.item_interaction(
            r.pair_freq, r.n_baskets, r.names, DEFAULT.support_pair, DEFAULT.interaction_list_max
        )
    )


@register(
    "basket_subsets",
    _sql(
        _MINING
        + [
            f"""subs AS (
  SELECT list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1) AS subset FROM (
    SELECT items, unnest(range(1, CAST(1 AS BIGINT) << size)) AS m FROM baskets
    WHERE size <= {DEFAULT.subset_len_max})
  UNION ALL SELECT items AS subset FROM baskets WHERE size > {DEFAULT.subset_len_max})"""
        ],
        "SELECT array_to_string(subset, '|') AS subset, CAST(len(subset) AS INTEGER) AS size, "
        "count(*) AS freq FROM subs GROUP BY subset",
    ),
)
def q_basket_subsets(spark, sf_dir):
    return presentable(M.basket_subsets(run(spark, sf_dir).baskets, DEFAULT.subset_len_max))


# Sets of up to three items (categories) held by over one basket in a thousand.
SUBSET_SUPPORT, SUBSET_ITEMS = 0.001, 3


_SUBSETS = _MINING_UNCAPPED + [
    f"often AS (SELECT * FROM item_freq WHERE freq > {O._d(SUBSET_SUPPORT)} * (SELECT n FROM nb))",
    "kept AS (SELECT register, receipt, item FROM bitems WHERE item IN (SELECT item FROM often))",
    """pairs AS (
  SELECT x.item || '|' || y.item AS subset, 2 AS size, count(*) AS freq FROM kept x JOIN kept y
  ON y.register = x.register AND y.receipt = x.receipt AND x.item < y.item GROUP BY 1)""",
    """triples AS (
  SELECT x.item || '|' || y.item || '|' || z.item AS subset, 3 AS size, count(*) AS freq
  FROM kept x JOIN kept y ON y.register = x.register AND y.receipt = x.receipt AND x.item < y.item
  JOIN kept z ON z.register = x.register AND z.receipt = x.receipt AND y.item < z.item GROUP BY 1)""",
    "sets AS (SELECT item AS subset, 1 AS size, freq FROM often UNION ALL FROM pairs UNION ALL FROM triples)",
]


@register(
    "frequent_subsets",
    _sql(
        _SUBSETS,
        "SELECT subset, CAST(size AS INTEGER) AS size, freq FROM sets "
        f"WHERE freq > {O._d(SUBSET_SUPPORT)} * (SELECT n FROM nb)",
    ),
)
def q_frequent_subsets(spark, sf_dir):
    return presentable(run(spark, sf_dir, UNCAPPED).frequent_subsets(SUBSET_SUPPORT, SUBSET_ITEMS))


# Sets of up to five items that occur in more than one basket in ten thousand.
FIVES_SUPPORT, FIVES_ITEMS = 0.0001, 5


def _fives_sql() -> str:
    """Sets of each size by joining the sets of one item less with the basket's later items."""
    ctes = _MINING_UNCAPPED + [
        f"often AS (SELECT item FROM item_freq WHERE freq > {O._d(FIVES_SUPPORT)} * (SELECT n FROM nb))",
        "kept AS (SELECT register, receipt, item FROM bitems WHERE item IN (SELECT item FROM often))",
        "s1 AS (SELECT register, receipt, item AS subset, item AS last FROM kept)",
    ]
    for n in range(2, FIVES_ITEMS + 1):
        ctes.append(
            f"s{n} AS (SELECT s.register, s.receipt, s.subset || '|' || k.item AS subset, k.item AS last FROM s{n - 1} s JOIN kept k "
            "ON k.register = s.register AND k.receipt = s.receipt AND k.item > s.last)"
        )
    sets = " UNION ALL ".join(f"SELECT subset, CAST({n} AS INTEGER) AS size FROM s{n}" for n in range(1, FIVES_ITEMS + 1))
    return _sql(
        ctes,
        f"SELECT subset, size, count(*) AS freq FROM ({sets}) GROUP BY 1, 2 HAVING count(*) > {O._d(FIVES_SUPPORT)} * (SELECT n FROM nb)",
    )


@register("frequent_subsets_of_five", _fives_sql())
def q_frequent_subsets_of_five(spark, sf_dir):
    return presentable(run(spark, sf_dir, UNCAPPED).frequent_subsets(FIVES_SUPPORT, FIVES_ITEMS))


# =================================================================== recommend

_LNP = (
    "lnp AS (SELECT item, ln(freq / (SELECT n FROM nb)) AS lnp FROM item_freq "
    "WHERE item IN (SELECT item FROM rule_items))"
)
# Per basket and candidate: sum, count, max of ln conf and the positive part.
_BSC = """bsc AS (
  SELECT b.register, b.receipt, r.b AS item, sum(ln(r.confidence)) AS s, count(*) AS cnt,
         max(ln(r.confidence)) AS mx,
         sum(CASE WHEN ln(r.confidence) > 0 THEN ln(r.confidence) END) AS pos_s,
         count(CASE WHEN ln(r.confidence) > 0 THEN 1 END) AS pos_cnt
  FROM bitems b JOIN rules r ON r.a = b.item GROUP BY 1, 2, 3)"""
_BCAND = """bcand AS (
  SELECT b.register, b.receipt, b.size, v.item FROM baskets b CROSS JOIN rule_items v
  WHERE NOT list_contains(b.items, v.item))"""
_REC = _MINING + [_LNP, _BSC, _BCAND]


def _best_n(score: str, join: str) -> str:
    """Top n candidates of each basket by a score expression over c, p (ln P) and s (sums)."""
    return f"""SELECT register, receipt, CAST(rank AS INTEGER) AS rank, item, round(log_score, 6) AS log_score FROM (
      SELECT *, row_number() OVER (PARTITION BY register, receipt
                                   ORDER BY round(log_score, 9) DESC NULLS LAST, item) AS rank FROM (
        SELECT c.register, c.receipt, c.item, {score} AS log_score
        FROM bcand c JOIN lnp p ON p.item = c.item {join} bsc s
        ON s.register = c.register AND s.receipt = c.receipt AND s.item = c.item))
    WHERE rank <= {DEFAULT.topn}"""


@register("nb_classic", _sql(_REC, _best_n("p.lnp + s.s", "JOIN")))
def q_nb_classic(spark, sf_dir):
    return presentable(run(spark, sf_dir).recommendations("classic"))


@register("nb_subset", _sql(_REC, _best_n("CASE WHEN s.cnt > 0 THEN p.lnp + s.s END", "LEFT JOIN")))
def q_nb_subset(spark, sf_dir):
    return presentable(run(spark, sf_dir).recommendations("subset"))


@register(
    "nb_best_subset",
    _sql(
        _REC,
        _best_n("CASE WHEN s.pos_cnt > 0 THEN p.lnp + s.pos_s WHEN s.cnt > 0 THEN p.lnp + s.mx END", "LEFT JOIN"),
    ),
)
def q_nb_best_subset(spark, sf_dir):
    return presentable(run(spark, sf_dir).recommendations("best"))


# Leave-one-out samples, their candidate scores and the top-n ranking.
_LOO_STEPS = [
    _LNP,
    O.CATEGORY_NAMES,
    """loo AS (
  SELECT register, receipt, item AS label FROM bitems
  WHERE item IN (SELECT item FROM rule_items) AND size > 1)""",
    """lsc AS (
  SELECT l.register, l.receipt, l.label, r.b AS item, sum(ln(r.confidence)) AS s, count(*) AS cnt
  FROM loo l JOIN bitems c ON c.register = l.register AND c.receipt = l.receipt AND c.item <> l.label
  JOIN rules r ON r.a = c.item GROUP BY 1, 2, 3, 4)""",
    """lcand AS (
  SELECT l.register, l.receipt, l.label, v.item
  FROM loo l JOIN baskets b ON b.register = l.register AND b.receipt = l.receipt
  CROSS JOIN rule_items v WHERE v.item = l.label OR NOT list_contains(b.items, v.item))""",
    """lscored AS (
  SELECT c.*, CASE WHEN s.cnt > 0 THEN p.lnp + s.s END AS log_score
  FROM lcand c JOIN lnp p ON p.item = c.item LEFT JOIN lsc s
  ON s.register = c.register AND s.receipt = c.receipt AND s.label = c.label AND s.item = c.item)""",
    f"""ltop AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY register, receipt, label
                 ORDER BY round(log_score, 9) DESC NULLS LAST, item) AS rank FROM lscored)
  WHERE rank <= {DEFAULT.topn})""",
    """lhit AS (
  SELECT l.register, l.receipt, l.label, coalesce(t.rank, 0) AS hit_rank FROM loo l
  LEFT JOIN ltop t ON t.register = l.register AND t.receipt = l.receipt
   AND t.label = l.label AND t.item = l.label)""",
    """lcount AS (
  SELECT v.item, coalesce(h.nX, 0) AS nX, coalesce(h.tp, 0) AS tp FROM rule_items v LEFT JOIN (
    SELECT label AS item, count(*) AS nX, count(*) FILTER (WHERE hit_rank > 0) AS tp
    FROM lhit GROUP BY label) h ON h.item = v.item)""",
]
_LOO = _MINING + _LOO_STEPS
_UNIQUE = DEFAULT.with_(unique=True)
_LOO_UNIQUE = O.mining_ctes(_UNIQUE) + _LOO_STEPS
_LOO_UNCAPPED = _MINING_UNCAPPED + _LOO_STEPS


@register(
    "leave_one_out",
    _sql(
        _LOO,
        "SELECT l.register, l.receipt, l.label, "
        "array_to_string(list_filter(b.items, lambda x: x <> l.label), '|') AS items "
        "FROM loo l JOIN baskets b ON b.register = l.register AND b.receipt = l.receipt",
    ),
)
def q_leave_one_out(spark, sf_dir):
    from .operators.evaluate import leave_one_out

    r = run(spark, sf_dir)
    return presentable(leave_one_out(r.baskets, r.rule_items))


@register(
    "topn_recs",
    _sql(
        _LOO,
        "SELECT register, receipt, label, CAST(rank AS INTEGER) AS rank, item, "
        "round(log_score, 6) AS log_score FROM ltop",
    ),
)
def q_topn_recs(spark, sf_dir):
    return presentable(run(spark, sf_dir).topn_recs)


@register(
    "topn_recs_uncapped",
    _sql(
        _LOO_UNCAPPED,
        "SELECT register, receipt, label, CAST(rank AS INTEGER) AS rank, item, "
        "round(log_score, 6) AS log_score FROM ltop",
    ),
)
def q_topn_recs_uncapped(spark, sf_dir):
    return presentable(run(spark, sf_dir, UNCAPPED).topn_recs)


# Items instead of categories, with a low support, and baskets of any length.
_ITEMS_UNCAPPED = DEFAULT.with_(taxo=False, cartsize_max=None, support_item=0.0025)


@register(
    "topn_recs_items",
    _sql(
        O.mining_ctes(_ITEMS_UNCAPPED) + _LOO_STEPS,
        "SELECT register, receipt, label, CAST(rank AS INTEGER) AS rank, item, "
        "round(log_score, 6) AS log_score FROM ltop",
    ),
)
def q_topn_recs_items(spark, sf_dir):
    return presentable(run(spark, sf_dir, _ITEMS_UNCAPPED).topn_recs)


@register(
    "topn_recs_unique",
    _sql(
        _LOO_UNIQUE,
        "SELECT CAST(NULL AS INTEGER) AS register, CAST(NULL AS BIGINT) AS receipt, label, "
        "CAST(rank AS INTEGER) AS rank, item, round(log_score, 6) AS log_score FROM ltop",
    ),
)
def q_topn_recs_unique(spark, sf_dir):
    return presentable(run(spark, sf_dir, _UNIQUE).topn_recs)


@register(
    "eval_per_item",
    _sql(
        _LOO,
        "SELECT cn.name, c.item, (SELECT count(*) FROM loo) AS n, c.nX, c.tp, "
        "round(CASE WHEN c.nX > 0 THEN c.tp / c.nX END, 6) AS recall "
        "FROM lcount c LEFT JOIN category_names cn ON cn.item = c.item "
        "ORDER BY recall DESC, c.item",
    ),
)
def q_eval_per_item(spark, sf_dir):
    return presentable(run(spark, sf_dir).eval_per_item)


@register(
    "eval_hits_by_rank",
    _sql(
        _LOO,
        f"SELECT v.item, CAST(r.rank AS INTEGER) AS rank, coalesce(h.hits, 0) AS hits "
        f"FROM rule_items v CROSS JOIN range(1, {DEFAULT.topn + 1}) r(rank) LEFT JOIN ("
        f"SELECT label AS item, hit_rank, count(*) AS hits FROM lhit WHERE hit_rank > 0 "
        f"GROUP BY 1, 2) h ON h.item = v.item AND h.hit_rank = r.rank",
    ),
)
def q_eval_hits_by_rank(spark, sf_dir):
    return run(spark, sf_dir).eval_hits_by_rank


@register(
    "eval_overall",
    _sql(
        _LOO,
        "SELECT n, tp, round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6) AS accuracy, "
        "round(CASE WHEN n > 0 THEN (n - tp) / n ELSE 0 END, 6) AS mae FROM ("
        "SELECT count(*) AS n, count(*) FILTER (WHERE hit_rank > 0) AS tp FROM lhit)",
    ),
)
def q_eval_overall(spark, sf_dir):
    return presentable(run(spark, sf_dir).eval_overall)


@register(
    "eval_overall_unique",
    _sql(
        _LOO_UNIQUE,
        "SELECT n, tp, round(CASE WHEN n > 0 THEN tp / n ELSE 0 END, 6) AS accuracy, "
        "round(CASE WHEN n > 0 THEN (n - tp) / n ELSE 0 END, 6) AS mae FROM ("
        "SELECT count(*) AS n, count(*) FILTER (WHERE hit_rank > 0) AS tp FROM lhit)",
    ),
)
def q_eval_overall_unique(spark, sf_dir):
    return presentable(run(spark, sf_dir, _UNIQUE).eval_overall)


@register(
    "eval_confusion",
    _sql(
        _LOO
        + [
            """conf AS (
  SELECT c.item, c.tp, c.nX - c.tp AS fn, coalesce(r.n_rec, 0) - c.tp AS fp,
         (SELECT count(*) FROM loo) AS n
  FROM lcount c LEFT JOIN (SELECT item, count(*) AS n_rec FROM ltop GROUP BY item) r
  ON r.item = c.item)"""
        ],
        """SELECT item, tp, n - tp - fp - fn AS tn, fp, fn,
             round(CASE WHEN n > 0 THEN (n - fp - fn) / n ELSE 0 END, 6) AS accuracy,
             round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision,
             round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall,
             round(CASE WHEN tp > 0 THEN 2 * (tp / (tp + fp)) * (tp / (tp + fn))
                   / (tp / (tp + fp) + tp / (tp + fn)) ELSE 0 END, 6) AS f1
           FROM conf""",
    ),
)
def q_eval_confusion(spark, sf_dir):
    return presentable(run(spark, sf_dir).eval_confusion)


# =================================================================== files


@register("taxonomy_scan", _sql([O.TAXONOMY_WHOLE], "SELECT cat0_id, cat1_id, cat0_name, cat1_name, item FROM taxonomy"))
def q_taxonomy_scan(spark, sf_dir):
    r = run(spark, sf_dir)
    path = f"{r.store.path}/taxonomy.tsv"
    S.write_taxonomy_tsv(X.taxonomy(spark, sf_dir, whole=True), path)
    return S.read_taxonomy_tsv(spark, path)


@register(
    "taxonomy_build",
    _sql(
        [O.CATALOG, O.TAXONOMY],
        "SELECT t.cat0_id, t.cat1_id, 'cn0_' || t.cat0_id AS cat0_name, 'cn1_' || t.cat1_id AS cat1_name, "
        "'0' AS store, c.item, c.name, c.descr "
        "FROM (SELECT DISTINCT item, name, descr FROM catalog) c LEFT JOIN taxonomy t ON t.item = c.item "
        "ORDER BY t.cat0_id, t.cat1_id, c.item",
    ),
)
def q_taxonomy_build(spark, sf_dir):
    r = run(spark, sf_dir)
    path = f"{r.store.path}/category_ids.csv"
    S.write_category_ids_csv(X.category_ids(spark, sf_dir), path)
    return B.taxonomy_build(r.tables.catalog, S.read_category_ids_csv(spark, path))


@register("tsv_roundtrip", _sql(O.basket_ctes(), "SELECT array_to_string(items, '|') AS items, size FROM baskets"))
def q_tsv_roundtrip(spark, sf_dir):
    r = run(spark, sf_dir)
    path = f"{r.store.path}/carts.tsv"
    S.write_carts(r.baskets, path)
    return presentable(S.read_carts(spark, path))


def _fixed(x: str) -> str:
    return f"printf('%10.5f', round({x}, 5))"


_EXPORT = _LOO + [
    f"kept AS (SELECT * FROM pair_freq WHERE freq > {O._d(DEFAULT.support_pair)} * (SELECT n FROM nb))",
    "both_ AS (SELECT a AS item, freq FROM kept UNION ALL SELECT b AS item, freq FROM kept)",
    """stats AS (SELECT item, count(*) AS n, max(freq) AS max, avg(freq) AS avg, CAST(median(freq) AS DOUBLE) AS median,
                     stddev_pop(freq) AS stddev FROM both_ GROUP BY item)""",
    f"""top AS (SELECT item, string_agg(CAST(freq AS VARCHAR), ' ' ORDER BY freq DESC) AS list FROM (
           SELECT item, freq, row_number() OVER (PARTITION BY item ORDER BY freq DESC) AS rn FROM both_)
         WHERE rn <= {DEFAULT.interaction_list_max} GROUP BY item)""",
    """hits AS (SELECT item, string_agg(CAST(hits AS VARCHAR), chr(9) ORDER BY hit_rank) AS hits FROM (
           SELECT label AS item, hit_rank, count(*) AS hits FROM lhit WHERE hit_rank > 0 GROUP BY 1, 2) GROUP BY item)""",
    "per AS (SELECT *, CASE WHEN nX > 0 THEN tp / nX END AS recall FROM lcount)",
    f"""out_ AS (
  SELECT 'freq_item.tsv' AS file, row_number() OVER (ORDER BY freq DESC, item) AS pos, concat_ws(chr(9), item, freq) AS line FROM item_freq
  UNION ALL
  SELECT 'freq_pair.tsv', row_number() OVER (ORDER BY a, b), concat_ws(chr(9), a, b, freq) FROM pair_freq
  UNION ALL
  SELECT 'interaction.tsv', 1, {"'" + chr(9).join(R.INTERACTION_HEADER) + "'"}
  UNION ALL
  SELECT 'interaction.tsv', 1 + row_number() OVER (ORDER BY s.item),
         concat_ws(chr(9), coalesce(cn.name, ''), s.item, s.n, s.max, {_fixed("s.avg")},
                   CASE WHEN s.n % 2 = 1 THEN CAST(CAST(s.median AS BIGINT) AS VARCHAR) ELSE printf('%.1f', s.median) END,
                   {_fixed("s.stddev")}, t.list)
  FROM stats s JOIN top t ON t.item = s.item LEFT JOIN category_names cn ON cn.item = s.item
  UNION ALL
  SELECT 'confidence_ab.tsv', 1, {"'" + chr(9).join(R.RULES_HEADER) + "'"}
  UNION ALL
  SELECT 'confidence_ab.tsv', 1 + row_number() OVER (ORDER BY round(confidence, 9) DESC, round(lift, 9) DESC, a, b),
         concat_ws(chr(9), a, b, {_fixed("confidence")}, {_fixed("lift")}) FROM rules
  UNION ALL
  SELECT 'eval_nb.tsv', row_number() OVER (ORDER BY round(p.recall, 9) DESC NULLS LAST, p.item),
         concat_ws(chr(9), coalesce(cn.name, ''), p.item, (SELECT count(*) FROM loo), p.nX, p.tp, coalesce({_fixed("p.recall")}, ''), h.hits)
  FROM per p LEFT JOIN category_names cn ON cn.item = p.item LEFT JOIN hits h ON h.item = p.item)""",
]


@register("results_export", _sql(_EXPORT, "SELECT file, pos, line FROM out_"))
def q_results_export(spark, sf_dir):
    r = run(spark, sf_dir)
    path = f"{r.store.path}/results"
    export(r, path)
    out = None
    for name in ("items", "pairs", "interaction", "rules", "evaluation"):
        lines = R.read_lines(spark, f"{path}/{FILES[name]}", r._put).select(F.lit(FILES[name]).alias("file"), "pos", "line")
        out = lines if out is None else out.unionByName(lines)
    return out


@register(
    "results_roundtrip",
    _sql(_MINING, "SELECT a, b, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules"),
)
def q_results_roundtrip(spark, sf_dir):
    r = run(spark, sf_dir)
    path = f"{r.store.path}/results"
    export(r, path)
    again, _ = resume(spark, path, r.tables)
    return presentable(again.rules)


@register(
    "net_lines_from_tables",
    _sql(O.basket_ctes(), "SELECT register, receipt, item, CAST(qty AS DOUBLE) AS qty FROM net"),
)
def q_net_lines_from_tables(spark, sf_dir):
    """The fixture as DECIMAL tables on disk, read back through the contract and netted."""
    t = X.fixture_tables(spark, sf_dir)
    store = run(spark, sf_dir).store
    decimal = {"lines": t.lines.withColumn("qty", F.col("qty").cast("decimal(18,3)")), "headers": t.headers, "catalog": t.catalog, "taxonomy": t.taxonomy}
    paths = {}
    for name, df in decimal.items():
        paths[name] = f"{store.path}/feed/{name}"
        df.write.parquet(paths[name])
    tables, _ = read_tables(spark, **paths)
    return B.net_lines(tables.lines).withColumn("qty", F.col("qty").cast("double"))


# =================================================================== classification

_INDEX = "item_index AS (SELECT item, freq, CAST(row_number() OVER (ORDER BY freq, item) AS INTEGER) AS idx FROM frequent)"
_TRAIN_STEPS = [
    _INDEX,
    "fi AS (SELECT b.register, b.receipt, i.idx FROM bitems b JOIN item_index i ON i.item = b.item)",
    "fl AS (SELECT register, receipt, list_sort(list(idx)) AS fidx FROM fi GROUP BY register, receipt)",
    """train AS (
  SELECT CAST(l.idx AS DOUBLE) AS label, list_filter(fl.fidx, lambda x: x <> l.idx) AS indices
  FROM fi l JOIN fl ON fl.register = l.register AND fl.receipt = l.receipt WHERE len(fl.fidx) > 1)""",
]


_TRAIN = _MINING + _TRAIN_STEPS


@register(
    "training_rows_uncapped",
    _sql(_MINING_UNCAPPED + _TRAIN_STEPS, "SELECT label, array_to_string(indices, '|') AS indices FROM train"),
)
def q_training_rows_uncapped(spark, sf_dir):
    return presentable(run(spark, sf_dir, UNCAPPED).training_rows)


@register("item_index", _sql(_TRAIN, "SELECT item, freq, idx FROM item_index"))
def q_item_index(spark, sf_dir):
    return run(spark, sf_dir).item_index


@register("training_rows", _sql(_TRAIN, "SELECT label, array_to_string(indices, '|') AS indices FROM train"))
def q_training_rows(spark, sf_dir):
    return presentable(run(spark, sf_dir).training_rows)


@register("training_counts", _sql(_TRAIN, "SELECT label, count(*) AS n FROM train GROUP BY label"))
def q_training_counts(spark, sf_dir):
    return C.training_counts(run(spark, sf_dir).training_rows)


@register("libsvm_roundtrip", _sql(_TRAIN, "SELECT label, array_to_string(indices, '|') AS indices FROM train"))
def q_libsvm_roundtrip(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    data = run(spark, sf_dir).libsvm_data
    arr = vector_to_array(F.col("features"))
    ones = F.filter(
        F.transform(arr, lambda v, i: F.when(v != 0, i + 1)), lambda x: x.isNotNull()
    ).cast("array<int>")
    return presentable(data.select("label", ones.alias("indices")))


_ROW_KEY = """'{"register":' || l.register || ',"receipt":' || l.receipt || '}|' || l.idx"""


_KEYED = f"""keyed AS (
  SELECT CAST(l.idx AS DOUBLE) AS label, list_filter(fl.fidx, lambda x: x <> l.idx) AS indices, {_ROW_KEY} AS row_key
  FROM fi l JOIN fl ON fl.register = l.register AND fl.receipt = l.receipt WHERE len(fl.fidx) > 1)"""
_IN_TRAIN = f"(CAST('0x' || substr(md5(row_key), 1, 8) AS BIGINT) % 100 < {C.TRAIN_PERCENT})"


@register(
    "train_test_split",
    _sql(_TRAIN + [_KEYED], f"SELECT row_key, label, CASE WHEN {_IN_TRAIN} THEN 'train' ELSE 'test' END AS split FROM keyed"),
)
def q_train_test_split(spark, sf_dir):
    train, test = C.train_test_split(run(spark, sf_dir).training_data)
    return train.select("row_key", "label", F.lit("train").alias("split")).unionByName(
        test.select("row_key", "label", F.lit("test").alias("split"))
    )


@register(
    "training_rows_shuffled",
    _sql(
        _TRAIN + [_KEYED],
        f"SELECT row_number() OVER (ORDER BY md5('{C.SHUFFLE_SEED}|' || row_key), row_key) AS pos, label, "
        "array_to_string(indices, '|') AS indices FROM keyed",
    ),
)
def q_training_rows_shuffled(spark, sf_dir):
    return presentable(run(spark, sf_dir).shuffled_rows.select("pos", "label", "indices"))


# The forest is fitted by Spark ML, so these have no SQL over the input tables;
# tests hold them to the stored node table, in SQL, and to Spark ML's own predictions.
@register("rf_predict")
def q_rf_predict(spark, sf_dir):
    return run(spark, sf_dir).rf_predictions


@register("rf_matches")
def q_rf_matches(spark, sf_dir):
    return C.matches(run(spark, sf_dir).rf_predictions)


@register("rf_accuracy")
def q_rf_accuracy(spark, sf_dir):
    return presentable(C.accuracy(run(spark, sf_dir).rf_predictions))


_NB = [
    _KEYED,
    """labels_ AS (
  SELECT label, CAST(row_number() OVER (ORDER BY count(*) DESC, CAST(label AS VARCHAR)) - 1 AS DOUBLE) AS indexedLabel
  FROM keyed GROUP BY label)""",
    f"split AS (SELECT k.*, l.indexedLabel, {_IN_TRAIN} AS train FROM keyed k JOIN labels_ l ON l.label = k.label)",
    """cls AS (SELECT indexedLabel AS class, count(*) AS n, sum(len(indices)) AS k FROM split WHERE train GROUP BY 1)""",
    f"""model AS (
  SELECT class, ln(n + {O._d(C.NB_SMOOTHING)}) - ln((SELECT sum(n) FROM cls) + (SELECT count(*) FROM cls) * {O._d(C.NB_SMOOTHING)}) AS base,
         ln({O._d(C.NB_SMOOTHING)}) - ln(k + (SELECT count(*) FROM item_index) * {O._d(C.NB_SMOOTHING)}) AS none FROM cls)""",
    f"""gains AS (
  SELECT idx, class, ln(count(*) + {O._d(C.NB_SMOOTHING)}) - ln({O._d(C.NB_SMOOTHING)}) AS gain
  FROM (SELECT indexedLabel AS class, unnest(indices) AS idx FROM split WHERE train) GROUP BY 1, 2)""",
    "sets AS (SELECT DISTINCT indices FROM split WHERE NOT train)",
    """hits AS (
  SELECT s.indices, g.class, sum(g.gain) AS gain FROM (SELECT indices, unnest(indices) AS idx FROM sets) s
  JOIN gains g ON g.idx = s.idx GROUP BY 1, 2)""",
    """scored AS (
  SELECT s.indices, m.class, round(m.base + len(s.indices) * m.none + coalesce(h.gain, 0), 9) AS score
  FROM sets s CROSS JOIN model m LEFT JOIN hits h ON h.indices = s.indices AND h.class = m.class)""",
    """won AS (
  SELECT indices, class FROM (SELECT *, row_number() OVER (PARTITION BY indices ORDER BY score DESC, class) AS rn
                              FROM scored) WHERE rn = 1)""",
]


@register(
    "ml_nb_predict",
    _sql(
        _TRAIN + _NB,
        "SELECT s.row_key, s.label, s.indexedLabel, w.class AS prediction FROM split s JOIN won w ON w.indices = s.indices WHERE NOT s.train",
    ),
)
def q_ml_nb_predict(spark, sf_dir):
    return run(spark, sf_dir).nb_predictions


# =================================================================== reports


@register(
    "item_freq_named",
    _sql(_MINING + [O.CATEGORY_NAMES],
         "SELECT f.item, f.freq, cn.name FROM item_freq f LEFT JOIN category_names cn ON cn.item = f.item"),
)
def q_item_freq_named(spark, sf_dir):
    r = run(spark, sf_dir)
    return P.item_freq_named(r.item_freq, r.names)


@register(
    "pair_freq_named",
    _sql(
        _MINING + [O.CATEGORY_NAMES],
        "SELECT p.a, p.b, p.freq, na.name AS name_a, nb.name AS name_b FROM pair_freq p "
        "LEFT JOIN category_names na ON na.item = p.a LEFT JOIN category_names nb ON nb.item = p.b "
        "ORDER BY p.freq DESC, p.a, p.b",
    ),
)
def q_pair_freq_named(spark, sf_dir):
    r = run(spark, sf_dir)
    return P.pair_freq_named(r.pair_freq, r.names)


_PA, _PB = rjust_sql("p.a", 4), rjust_sql("p.b", 4)


@register(
    "pair_freq_category",
    _sql(
        _MINING
        + [
            f"short AS (SELECT DISTINCT {rjust_sql('(' + O.CODE + ')', 4)} AS category, "
            f"{ljust_sql('cat1_name', 20)} AS cat1_name FROM taxonomy)"
        ],
        f"SELECT {_PA} AS a, {_PB} AS b, p.freq, sa.cat1_name AS cat1_a, sb.cat1_name AS cat1_b "
        f"FROM pair_freq p LEFT JOIN short sa ON sa.category = {_PA} "
        f"LEFT JOIN short sb ON sb.category = {_PB} ORDER BY p.freq DESC",
    ),
)
def q_pair_freq_category(spark, sf_dir):
    r = run(spark, sf_dir)
    return P.pair_freq_category(r.pair_freq, r.tables.taxonomy)


# "Since" cut-offs inside the fixture span; item-level baskets of 2..7 items.
SINCE_YEARS = [1996, 1997, 1998, 1999, 2000]
_ITEMS_2_7 = DEFAULT.with_(taxo=False, cartsize_max=7)
_FS = ", ".join(
    f"count(*) FILTER (WHERE h.ts > TIMESTAMP '{y}-01-01') AS fs_{y}" for y in SINCE_YEARS
)
_FS_OUT = ", ".join(f"coalesce(n.fs_{y}, 0) AS fs_{y}" for y in SINCE_YEARS)


@register(
    "item_freq_since",
    _sql(
        O.basket_ctes(_ITEMS_2_7)
        + [
            "ht AS (SELECT register, receipt, max(ts) AS ts FROM headers GROUP BY register, receipt)",
            f"""cnt AS (SELECT b.item, count(*) AS freq_all, {_FS} FROM bitems b LEFT JOIN ht h
               ON h.register IS NOT DISTINCT FROM b.register AND h.receipt = b.receipt GROUP BY b.item)""",
        ],
        f"SELECT coalesce(n.freq_all, 0) AS freq_all, {_FS_OUT}, c.item, c.name, c.descr "
        f"FROM (SELECT DISTINCT item, name, descr FROM catalog) c LEFT JOIN cnt n ON n.item = c.item",
    ),
)
def q_item_freq_since(spark, sf_dir):
    return run(spark, sf_dir, _ITEMS_2_7).item_freq_since(SINCE_YEARS)


# One month of raw items: short enough that some are sold at one register only.
_ITEMS = DEFAULT.with_(taxo=False, timerange=("1996-01-01", "1996-01-31"))


@register(
    "register_only_items",
    _sql(
        O.basket_ctes(_ITEMS),
        "SELECT item, count(*) AS freq FROM bitems WHERE register = 3 AND item NOT IN "
        "(SELECT item FROM bitems WHERE register IN (1, 2)) GROUP BY item",
    ),
)
def q_register_only_items(spark, sf_dir):
    return P.register_only_items(run(spark, sf_dir, _ITEMS).baskets)


def queries() -> dict[str, QueryFn]:
    return dict(SPARK)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
