"""SQL text of every checked query, for a second engine (DuckDB).

The SQL is written independently of the Spark plans: pairs come from a
self-join instead of an in-row explode, rankings from window functions
instead of in-row sorts, subsets from a bit-mask list filter. Only the fixed
input mappings (see :mod:`trolley.sources.fixtures`) are shared. Doubles that
come out of aggregates are rounded to 6 places on both sides.
"""

from __future__ import annotations

from .config import DEFAULT, BasketConfig
from .functions.text import ljust_sql, rjust_sql

# ------------------------------------------------------------------ inputs

LINES = """lines AS (
  SELECT CAST(l_orderkey % 3 AS INTEGER) + 1 AS register, l_orderkey AS receipt,
         CAST(l_partkey AS VARCHAR) AS item,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS qty
  FROM lineitem)"""

HEADERS = """headers AS (
  SELECT CAST(o_orderkey % 3 AS INTEGER) + 1 AS register, o_orderkey AS receipt,
         o_orderdate AS ts, CAST(floor(o_totalprice / 1000) AS BIGINT) AS total
  FROM orders)"""

CATALOG = """catalog AS (
  SELECT CAST(p_partkey AS VARCHAR) AS item, p_name AS name, p_type AS descr FROM part)"""

TAXONOMY_WHOLE = """taxonomy AS (
  SELECT CASE p_type WHEN 'ECONOMY' THEN '1' WHEN 'LARGE' THEN '2' WHEN 'MEDIUM' THEN '3'
                     WHEN 'PROMO' THEN '4' WHEN 'SMALL' THEN '5' ELSE '6' END AS cat0_id,
         CAST(CAST(substr(p_brand, 7) AS INTEGER) AS VARCHAR) AS cat1_id,
         p_type AS cat0_name, p_brand AS cat1_name, CAST(p_partkey AS VARCHAR) AS item
  FROM part)"""

# The baskets' taxonomy lacks some parts.
TAXONOMY = TAXONOMY_WHOLE[:-1] + " WHERE p_partkey % 20 <> 19)"

CODE = f"({rjust_sql('cat0_id', 2)}) || ({rjust_sql('cat1_id', 2)})"

ITEM_CATEGORY = f"""item_category AS (
  SELECT item, min({CODE}) AS category FROM taxonomy GROUP BY item)"""

CATEGORY_NAMES = f"""category_names AS (
  SELECT {CODE} AS item, min(cat0_name || '-' || cat1_name) AS name
  FROM taxonomy GROUP BY 1)"""

ITEM_NAMES = """item_names AS (SELECT item, min(name) AS name FROM catalog GROUP BY item)"""


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def _register_where(register: str) -> str:
    return {
        "all": "TRUE",
        "shop": "register IS DISTINCT FROM 3",
        "espresso": "register = 3",
        "shop1": "register = 1",
        "shop2": "register = 2",
    }[register]


def _d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def basket_ctes(cfg: BasketConfig = DEFAULT, sized: bool = True) -> list[str]:
    """CTEs up to ``baskets(register, receipt, items, size)`` and ``bitems``
    (long form of the sized baskets: register, receipt, item, size)."""
    ctes = [LINES, HEADERS, CATALOG, TAXONOMY, ITEM_CATEGORY]
    ctes.append(
        f"""net AS (
  SELECT register, receipt, item, sum(qty) AS qty FROM lines
  WHERE {_register_where(cfg.register)}
  GROUP BY register, receipt, item HAVING sum(qty) > 0)"""
    )
    item_expr = (
        f"coalesce(c.category, '{cfg.unknown_category}')" if cfg.taxo else "n.item"
    )
    join = "LEFT JOIN item_category c ON c.item = n.item" if cfg.taxo else ""
    drop = f"WHERE {item_expr} <> '{cfg.drop_item}'" if cfg.drop_item else ""
    ctes.append(
        f"""raw_items AS (
  SELECT DISTINCT n.register, n.receipt, {item_expr} AS item FROM net n {join} {drop})"""
    )
    lo = cfg.cartsize_min if sized else 1
    hi = cfg.cartsize_max if sized else None
    size_cond = f"size >= {lo}" + (f" AND size <= {hi}" if hi is not None else "")
    time_cond = "TRUE"
    if cfg.timerange:
        t0, t1 = cfg.timerange
        time_cond = f"""EXISTS (SELECT 1 FROM headers h
      WHERE h.register IS NOT DISTINCT FROM s.register AND h.receipt = s.receipt
        AND h.ts > TIMESTAMP '{t0}' AND h.ts < TIMESTAMP '{t1}')"""
    ctes.append(
        f"""bitems AS (
  SELECT * FROM (
    SELECT register, receipt, item,
           CAST(count(*) OVER (PARTITION BY register, receipt) AS INTEGER) AS size
    FROM raw_items) s
  WHERE {size_cond} AND {time_cond})"""
    )
    ctes.append(
        """baskets AS (
  SELECT register, receipt, list_sort(list(item)) AS items, CAST(count(*) AS INTEGER) AS size
  FROM bitems GROUP BY register, receipt)"""
    )
    return ctes


def mining_ctes(cfg: BasketConfig = DEFAULT) -> list[str]:
    """Adds n_baskets, item_freq, frequent, pair_freq, item/pair probabilities, rules."""
    k = _d(cfg.smooth_k)
    ctes = basket_ctes(cfg)
    if cfg.unique:
        # Distinct item sets, numbered so that the later joins have a key.
        ctes[-2:] = [ctes[-2].replace("bitems AS", "all_items AS", 1), ctes[-1].replace("baskets AS", "all_baskets AS", 1).replace("FROM bitems", "FROM all_items")]
        ctes.append(
            """baskets AS (
  SELECT 1 AS register, row_number() OVER (ORDER BY items) AS receipt, items, size
  FROM (SELECT DISTINCT items, size FROM all_baskets))"""
        )
        ctes.append("bitems AS (SELECT register, receipt, unnest(items) AS item, size FROM baskets)")
    ctes.append("nb AS (SELECT count(*) AS n FROM baskets)")
    ctes.append("item_freq AS (SELECT item, count(*) AS freq FROM bitems GROUP BY item)")
    ctes.append(
        f"""frequent AS (
  SELECT item, freq FROM item_freq WHERE freq > {_d(cfg.support_item)} * (SELECT n FROM nb))"""
    )
    ctes.append(
        """pair_freq AS (
  SELECT x.item AS a, y.item AS b, count(*) AS freq
  FROM bitems x JOIN bitems y
    ON x.register IS NOT DISTINCT FROM y.register AND x.receipt = y.receipt AND x.item < y.item
  WHERE x.item IN (SELECT item FROM frequent) AND y.item IN (SELECT item FROM frequent)
  GROUP BY x.item, y.item)"""
    )
    if cfg.smooth_k > 0:
        item_p = f"(freq + {k}) / ((SELECT n FROM nb) + {k} * (SELECT count(*) FROM item_freq))"
        pair_p = f"(freq + {k}) / ((SELECT n FROM nb) + {k} * (SELECT count(*) FROM pair_freq))"
    else:
        item_p = pair_p = "freq / (SELECT n FROM nb)"
    ctes.append(f"item_prob_s AS (SELECT item, {item_p} AS prob FROM item_freq)")
    ctes.append(f"frequent_prob AS (SELECT item, {item_p} AS prob FROM frequent)")
    ctes.append(
        f"""pair_prob AS (
  SELECT a, b, {pair_p} AS prob FROM pair_freq
  WHERE freq > {_d(cfg.support_pair)} * (SELECT n FROM nb))"""
    )
    ctes.append(
        f"""rules AS (
  SELECT * FROM (
    SELECT p.a AS a, p.b AS b, p.prob / pb.prob AS confidence, p.prob / pb.prob / pa.prob AS lift
    FROM pair_prob p JOIN frequent_prob pa ON pa.item = p.a JOIN frequent_prob pb ON pb.item = p.b
    UNION ALL
    SELECT p.b, p.a, p.prob / pa.prob, p.prob / pa.prob / pb.prob
    FROM pair_prob p JOIN frequent_prob pa ON pa.item = p.a JOIN frequent_prob pb ON pb.item = p.b)
  WHERE lift > {_d(cfg.lift_threshold)} AND confidence > {_d(cfg.confidence_threshold)})"""
    )
    ctes.append("rule_items AS (SELECT a AS item FROM rules UNION SELECT b FROM rules)")
    return ctes

