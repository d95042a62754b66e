"""Sorting, limits, top-k, and set operations."""

from __future__ import annotations

_C = "SELECT c_nationkey AS k FROM customer"
_S = "SELECT s_nationkey AS k FROM supplier"
_BAG = "(VALUES (1), (1), (1), (2), (3), (NULL), (NULL)) AS a(k)"
_BAG2 = "(VALUES (1), (1), (3), (4), (NULL)) AS b(k)"

QUERIES: dict[str, tuple[str, str | None]] = {
    "sort": ("SELECT c_custkey, c_mktsegment FROM customer ORDER BY c_mktsegment DESC, c_custkey LIMIT 50", None),
    "sort_nulls": (
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey ASC NULLS LAST, c_custkey DESC LIMIT 40 OFFSET 14990", None
    ),
    "sort_nulls_default": (
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey, c_custkey LIMIT 40",
        "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 40",
    ),
    "sort_position": ("SELECT p_size, p_partkey FROM part ORDER BY 1 DESC, 2 LIMIT 25", None),
    "sort_alias": ("SELECT p_partkey, p_size * 2 AS twice FROM part ORDER BY twice, p_partkey LIMIT 25", None),
    "sort_expr": ("SELECT p_partkey FROM part ORDER BY abs(p_size - 25), p_partkey LIMIT 25", None),
    "sort_agg_output": ("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC, o_orderpriority", None),
    "limit_offset": ("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 5", None),
    "topk": ("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10", None),
    "union_all": (f"{_C} UNION ALL {_S}", None),
    "union": (f"{_C} UNION {_S}", None),
    "intersect": (f"{_C} INTERSECT {_S}", None),
    "except": ("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders", None),
    "intersect_all": (f"SELECT k FROM {_BAG} INTERSECT ALL SELECT k FROM {_BAG2}", None),
    "except_all": (f"SELECT k FROM {_BAG} EXCEPT ALL SELECT k FROM {_BAG2}", None),
}
