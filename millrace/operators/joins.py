"""Joins: inner, outer, cross, theta, self, n-way, semi and anti."""

from __future__ import annotations

QUERIES: dict[str, tuple[str, str | None]] = {
    "join_inner": ("SELECT o_orderkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey", None),
    "join_left": ("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'", None),
    "join_right": ("SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 0", None),
    "join_full": ("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey * 3 + 10", None),
    "join_cross": ("SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b", None),
    "join_theta": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey", None),
    "join_self": ("SELECT a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey", None),
    "join_nway": (
        "SELECT r_name, n_name, count(*) AS n FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey "
        "JOIN orders ON o_custkey = c_custkey GROUP BY r_name, n_name", None
    ),
    "join_hash": ("SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'P'", None),
    "join_index_nl": ("SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey", None),
    "join_broadcast_dim": (
        "SELECT /*+ BROADCAST(nation) */ n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
        "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    ),
    "join_gather": ("SELECT o_orderkey, l_linenumber, p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey WHERE p_size = 1", None),
    "join_semi": (
        "SELECT c_custkey, c_name FROM customer LEFT SEMI JOIN orders ON c_custkey = o_custkey",
        "SELECT c_custkey, c_name FROM customer SEMI JOIN orders ON c_custkey = o_custkey",
    ),
    "join_anti": (
        "SELECT c_custkey, c_name FROM customer LEFT ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
        "SELECT c_custkey, c_name FROM customer ANTI JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000",
    ),
}
